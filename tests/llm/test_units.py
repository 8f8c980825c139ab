import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from vecspark.llm.textunits import UnitEncoder, balanced  # noqa: E402
from vecspark.llm.tokencount import safe_pieces, token_lengths  # noqa: E402

FILES = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")]
ENCODERS = {f: (UnitEncoder(f), Tokenizer.from_file(f)) for f in FILES}
PIECES = ["the", "The.", "don't", " ", "  ", "\n", "\n\n", "\t", " \n", "a.b", "...", "x,y.", "é", "é", "J̌", "ÄÖß", "İ", "K", " ", " ", "\x1c", "\x1f", "\x01", "12.5", "日本語", "<|endoftext|>", "<|startoftext|>", "<|", "🙂", "Σας", "'s", "!!", "a$$$", "É&&&b", "x:y;", "#%*", "½", "हिन्दी.", "VERGİSİ.", "ज़.", "ज़ ", "ড়,"]


def same(texts, file):
    enc, tok = ENCODERS[file]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    ids, n = enc.encode(pa.array(texts, pa.string()))
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]
    assert enc.lengths(pa.array(texts, pa.string())).tolist() == n.tolist()


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=150, deadline=None)
@given(data=st.data())
def test_units_give_the_ids_of_whole_texts(file, data):
    texts = data.draw(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.text(max_size=12), min_size=1, max_size=5))
    same(texts, file)


@pytest.mark.parametrize("file", FILES)
def test_every_code_point_beside_every_mark(file):
    codes = [c for c in [*range(0x34000), *range(0xE0000, 0xE0200), 0xF0000, 0x10FFFD] if not 0xD800 <= c < 0xE000]
    for k in range(0, len(codes), 20_000):
        same(["".join(f"{chr(c)}{m}a{m}" for m in ".,!?;:#$%&*") + chr(c) for c in codes[k : k + 20_000]], file)


def test_other_tokenizers_encode_texts_whole(tmp_path):
    setup = json.loads(Tokenizer.from_file(FILES[0]).to_str())
    for k, change in enumerate(({"pre_tokenizer": {**setup["pre_tokenizer"], "add_prefix_space": True}}, {"normalizer": {"type": "NFKC"}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(setup | change))
        enc, tok = UnitEncoder(str(path)), Tokenizer.from_file(str(path))
        assert enc.kind is None
        texts = ["Hello there. A b,c", "", "x\ny " * 300, "ﬁne ½."]
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        ids, n = enc.encode(pa.array(texts))
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert token_lengths(pa.array(texts), str(path), 1000, 64).tolist() == n.tolist()


@pytest.mark.parametrize("file", FILES)
def test_memory_starts_anew(file):
    enc = UnitEncoder(file, max_units=5)
    tok = Tokenizer.from_file(file)
    for k in range(4):
        texts = [f"word{k} other. more{k},", "", "the end"] * (1 + k % 2)
        assert enc.lengths(pa.array(texts)).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("file", FILES)
def test_long_texts_in_pieces(file):
    tok = Tokenizer.from_file(file)
    texts = [" ".join(f"word{i % 97}'s" for i in range(3000)), "x" * 5000, "a  b \n c " * 500, "p <|endoftext|> q " * 300, ""]
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_lengths(pa.array(texts), file, 1000, 64).tolist() == want
    assert all("".join(safe_pieces(t, 64)) == t for t in texts)


def test_batches_cover_every_row_once():
    texts = pa.array(["a" * n for n in (5, 0, 100, 1, 1, 1, 50)])
    runs = list(balanced(texts, 10))
    assert [k for b, e in runs for k in range(b, e)] == list(range(7))
    assert (2, 3) in runs
    assert list(balanced(pa.array([], pa.string()), 10)) == []
