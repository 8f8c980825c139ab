"""Encoding whole texts through their repeated units.

A text is cut at boundaries where the tokenizer's own pre-tokenisation always cuts, so the ids of the
text are the ids of its units one after another. Arrow splits the texts and numbers the units; each new
unit is encoded by the tokenizers library and then looked up, which is several times faster than
encoding every text whole. Texts in which such boundaries are not certain (control characters, unusual
or doubled white space, special strings, letters that the library's normaliser ties to a mark behind
them) are encoded whole by the library; so is every text under a tokenizer of another kind than the two known.
"""

from __future__ import annotations

import json
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Control characters, and white space other than single spaces and line ends.
_IRREGULAR = r"[\x00-\x09\x0b-\x1f\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|<\|"
_SEPARATOR = "\x1f"
#: Units end between a letter and one of these.
_MARKS = "[.,!?;:#$%&*]"
#: Units are encoded together in texts of so many, with a mark between them whose id is known.
_TOGETHER = 2000


#: The two set-ups under which units are known to be safe, as the tokenizer files write them.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FOLD = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def kind_of(setup: dict) -> str | None:
    """``bytes`` or ``words`` for a tokenizer file under which texts can be cut into units, else None.

    Looked at are all parts that can reach over a cut: truncation, padding, the model, the added strings,
    the normaliser and the pre-tokenizer.
    """
    model = setup["model"]
    if setup.get("truncation") or setup.get("padding") or model.get("type") != "BPE" or model.get("dropout"):
        return None
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in setup["added_tokens"]):
        return None
    byte_level = lambda p, regex: p and p["type"] == "ByteLevel" and not p["add_prefix_space"] and p.get("use_regex", True) == regex
    folds, cuts = setup.get("normalizer"), setup.get("pre_tokenizer")
    if folds is None and byte_level(cuts, True):
        return "bytes"
    if not folds or not cuts or folds["type"] != "Sequence" or folds["normalizers"] != _FOLD or cuts["type"] != "Sequence" or len(cuts["pretokenizers"]) != 2:
        return None
    first, second = cuts["pretokenizers"]
    split = first["type"] == "Split" and first["pattern"] == {"Regex": _SPLIT} and first["behavior"] == "Removed" and first["invert"]
    return "words" if split and byte_level(second, False) else None


def tied_letters(tokenizer) -> str:
    """A pattern of the letters (as Arrow tells them) that the tokenizer doesn't part from a mark behind them.

    Every code point is tried: one that normalises to a letter and a combining mark is such a letter, and
    so is one that the tokenizer's tables don't call a letter. Empty if there is none.
    """
    code = np.concatenate([np.arange(0x80, 0xD800), np.arange(0xE000, 0xF0000)])  # private use lies behind
    every = code.astype("<u4").tobytes().decode("utf-32-le")
    letters = pc.replace_substring_regex(pa.array([every]), r"\PL+", "")[0].as_py()
    letters = np.frombuffer(letters.encode("utf-32-le"), "<u4")
    tied = []
    for k in range(0, len(letters), 1 << 13):
        own = letters[k : k + (1 << 13)]
        parts = list(map(chr, own.tolist()))
        if tokenizer.normalizer:
            parts = tokenizer.normalizer.normalize_str("\n".join(parts)).split(" ")
        if len(parts) != len(own):
            raise ValueError("letters could not be told apart")
        starts = {at for _, (at, _) in tokenizer.pre_tokenizer.pre_tokenize_str("".join(p + ".\n" for p in parts))}
        at = np.cumsum([len(p) + 2 for p in parts]) - 2
        plain = [m in starts and p.isalpha() for m, p in zip(at.tolist(), parts, strict=True)]
        tied += own[~np.array(plain)].tolist()
    runs = np.split(tied, np.flatnonzero(np.diff(tied) > 1) + 1) if tied else []
    return "".join(rf"\x{{{r[0]:x}}}-\x{{{r[-1]:x}}}" for r in runs)


_TIED: dict[str, str] = {}


def tied_of(path: str) -> str:
    """``tied_letters`` of a file, found once a process: the driver does it and hands it to its tasks."""
    if path not in _TIED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _TIED[path] = tied_letters(tokenizer) if kind_of(json.loads(tokenizer.to_str(pretty=False))) else ""
    return _TIED[path]


class UnitEncoder:
    """Ids and lengths of texts under one ``tokenizers`` file, with bounded memory.

    Two kinds of pre-tokenizer are told apart (``kind_of``). One removes white space: units end at spaces
    and line ends. The other (byte-level) keeps it: units start at a space, and a line end is a unit. Both cut
    between a letter and one of the marks ``.,!?;:#$%&*``. Under any other tokenizer texts are encoded whole.
    Special strings inside texts are matched as the library does by default. At most ``max_units`` units are
    remembered (or those of one call, if more); beyond that the memory starts anew with the units at hand,
    which costs time only.
    """

    def __init__(self, path: str, max_units: int = 600_000, tied: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind_of(json.loads(self.tokenizer.to_str(pretty=False)))
        self.drops_space = self.lower = self.kind == "words"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = " \x01 " if self.drops_space else "\n"
        mark = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        if len(mark) != 1:
            self.kind = None
        if self.kind:
            (self.mark_id,) = mark
            tied = tied_of(path) if tied is None else tied
            # Lower case changes how some letters join with combining marks, so such texts stay whole.
            self.irregular = _IRREGULAR + (r"|\pM" if self.lower else "") + (f"|[{tied}]{_MARKS}" if tied else "")
        self.max_units = max_units
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _forget_others(self, units: list[str], at: np.ndarray) -> None:
        """Starts the memory anew with those of ``units`` that it knows, and puts their new places into ``at``."""
        known = np.flatnonzero(at >= 0)
        old = at[known]
        size = self.size[old]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.begin[old] - (ends - size), size) + np.arange(size.sum())]
        self.begin, self.size = ends - size, size
        self.index = {units[k]: i for i, k in enumerate(known.tolist())}
        at[known] = np.arange(len(known))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> np.ndarray:
        """The remembered place of each of these different units."""
        get = self.index.get
        at = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            if len(self.index) + len(missing) > self.max_units:
                self._forget_others(units, at)
            new = [units[k] for k in missing.tolist()]
            usual = np.fromiter((u not in ("", " ", self.mark) for u in new), bool, len(new))
            plain, extra = list(compress(new, usual.tolist())), list(compress(new, (~usual).tolist()))
            ids = self._whole([self.mark.join(plain[k : k + _TOGETHER]) + self.mark for k in range(0, len(plain), _TOGETHER)])
            ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            stop = np.flatnonzero(ids == self.mark_id)
            if len(stop) != len(plain):  # the mark is part of no unit, so this doesn't happen
                raise ValueError("units could not be told apart")
            begin = len(self.flat) + np.concatenate([[0], stop + 1])[:-1] if len(plain) else np.zeros(0, np.int64)
            size = len(self.flat) + stop - begin
            tail = self._whole(extra)
            held = len(self.flat) + len(ids)
            for t in tail:
                begin, size, held = np.append(begin, held), np.append(size, len(t)), held + len(t)
            base = len(self.index)
            self.index.update(zip(plain + extra, range(base, base + len(new)), strict=True))
            at[np.concatenate([missing[usual], missing[~usual]])] = np.arange(base, base + len(new))
            self.flat = np.concatenate([self.flat, ids, *tail])
            self.begin, self.size = np.concatenate([self.begin, begin.astype(np.int64)]), np.concatenate([self.size, size.astype(np.int64)])
        return at

    def _look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The remembered place of every unit of all texts, and the number of units of each text."""
        if self.lower:
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, rf"(\pL)({_MARKS})", "\\1" + _SEPARATOR + "\\2")
        if self.drops_space:
            texts = pc.replace_substring(pc.replace_substring(texts, "\n", _SEPARATOR), " ", _SEPARATOR)
        else:
            texts = pc.replace_substring(pc.replace_substring(texts, " ", _SEPARATOR + " "), "\n", f"{_SEPARATOR}\n{_SEPARATOR}")
        split = pc.split_pattern(texts, _SEPARATOR)
        coded = pc.dictionary_encode(split.flatten())
        at = self._learn(coded.dictionary.to_pylist())
        return at[coded.indices.to_numpy()], pc.list_value_length(split).to_numpy().astype(np.int64)

    def _by_kind(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.kind:
            return np.zeros(0, np.int64), np.arange(len(texts))
        odd = pc.match_substring_regex(texts, self.irregular).to_numpy(zero_copy_only=False)
        return np.flatnonzero(~odd), np.flatnonzero(odd)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        plain, odd = self._by_kind(texts)
        if len(plain):
            at, count = self._look_up(texts.take(pa.array(plain)) if len(odd) else texts)
            total, ends = np.concatenate([[0], np.cumsum(self.size[at])]), np.cumsum(count)
            out[plain] = total[ends] - total[ends - count]
        if len(odd):
            out[odd] = [len(x) for x in self.tokenizer.encode_batch_fast(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row (uint32), and the number of ids of each text."""
        plain, odd = self._by_kind(texts)
        n, ids = np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        if len(plain):
            at, count = self._look_up(texts.take(pa.array(plain)) if len(odd) else texts)
            size = self.size[at]
            total, ends = np.concatenate([[0], np.cumsum(size)]), np.cumsum(count)
            kind = np.int32 if max(len(self.flat), total[-1]) < 1 << 31 else np.int64
            ids = self.flat[np.repeat((self.begin[at] - total[:-1]).astype(kind), size) + np.arange(total[-1], dtype=kind)]
            n[plain] = total[ends] - total[ends - count]
        if len(odd):
            whole = self._whole(texts.take(pa.array(odd)).to_pylist())
            ends = np.cumsum(n[plain])
            parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
            for k, e, m in zip(plain.tolist(), ends.tolist(), n[plain].tolist(), strict=True):
                parts[k] = ids[e - m : e]
            for k, w in zip(odd.tolist(), whole, strict=True):
                parts[k], n[k] = w, len(w)
            ids = np.concatenate(parts)
        return ids, n


_ENCODERS: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, frugal: bool = False, tied: str | None = None) -> UnitEncoder:
    """The worker's encoder of ``path``, kept between tasks; a worker keeps one at a time.

    ``tied``: what ``tied_of`` found in the driver. ``frugal``: a fraction of the memory for more time, for jobs whose other stages need it.
    """
    if (path, frugal) not in _ENCODERS:
        import os

        _ENCODERS.clear()
        _give_back()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task has one core
        _ENCODERS[path, frugal] = UnitEncoder(path, 120_000 if frugal else 600_000, tied)
    return _ENCODERS[path, frugal]


def _give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(batches):
    """Hands batches on and gives freed memory back at the end: the worker waits idle beside other stages."""
    yield from batches
    for (_, frugal), enc in _ENCODERS.items():
        if frugal:
            enc._clear()
    _give_back()


def balanced(texts: pa.Array, max_bytes: int):
    """Slices ``(begin, end)`` of rows of about ``max_bytes`` each; a longer text has its own slice."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin = np.cumsum(size), 0
    while begin < len(size):
        before = ends[begin] - size[begin]
        end = max(begin + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield begin, end
        begin = end
