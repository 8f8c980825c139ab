"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one look-up table for each binned feature, then one for each
chosen pair of features; a score is a sum of table entries. Features are DataFrame expressions over the
text alone. The model is fitted on a bounded sample of labelled rows; every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm.shared import BROADCAST_BYTES, hide, show
from vecspark.llm.textunits import released

SPACE = r"[\x20\x09-\x0D]+"


def _share(count: Column, of: Column) -> Column:
    return F.coalesce(count / F.greatest(of, F.lit(1)), F.lit(0.0)).cast("double")


def with_features(docs: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    """Adds the features ``f_…`` (doubles, never null). One pass over words and lines of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_t", text)
    df = df.withColumn("_w", F.filter(F.split("_t", SPACE), lambda w: w != ""))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_n", F.size("_w")).withColumn("_c", F.length("_t")).withColumn("_d", F.size(F.array_distinct("_w")))
    count = lambda p: F.regexp_count("_t", F.lit(p))
    features = {
        "f_words": F.log1p(F.col("_n").cast("double")),
        "f_word_length": _share(F.length(F.array_join("_w", "")), F.col("_n")),
        "f_symbols": _share(count(r"[#*$%&<>@^~=+_\\{}\[\]]"), F.col("_c")),
        "f_bars": _share(count(r"\|"), F.col("_n")),
        "f_marks": _share(count(r"[!?]"), F.col("_n")),
        "f_stops": _share(count(r"[.,;:]"), F.col("_n")),
        "f_upper": _share(count(r"\p{Lu}"), F.col("_c")),
        "f_digits": _share(count(r"[0-9]"), F.col("_c")),
        "f_distinct": _share(F.col("_d"), F.col("_n")),
        "f_distinct_log": _share(F.log1p(F.col("_d").cast("double")), F.log1p(F.col("_n").cast("double"))),
        "f_lines": F.log1p(F.size("_l").cast("double")),
        "f_line_words": F.log1p(_share(F.col("_n"), F.size("_l"))),
        "f_dup_lines": _share(F.size("_l") - F.size(F.array_distinct("_l")), F.size("_l")),
        "f_short_words": _share(F.size(F.filter("_w", lambda w: F.length(w) == 1)), F.col("_n")),
    }
    return df.select(*docs.columns, *[v.alias(k) for k, v in features.items()]), list(features)


@dataclass
class Model:
    """Cut points of each feature, and tables by feature and by pair (over coarser bins)."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``: table entries added up, feature by feature."""
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        if self.pairs:
            bins = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for p in self.pairs for j in p}
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher")) if len(x) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def tree_1d(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf value of each bin, of a tree with at most ``leaves`` leaves that splits where it gains most."""
    spans, value = [(0, len(g))], np.zeros(len(g))
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(spans) < leaves:
        best = (1e-9, None, 0)
        for k, (a, b) in enumerate(spans):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = _gain(cg[cut] - cg[a], ch[cut] - ch[a], ridge) + _gain(cg[b] - cg[cut], ch[b] - ch[cut], ridge) - _gain(cg[b] - cg[a], ch[b] - ch[a], ridge)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], k, int(cut[at]))
        if best[1] is None:
            break
        a, b = spans[best[1]]
        spans[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    for a, b in spans:
        value[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return value


def tree_2d(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts one axis once and the other once on either side."""
    best = (0.0, np.zeros(g.shape))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        ca, cb = a.cumsum(0).cumsum(1), b.cumsum(0).cumsum(1)
        sides = []
        for sa, sb in (((ca[:-1], cb[:-1])), (ca[-1:] - ca[:-1], cb[-1:] - cb[:-1])):
            gain = _gain(sa[:, :-1], sb[:, :-1], ridge) + _gain(sa[:, -1:] - sa[:, :-1], sb[:, -1:] - sb[:, :-1], ridge)
            sides.append((gain.argmax(1), gain.max(1), sa, sb) if gain.shape[1] else None)
        if not len(ca) > 1 or sides[0] is None:
            continue
        total = sides[0][1] + sides[1][1]
        row = int(total.argmax())
        gain = float(total[row] - _gain(ca[-1, -1], cb[-1, -1], ridge))
        if gain > best[0]:
            value = np.zeros(a.shape)
            for s, rows in zip(sides, (slice(0, row + 1), slice(row + 1, None)), strict=True):
                col = int(s[0][row])
                value[rows, : col + 1] = -s[2][row, col] / (s[3][row, col] + ridge)
                value[rows, col + 1 :] = -(s[2][row, -1] - s[2][row, col]) / (s[3][row, -1] - s[3][row, col] + ridge)
            best = (gain, value.T if flip else value)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, pair_bins: int = 12, pairs: int = 8, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.08, leaves: int = 4, ridge: float = 2.0) -> Model:
    """Fits the tables. With one class only, or no row, the score is that class's (smoothed) share."""
    p = (y.sum() + 1) / (len(y) + 2)
    cuts = [_cuts(x[:, j], bins) for j in range(x.shape[1])]
    coarse = [_cuts(x[:, j], pair_bins) for j in range(x.shape[1])]
    model = Model(cuts, coarse, float(np.log(p / (1 - p))), [np.zeros(len(c) + 1) for c in cuts])
    if not len(y) or y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    f = np.full(len(y), model.base)

    def slopes():
        q = 1 / (1 + np.exp(-f))
        return q - y, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):  # cyclic: each feature in turn takes one small step
        for j, b in enumerate(at):
            g, h = slopes()
            n = len(cuts[j]) + 1
            step = rate * tree_1d(np.bincount(b, g, n), np.bincount(b, h, n), leaves, ridge)
            model.tables[j] += step
            f += step[b]
    wide = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
    grid = lambda i, j, v: np.bincount(wide[i] * (len(coarse[j]) + 1) + wide[j], v, (len(coarse[i]) + 1) * (len(coarse[j]) + 1)).reshape(len(coarse[i]) + 1, -1)
    g, h = slopes()
    ranked = sorted(((tree_2d(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i in range(x.shape[1]) for j in range(i)), key=lambda r: (-r[0], r[1:]))
    model.pairs = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * tree_2d(grid(i, j, g), grid(i, j, h), ridge)[1]
            model.pair_tables[k] += step
            f += step[wide[i], wide[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from at most ``max_rows`` labelled documents (those with the least hash of their id).

    The ids are at most ``max_rows``, so they are broadcast (24 bytes each, checked against the limit) and the
    documents are read once with no shuffle of texts. Labels other than 0 and 1, and null ids, are left out.
    An id that is labelled twice counts twice if its labels differ, else once; so does a document that comes twice.
    """
    if 24 * max_rows > BROADCAST_BYTES:
        raise ValueError("max_rows is too large for a broadcast")
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_k"), F.col(label_col).cast("int").alias("_y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("_k"), "_k", "_y").limit(max_rows)
    rows, names = with_features(docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_i") == F.col("_k")), "_text")
    sample = rows.select("_i", "_y", *names).distinct().limit(max_rows).toPandas().sort_values(["_i", "_y", *names])  # bounded by max_rows
    return fit(sample[names].to_numpy(np.float64), sample["_y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns but the text, with ``score`` (0 to 1, higher: label 1 is likelier). No shuffle.

    Null text counts as empty; an empty text has a score of its own features. Columns may have any names
    (one named as the score is replaced). Repeated rows are scored alike. Empty table: empty result.
    """
    hidden, names = hide(docs)
    others = {c: h for c, h in names.items() if c not in (text_col, score_col)}
    rows, features = with_features(hidden.select(*others.values(), F.col(names[text_col]).alias("_text")), "_text")
    schema = T.StructType([*hidden.select(*others.values()).schema.fields, T.StructField("_score", T.DoubleType())])

    def add(batches):
        for b in released(batches):
            x = np.column_stack([b.column(len(others) + k).to_numpy(zero_copy_only=False) for k in range(len(features))])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(model.score(x))], names=schema.names)

    return show(rows.select(*others.values(), *features).mapInArrow(add, schema), others, F.col("_score").alias(score_col))


def held_out(id_col: str) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 0 when divided by 5 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every document; ``predicted`` is 1 from ``threshold`` on.

    Repeated rows are scored alike. Without a usable label every score is 0.5. Empty table: empty result.
    """
    model = train(docs, labels.filter(~held_out(id_col)), id_col=id_col, text_col=text_col)
    scored = score(docs.select(F.col(id_col), F.col(text_col)), model, text_col=text_col, score_col="_score")
    out = scored.withColumnRenamed("_score", "score")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns, whatever their names."""
    model = train(docs, labels.filter(~held_out(id_col)), id_col=id_col, text_col=text_col)
    hidden, names = hide(docs)
    scored = score(hidden.withColumn("_txt", F.col(names[text_col])), model, text_col="_txt", score_col="_score")
    return show(scored.filter(F.col("_score") >= threshold), names)
