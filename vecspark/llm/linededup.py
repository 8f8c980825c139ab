"""Line de-duplication across documents within one word edit, by a deletion-neighbourhood join.

DataFrame operations only. Lines are compared by their words (lower case, any white space between). Two
lines are near if one word replaced, put in or left out makes them equal. A line is removed if an earlier
line equals it or is near it; earlier means a smaller (id, hash of text, line number). Lines under
``min_words`` words are near none: with five words or more, one edit means a similarity of 0.8 or more. They
are removed as exact repeats. Lines without a word stay.

Every line has as variants the words before and after each place, with the word at that place left out
or with nothing left out there. Lines with an equal variant are one edit apart or less: one word replaced,
or one put in. So the earliest line of each variant is kept, the others are joined with it, and the edit
distance of the pair is verified. A variant that very many lines share costs one row for each of them and
no pairs.

Variants are emitted only for lines that can be near another one: with one edit, the first or the last
half of the words is untouched, so such lines share a half with a different line. That filter is exact.
Equal lines are told by two 64-bit hashes with different seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import Workspace, hide, show, small

#: White space other than spaces and line ends.
_TABS = "\t\x0b\f\r"
#: Words whose prefix hashes are chained one by one; beyond, by blocks of as many.
_BLOCK = 64


def _folded(text: Column) -> Column:
    """Lower case, with one space for each run of white space inside lines."""
    return F.regexp_replace(F.translate(F.lower(text), _TABS, " " * len(_TABS)), "  +", " ")


def _count(line: Column) -> Column:
    """Number of words of a folded and trimmed line."""
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _half(line: Column, m: Column, last: bool) -> Column:
    """Key of the first or last ``m`` words of a line."""
    return F.xxhash64(m, F.lit(last), F.call_function("substring_index", line, F.lit(" "), -m if last else m))


def _same(line: Column) -> tuple[Column, Column]:
    """Two hashes that together tell whether lines are equal."""
    return F.xxhash64(line).alias("_h"), F.xxhash64(F.lit(1), line).alias("_g")


def _chain(words: Column) -> Column:
    """Hash of the first k words, for k from 0 to their number.

    An array that grows is copied with each entry, so words are chained within blocks and the blocks among
    themselves: the cost is linear but for one reference to each block before. Where a block begins, the
    hash is the chain of the blocks before, whatever follows.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(words) / _BLOCK).cast("int")), lambda b: F.slice(words, b * _BLOCK + 1, _BLOCK))
    step = lambda a, w: F.array_append(a, F.xxhash64(F.element_at(a, -1), w))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    grown = lambda acc, b: F.struct(F.xxhash64(acc["at"], b).alias("at"), F.array_append(acc["out"], F.aggregate(b, F.array(acc["at"]), step)).alias("out"))
    return F.aggregate(blocks, start, grown, lambda acc: F.flatten(F.transform(acc["out"], lambda x: F.slice(x, 1, _BLOCK))))


def _variants(words: Column) -> Column:
    """Hashes of (place, words before, words behind), with the word at the place left out or none."""
    n, ahead, behind = F.size(words), F.col("_ahead"), F.col("_behind")
    key = lambda i, skip: F.xxhash64(i, F.get(ahead, i), F.get(behind, n - i - skip))
    return F.concat(F.transform(F.sequence(F.lit(0), n - 1), lambda i: key(i, 1)), F.transform(F.sequence(F.lit(0), n), lambda i: key(i, 0)))


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one word edit apart."""
    na, nb = F.size(a), F.size(b)
    short = F.least(na, nb)
    same = F.array_position(F.transform(F.sequence(F.lit(0), short), lambda i: (i < short) & (F.get(a, i) == F.get(b, i))), False).cast("int") - 1
    rest = lambda x, n, skip: F.slice(x, same + 1 + skip, F.greatest(n - same - skip, F.lit(0)))
    one = F.lit(1)
    return (
        F.when(na == nb, (same >= na) | (rest(a, na, one) == rest(b, nb, one)))
        .when(na == nb + 1, rest(a, na, one) == rest(b, nb, F.lit(0)))
        .when(nb == na + 1, rest(a, na, F.lit(0)) == rest(b, nb, one))
        .otherwise(False)
    )


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """``(_id, _th, _removed array<int>)`` of each document that loses lines (numbers from 0).

    ``_th`` is the hash of the text: rows that share an id are told apart by it, and rows that share both
    are one document (each copy of it loses the same lines). Texts are read to hash their lines and again
    for candidate lines; only hashes, numbers and candidate lines are shuffled.
    """
    if min_words < 2:
        raise ValueError("one edit makes any two lines of one word equal: min_words must be 2 or more")
    work = Workspace(docs.sparkSession, "linededup")
    text, order = F.col(text_col), F.struct("_id", "_th", "_line")
    base = docs.filter(text.isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    lines = base.select("_id", "_th", F.posexplode(F.split(_folded(F.col("_text")), "\n")).alias("_line", "_s"))
    lines = lines.select("_id", "_th", "_line", F.trim("_s").alias("_x")).filter("_x <> ''").withColumn("_n", _count(F.col("_x")))
    n, x = F.col("_n"), F.col("_x")
    # Of two lines with n and n or n + 1 words, floor(n / 2) words at either end are equal. For longer lines
    # the half is rounded down to fours, so that most lines have the same half for both lengths.
    half = lambda k: F.when(k < 16, F.floor(k / 2)).otherwise(4 * F.floor(k / 8)).cast("int")
    upper, lower = half(n), half(n - 1)
    halves = [_half(x, upper, last) for last in (False, True)] + [F.when(lower != upper, _half(x, lower, last)) for last in (False, True)]
    lines = work.stage(lines.select("_id", "_th", "_line", *_same(x), *[F.when(n >= min_words, h).alias(f"_k{k}") for k, h in enumerate(halves)]), "lines")
    distinct = lines.groupBy("_h", "_g").agg(F.min(order).alias("_first"), F.count("*").alias("_seen"), *[F.min(f"_k{k}").alias(f"_k{k}") for k in range(4)])
    distinct = work.stage(distinct, "distinct")

    keyed = distinct.select("_h", F.explode(F.array_compact(F.array(*[f"_k{k}" for k in range(4)]))).alias("_key"))
    shared = work.stage(_shared(keyed, "_key"), "halves")
    asked = keyed.join(small(shared, 16), "_key", "left_semi").select("_h").distinct()
    wanted = distinct.join(asked, "_h", "left_semi").select("_first._id", "_first._th", F.col("_first._line").alias("_line"))
    wanted = work.stage(wanted.groupBy("_id", "_th").agg(F.collect_set("_line").alias("_lines")).withColumnsRenamed({"_id": "_i", "_th": "_t"}), "wanted")
    found = base.join(small(wanted, 48, 4 * F.size("_lines")), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")))
    # The text is split once (a column that is used twice is not computed again) and no row carries all its lines.
    found = found.withColumn("_all", F.split("_text", "\n"))
    line = lambda i: F.struct(i.alias("_line"), F.get("_all", F.least(i, F.size("_all") - 1)).alias("_s"))
    found = found.select("_id", "_th", F.explode(F.transform("_lines", line)).alias("_z")).select("_id", "_th", "_z._line", "_z._s")
    found = found.select(order.alias("_o"), F.trim(_folded(F.col("_s"))).alias("_x"))
    # Rows that share id and text bring the same lines: one of each stays.
    found = work.stage(found.select(*_same(x), "_o", "_x").dropDuplicates(["_h", "_g"]), "candidates").withColumn("_w", F.split("_x", " "))

    chains = found.withColumn("_ahead", _chain(F.col("_w"))).withColumn("_behind", _chain(F.reverse("_w")))
    variants = work.stage(chains.select("_h", F.explode(_variants(F.col("_w"))).alias("v")), "variants")
    met = variants.join(small(work.stage(_shared(variants, "v"), "shared"), 16), "v", "left_semi")
    met = work.stage(met.join(found.select(F.col("_h").alias("fh"), "_o"), F.col("_h") == F.col("fh")).select("v", "_o", "_h"), "met")
    work.drop("variants")
    heads = met.groupBy("v").agg(F.min(F.struct("_o", "_h")).alias("head")).withColumnRenamed("v", "hv")
    pairs = met.join(heads, F.col("v") == F.col("hv")).filter(F.col("head._o") < F.col("_o"))
    pairs = pairs.select(F.col("_h").alias("a"), F.col("head._h").alias("b")).distinct()
    own = found.select(F.col("_h").alias("ha"), F.col("_g").alias("ga"), F.col("_o").alias("oa"), F.col("_w").alias("wa"))
    other = found.select(F.col("_h").alias("hb"), F.col("_o").alias("ob"), F.col("_w").alias("wb"))
    verified = pairs.join(own, F.col("a") == F.col("ha")).join(other, F.col("b") == F.col("hb")).filter((F.col("ob") < F.col("oa")) & within_one(F.col("wa"), F.col("wb")))
    near = work.stage(verified.select(F.col("ha").alias("nh"), F.col("ga").alias("ng")).distinct(), "near")

    marked = distinct.join(near, (F.col("_h") == F.col("nh")) & (F.col("_g") == F.col("ng")), "left").filter("_seen > 1 OR nh IS NOT NULL")
    marked = marked.select(F.col("_h").alias("mh"), F.col("_g").alias("mg"), "_first", F.col("nh").isNotNull().alias("near"))
    gone = lines.join(marked, (F.col("_h") == F.col("mh")) & (F.col("_g") == F.col("mg"))).filter(F.col("near") | ~order.eqNullSafe(F.col("_first")))
    out = work.stage(gone.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("_line")).alias("_removed")), "removed")
    work.keep("removed")
    return out


def _shared(keyed: DataFrame, key: str) -> DataFrame:
    """Keys that at least two different lines (``_h``) have."""
    return keyed.groupBy(key).agg(F.min("_h").alias("lo"), F.max("_h").alias("hi")).filter("lo < hi").select(key)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """``docs`` with the kept lines as text, ``n_lines`` (before, long) and ``removed_lines array<int>``.

    All rows and columns stay, whatever their names (input columns named as the two new ones are replaced).
    Null text stays null, an empty text empty; a text all of whose lines went is empty. Null ids order first.
    Rows that share id and text lose the same lines. Empty table: empty result. Documents that lose lines are
    broadcast if they are few, else both sides are shuffled by id.
    """
    df, names = hide(docs)
    id_, text = names[id_col], F.col(names[text_col])
    gone = removed_lines(df, id_, names[text_col], min_words).withColumnsRenamed({"_id": "_gi", "_th": "_gt"})
    df = df.join(small(gone, 48, 4 * F.size("_removed")), F.col(id_).eqNullSafe(F.col("_gi")) & (F.xxhash64(text) == F.col("_gt")), "left")
    df = df.withColumn("_ls", F.split(text, "\n"))  # a column of its own, so that no lambda splits again
    lines = F.col("_ls")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
    left = F.when(F.col("_removed").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    removed = F.coalesce("_removed", F.array().cast("array<int>"))
    before = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    df = df.select(*[c for c in names.values() if c != names[text_col]], left.alias(names[text_col]), before.alias("_before"), removed.alias("_gone"))
    stay = {c: h for c, h in names.items() if c not in ("n_lines", "removed_lines")}
    return show(df, stay, F.col("_before").alias("n_lines"), F.col("_gone").alias("removed_lines"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, s, w, array_to_string(w, ' ') AS x FROM (
    SELECT doc_id, i, s, regexp_extract_all(lower(s), '[^\x20\x09-\x0D]+') AS w FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
      FROM documents WHERE text IS NOT NULL))),
e AS (SELECT x, any_value(w) AS w, min((doc_id, i)) AS o FROM l WHERE len(w) > 0 GROUP BY x),
d AS (SELECT * FROM e WHERE len(w) >= 5),
v AS (SELECT x, o, k, array_to_string(list_concat(w[1:k - 1], w[k + 1:]), ' ') AS y FROM (SELECT x, o, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
near AS (
  SELECT a.x FROM v a JOIN v b ON a.k = b.k AND a.y = b.y WHERE b.o < a.o
  UNION SELECT a.x FROM v a JOIN d b ON a.y = b.x WHERE b.o < a.o
  UNION SELECT a.x FROM d a JOIN v b ON a.x = b.y WHERE b.o < a.o),
m AS (SELECT l.doc_id, l.i, l.s, len(l.w) > 0 AND (near.x IS NOT NULL OR e.o <> (l.doc_id, l.i)) AS gone
      FROM l LEFT JOIN e ON l.x = e.x LEFT JOIN near ON l.x = near.x)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       md5(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_md5
FROM m GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
