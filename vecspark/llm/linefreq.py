"""Quality rules: base measures of each text, and cross-document line frequency per host.

DataFrame operations only. A document is one row of the input (rows that share an id are documents of
their own, told apart by a row number fixed when the measures are written).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import Workspace, small

#: White space of the rules, as a pattern; words are what lies between.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _windows(words: Column) -> Column:
    """A 64-bit hash of every run of eight words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n >= WINDOW, runs).otherwise(F.array().cast("array<bigint>"))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base measures ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and ``_lines``.

    Repeats within a text: windows are sorted by hash, those with an equal neighbour are taken by
    position, and the words that they cover are counted from the gaps between positions; that is
    n log n in the words of the text. Texts without a repeated window skip it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_words", words_of(text)).withColumn("_lines", lines)
    df = df.withColumn("_grams", _windows(F.col("_words")))
    repeated = F.size(F.array_distinct("_grams")) < F.size("_grams")
    at = F.transform(F.col("_grams"), lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    df = df.withColumn("_sorted", F.when(repeated, F.array_sort(at)))
    h = lambda k: F.get(F.col("_sorted"), k)["h"]
    twice = F.filter(F.transform(F.col("_sorted"), lambda x, k: F.when((x["h"] == h(k + 1)) | ((k > 0) & (x["h"] == h(F.greatest(k - 1, F.lit(0))))), x["p"])), lambda p: p.isNotNull())
    df = df.withColumn("_at", F.array_sort(twice))
    gaps = F.transform(F.col("_at"), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    return df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).drop("_words", "_grams", "_sorted", "_at")


def line_frequency(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.02, min_docs: int = 5, min_words: int = 20, min_left: float = 0.3) -> DataFrame:
    """Base measures and verdict of every document, with the lines to remove.

    Lines are normalised (lower case, runs of white space as one space) and hashed; a line that stands
    in more than ``max(min_docs, max_share * documents of the host)`` distinct documents of its host is
    removed from each of them. ``base_failed``: fewer than ``min_words`` words, or over 30 % of words in
    repeated windows. ``kept``: not ``base_failed``, and what is left has ``min_words`` words and
    ``min_left`` of the words.

    Result: ``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_lines long, n_left_words long, removed_lines array<int>`` (numbers of the lines that hold a
    word, from 0). Null text: no words, so it fails. Null hosts are one host. Empty table: empty result.

    The text is read once; hashes and word counts of its lines are written to the shared folder, and only
    those are shuffled. Counts are combined before the shuffle, so a very common line is no hot key. The
    frequent lines (at most ``1 / max_share`` lines of each host's documents) are broadcast if small.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "linefreq")
    flat = docs.select(F.col(id_col).alias("_id"), F.col(host_col).cast("string").alias("_host"), F.col(text_col).alias("_text"))
    own = measures(flat, "_text")
    words = F.transform("_lines", words_of)
    own = own.withColumn("_lw", words)
    own = own.select(
        F.monotonically_increasing_id().alias("_row"), "_id", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.transform("_lw", lambda w: F.xxhash64(F.lower(F.array_join(w, " ")))).alias("_hash"), F.transform("_lw", lambda w: F.size(w)).alias("_n"),
    )
    held = work.stage(own, "measures")
    hosts = held.groupBy("_host").agg(F.count("*").alias("_docs"))
    seen = held.select("_host", F.explode(F.array_distinct("_hash")).alias("_hash")).groupBy("_host", "_hash").agg(F.count("*").alias("_in"))
    seen = seen.filter(F.col("_in") > min_docs)
    over = seen.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
    over = over.filter(F.col("_in") > F.greatest(F.lit(float(min_docs)), F.lit(max_share) * F.col("_docs")))
    frequent = small(work.stage(over.select(F.col("_host").alias("_fh"), F.col("_hash").alias("_fx")), "frequent"), 64)
    lines = held.select("_row", "_host", F.posexplode(F.arrays_zip("_hash", "_n")).alias("_line", "_z"))
    cut = lines.join(frequent, F.col("_host").eqNullSafe(F.col("_fh")) & (F.col("_z._hash") == F.col("_fx")))
    cut = cut.groupBy("_row").agg(F.sum("_z._n").alias("_cut"), F.sort_array(F.collect_list("_line")).alias("_removed"))
    out = held.drop("_hash", "_n").join(cut, "_row", "left")
    left = F.col("n_words") - F.coalesce("_cut", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    removed = F.coalesce("_removed", F.array().cast("array<int>"))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"),
        F.size(removed).cast("long").alias("n_removed_lines"), left.alias("n_left_words"), removed.alias("removed_lines"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 6)) AS p, w FROM d WHERE len(w) >= 8),
g2 AS (SELECT r, p, count(*) OVER (PARTITION BY r, array_to_string(w[p:p + 7], ' ')) AS n FROM g),
c AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(p, p + 8)) FROM g2 WHERE n > 1) GROUP BY r),
lines AS (SELECT r, source, unnest(l) AS line FROM d),
norm AS (SELECT r, source, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS x,
                len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY source),
freq AS (SELECT norm.source, x FROM norm JOIN hosts ON norm.source IS NOT DISTINCT FROM hosts.source
         GROUP BY norm.source, x, docs HAVING count(DISTINCT r) > greatest(5.0, 0.02 * docs)),
cut AS (SELECT r, sum(n) AS n, count(*) AS k FROM norm JOIN freq ON norm.source IS NOT DISTINCT FROM freq.source AND norm.x = freq.x GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             coalesce(cut.k, 0)::BIGINT AS n_removed_lines, (len(w) - coalesce(cut.n, 0))::BIGINT AS n_left_words
      FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN cut ON d.r = cut.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_left_words >= 20 AND n_left_words >= 0.3 * n_words AS kept, n_removed_lines, n_left_words
FROM b
"""
