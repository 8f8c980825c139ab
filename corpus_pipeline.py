"""From documents to packed training sequences, in five stages.

``run`` writes what each stage returns to the shared folder and hands it, reread, to the next. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import linededup, mixing, packing, quality_gam, simhash
from vecspark.llm.queries import LEVELS, WEIGHTS, domain, tokens_by_source
from vecspark.llm.shared import Workspace, hide, show, swept

#: The packing's end of a document, its capacity, and the vocabulary in which budgets and sequences are counted.
END_ID, CAPACITY, VOCABULARY = 1, 4096, "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null and empty texts have a score as any other; repeated rows go or stay alike; null ids are scored, only
    not learned from; without a usable label all stay (a score of 0.5).
    """
    return quality_gam.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; those all of whose lines went are left out, ``n_chars`` follows the text.

    Null and empty texts stay. Of repeated lines that of the smallest id stays (null first); rows that share id
    and text lose the same lines.
    """
    df, names = hide(docs)
    text, n = names["text"], names["n_chars"]
    kept = linededup.dedup_lines(df, names["doc_id"], text)
    gone = (F.size("removed_lines") > 0) & ~F.col(text).rlike(r"[^\x20\x09-\x0D]")
    kept = kept.filter(~F.coalesce(gone, F.lit(False)))
    n_chars = F.when(F.size("removed_lines") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n))
    return show(kept.withColumn(n, n_chars), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, with the smallest id: similarity of 0.8 or more of five-word shingles.

    Null texts and those without a word are copies of each other. Of a group without an id, or rows that share
    the smallest id, the least text stays.
    """
    groups = Workspace(spark, "groups").stage(simhash.near_duplicates(docs, shingle=5, least=0.8, roots=True), "groups")
    return simhash.one_of_each(docs, groups)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their domain, language and source; a document may come twice.

    Null languages and sources are children of their own; a null text has no tokens, and a leaf without tokens
    is left out. Tokens are those that the packing counts.
    """
    work = Workspace(spark, "mix")
    chosen = mixing.plan(tokens_by_source(docs, work, VOCABULARY, frugal=True), LEVELS, mixing.weights(WEIGHTS, LEVELS), 1.0, 2, 11, "doc_id", "n_tokens", work)
    work.keep("plan")
    df, names = hide(docs)
    leaf = [domain(names["source"]), F.col(names["lang"]), F.col(names["source"])]
    return show(mixing.epochs_of(df, chosen, LEVELS, 11, names["doc_id"], leaf), names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with the sequence and the offset of each.

    A null or empty text is one piece that holds the end; repeated rows each have their own pieces.
    """
    import public_tokenizers

    pieces = packing.token_pieces(docs, public_tokenizers.path(VOCABULARY), capacity=CAPACITY, end_id=END_ID, frugal=True)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest, capacity=CAPACITY)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing sources", mix), ("best-fit packing", pack)]

#: The classifier, the mixing and the packing can't be said in SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over the whole table of documents. Only these stay in the shared folder."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with swept():
            docs = work.stage(stage(spark, docs, sf_dir), f"stage{k}")
        work.keep(f"stage{k}")
    return docs
