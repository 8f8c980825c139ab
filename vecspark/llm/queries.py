"""The queries of this subpackage: one for each operation, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import adaptive_scan, linededup, linefreq, mixing, packing, quality_gam, sharding, simhash, tokencount, tokenfile
from vecspark.llm.shared import Workspace


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), limit=512)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest, capacity=4096)


#: Arrivals that the documents are dealt to, by a hash of their id.
ARRIVALS = 12


def arrived(spark: SparkSession, docs: DataFrame) -> sharding.ShardStore:
    """A store to which the documents came in ``ARRIVALS`` arrivals."""
    store = sharding.ShardStore(spark, f"{Workspace(spark, 'shards').path}/documents")
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    return store


def op3_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of documents, compacted; each document as it is read back from the latest version."""
    store = arrived(spark, _table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum(grace_s=0)  # this query is the store's only writer
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text).alias("text_md5"))


OP3_ORACLE = """
SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, md5(coalesce(text, '')) AS text_md5 FROM documents
"""


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.line_frequency(_table(spark, sf_dir, "documents")).drop("removed_lines")


def op5_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "tokenfiles")
    tokenfile.write_token_files(_table(spark, sf_dir, "documents"), f"{work.path}/ids", _vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read_token_files(spark, f"{work.path}/ids")


#: The tree of sources, and the weights of its nodes (1 where there is none).
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0, "domain3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def domain(source: str = "source") -> Column:
    """The documents name no domain: sources are dealt to four by their checksum."""
    return F.concat(F.lit("domain"), (F.crc32(F.encode(F.coalesce(source, F.lit("")), "utf-8")) % 4).cast("string"))


def tokens_by_source(docs: DataFrame, work: Workspace, vocabulary: str = "byte_bpe_50k.json", frugal: bool = False) -> DataFrame:
    """Id, leaf and token count of every document, written: texts are encoded once."""
    own = docs.select("doc_id", "text", domain().alias("domain"), "lang", "source")
    counted = tokencount.token_counts(own, _vocabulary(vocabulary), also=tuple(LEVELS), frugal=frugal)
    return work.stage(counted.select("doc_id", *LEVELS, "n_tokens"), "tokens")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokens_by_source(_table(spark, sf_dir, "documents"), Workspace(spark, "mixtokens"))
    return mixing.mix(tokens, LEVELS, mixing.weights(WEIGHTS, LEVELS), budget_share=1.0, max_epochs=2)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_best_fit_packing, op3_size_tiered_shards, op4_line_frequency, op5_adaptive_scan,
        op6_quality_gam, op7_line_dedup, op8_simhash, op9_token_files, op10_mixing,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_size_tiered_shards": OP3_ORACLE, "op4_line_frequency": linefreq.ORACLE, "op7_line_dedup": linededup.ORACLE}
