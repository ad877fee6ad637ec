"""The training-data queries, each over the whole of its table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxtally.llm import cutting_stock, fingerprint, licences, line_templates, near_dedup, neighbours, packing, prefix_trie, sentence_pieces, sharding, substrings, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids of all documents, in as few sequences as best-two-fit needs."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op7_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's pieces, their spans and the decoded text."""
    return sentence_pieces.encode(table(spark, sf_dir, "documents"), digests=True)


@query("op9_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's multiset fingerprint beside that of its edited text and of the next document."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of toxicity."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_minhash_near_dedup", near_dedup.near_duplicates_sql())
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings of smaller ones."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), report=True)


@query("op5_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product for every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.neighbours(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding")


@query("op3_licence_scans", licences.scan_sql())
def licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document and its lines stand for, by canonical digests."""
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op8_sharding")
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot in 16 shards of nearly equal size."""
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op10_line_dedup", line_templates.report_sql())
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the lines of recurring templates."""
    return line_templates.report(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened coordinates on the 16 leading principal components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_conversation_prefix_trie", prefix_trie.trie_sql())
def conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations whose first turns are those of their group's first."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op13_cutting_stock_packing")
def cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids that need no padding."""
    return cutting_stock.pack_documents(table(spark, sf_dir, "documents"))
