"""From documents to packed training sequences: quality, exact dedup, near-dup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. Columns that documents may have
besides doc_id and text are carried through; a missing one of doc_id, text or source counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import exact_dedup, mixing, ngram_join, packing, quality
from lathe.llm.common import materialize, table


def whole_text() -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def long_id() -> Column:
    return F.col("doc_id").cast("long")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (predicted 1). The label depends on the text alone; decisions are joined by doc_id and a hash of the text, so rows with equal or null ids are told apart."""
    keyed = docs.withColumn("__key", F.sha2(whole_text().cast("binary"), 256))
    scored = quality.score_documents(keyed, table(spark, sf_dir, "labels"), carry=["__key"])
    bad = scored.where("predicted = 0").select(F.col("doc_id").alias("__id"), F.col("__key").alias("__bad")).distinct()
    return keyed.join(bad, F.col("__key").eqNullSafe(F.col("__bad")) & long_id().eqNullSafe(F.col("__id")), "left_anti").drop("__key")


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased) stays: that with the largest doc_id, and of its repeated rows one. Null ids come last."""
    keyed = docs.withColumn("__key", F.sha2(exact_dedup.lower_ascii(whole_text()).cast("binary"), 256))
    best = exact_dedup.dedup(docs, "largest").where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept")).distinct()
    rows = keyed.join(best, (F.col("__key") == F.col("__kept")) & long_id().eqNullSafe(F.col("__id")), "left_semi")
    return rows.dropDuplicates(["__key"]).drop("__key")


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id, of null or repeated ids that with the least hash.

    The join gets a 64-bit hash of doc_id and text in place of the id, so groups are told apart whatever the ids are. Null ids come last; of equal rows one stays.
    """
    keyed = docs.withColumn("__key", F.xxhash64(long_id(), whole_text()))
    found = ngram_join.ngram_join(keyed.select(F.col("__key").alias("doc_id"), "text"))
    groups = found.groupBy(F.col("doc_id").alias("__key")).agg(F.min("component_id").alias("group"))
    ids = keyed.groupBy("__key").agg(F.min(long_id()).alias("id"))
    best = groups.join(ids, "__key").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "__key")).alias("best"))
    rows = keyed.join(best.select("best.__key"), "__key", "left_semi")
    return rows.dropDuplicates(["__key", "doc_id", "text"]).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order. A copy that the mix cuts stays whole if half or more of its words are taken; documents without words stay once.

    Only short rows are mixed, under a 128-bit hash of all columns; whole rows (rows that are equal in every column: one of them) are joined to the positions once.
    """
    hashes = [F.xxhash64(F.lit(k), *docs.columns).alias(f"__{k}") for k in (0, 1)]
    rows = docs.select(F.struct(*docs.columns).alias("row"), *hashes).groupBy("__0", "__1").agg(F.any_value("row").alias("row"))
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    mixed = mixing.mix(docs.select("doc_id", "text", source.alias("source"), *hashes), carry=["__0", "__1"])
    each = mixed.select("row", "size", F.explode("epochs").alias("e")).where(F.col("e.words") * 2 >= F.col("size")).select(F.col("e.position").alias("position"), "row")
    each = each.union(mixed.where("size = 0").select(F.lit(2.0).alias("position"), "row")).select("position", "row.*")
    placed = materialize(rows.join(each, ["__0", "__1"]).select("position", "row"), "pipeline-mixed")
    return placed.repartitionByRange("position", "row.doc_id").sortWithinPartitions("position", "row.doc_id").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_filter),
    ("near_dup", near_filter),
    ("mixing", mix),
    ("packing", pack),
]

#: Stages with a learned classifier, differencing and a tokenizer can't be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
