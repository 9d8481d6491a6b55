"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

quality -> near duplicates -> secrets -> mixture -> tokens. All stages but the
last return the columns of their input; extra columns are carried along
untouched, whatever their names. A null id, text, language or source never
ends a stage: see each function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import read_table, stage_table
from ledgerlens.llm.jaccard_join import jaccard_groups
from ledgerlens.llm.mixing import mix
from ledgerlens.llm.quality import THRESHOLD, score_documents
from ledgerlens.llm.secret_scan import redact
from ledgerlens.llm.sentencepiece import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (a null text is scored as an empty one)."""
    name = "score"
    while name in docs.columns:
        name += "_"
    scored = score_documents(spark, docs, docs, read_table(spark, sf_dir, "labels"), name=name)
    return scored.where(F.col(name) >= THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id (rows without an id last), then the smallest hash
    of its text. A document is an id with a text: an id that repeats with another text is another document, and of
    rows that repeat both one stays. Texts without words are linked with nothing, so all their rows stay."""
    groups = jaccard_groups(spark, docs.select("doc_id", "text"))
    first = groups.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("first"))
    kept = stage_table(spark, first.select("first.*").distinct(), "kept")
    wordless = stage_table(spark, groups.where("group is null").select("doc_id", "text_key").distinct(), "wordless")
    key = F.xxhash64("text")
    # Packed, so that no column of the table can clash with the ones added here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", key).alias("id"), key.alias("text_key"),
                       *(c for c in ("lang", "source", "n_chars") if c in docs.columns))

    def among(keys):
        named = keys.select(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", "text_key").alias("id"), "text_key")
        return rows.join(named, ["nameless", "id", "text_key"], "left_semi")
    # Spark keeps the first row of a partition's group before it shuffles.
    once = Window.partitionBy("nameless", "id", "text_key").orderBy(*(c for c in ("lang", "source", "n_chars") if c in docs.columns))
    one = among(kept).withColumn("at", F.row_number().over(once)).where("at = 1")
    return one.select("row").unionAll(among(wordless).select("row")).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, n_chars counted anew where that changed the text."""
    masked = redact(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    changed = ~F.col("text").eqNullSafe(F.col("row.text"))
    n_chars = F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return masked.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


#: Part of all tokens that the mixture keeps; cells too scarce for it are kept whole.
MIX_SHARE = 0.8


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated draw keeps: about ``MIX_SHARE`` of the tokens, whatever the scarcest cell."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", "lang")
    return mix(spark, packed, share=MIX_SHARE).where("kept").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document; null for a null text."""
    return encode(spark, docs.select("doc_id", "lang", "source", "text"), keep_text=False).select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_pieces"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]

#: The classifier, the join's staging and the tokenizer are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(spark, stage(spark, docs, sf_dir), name)
    return docs
