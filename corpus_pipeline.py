"""A training corpus in five stages, each of which reads what the one before has written.

Toxic documents go; of near-duplicates one stays; secrets are masked in the text; sources, languages and topics are
sampled to target weights, each document at most once and the others in its place; what is left is tokenized and packed into sequences. All
stages but the last return the columns of `documents`. A missing text passes the first stages as an empty one does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demoflux.llm import mixing, near_dup, packing, secret_scan, toxicity
from demoflux.llm.common import store, table


def apart(docs: DataFrame, *used: str) -> DataFrame:
    """The columns an operator reads, and the whole row beside them, so that its own columns can't replace the row's."""
    return docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__document"))


def whole(rows: DataFrame) -> DataFrame:
    return rows.select("__document.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.query_model(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return whole(toxicity.score_toxicity(apart(docs, "text"), model).filter("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return whole(near_dup.keep_one(apart(docs, "doc_id", "text")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets stay; their text has a mark instead, and n_chars is counted anew."""
    found = secret_scan.scan_secrets(apart(docs, "text")).withColumn("text", secret_scan.mask(F.col("text"), "secret_spans"))
    changed = F.size("secret_spans") > 0
    row = F.col("__document").withField("text", F.col("text")).withField("n_chars", F.when(
        changed, F.length("text").cast("long")).otherwise(F.col("__document.n_chars")))
    return whole(found.withColumn("__document", row))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a token weigh nothing and are not drawn."""
    return whole(mixing.query_mix(apart(docs, "doc_id", "source", "lang", "text"), once=True).filter("copies > 0"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing_query(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the signatures and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
