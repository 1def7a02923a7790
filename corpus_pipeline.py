"""A corpus pipeline: language ID, near-duplicates, secrets, mixing, tokens.

Each stage takes the documents its predecessor kept and returns documents; the last one returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm import language_id, minhash, queries, secret_scan
from sojourn.session import scratch_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined or leads narrowly; ``lang`` becomes the prediction."""
    found = language_id.identify(docs, queries.language_dictionaries(docs)).filter("accepted")
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at 0.8 on five-word shingles, the one of the smallest id.

    Rows go by id and text: of an id with several texts only those go that are copies of a document of a smaller id. Rows of one
    id and one text are one document, of which the first by all its columns stays; rows without an id stay.
    """
    text = F.col("text").cast("string")
    found = minhash.near_duplicates(docs, words=5, key_col="key")
    gone = found.filter("not kept").select(F.col("doc_id").alias("id"), "key").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(row, F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("key"))
    kept = keyed.join(gone, ["id", "key"], "left_anti")
    twice = kept.filter("id is not null").groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "key")
    single = kept.join(twice, ["id", "key"], "left_anti")
    one = kept.join(twice, ["id", "key"], "left_semi").groupBy("id", "key").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return single.select("doc.*").union(one.select("doc.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking credentials in the texts; no document is dropped."""
    return secret_scan.redact(docs, F.concat_ws("/", "source", "lang"), "source")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards the target shares of sources, languages and topics.

    A document is one row with one id in all stages, so none is repeated here, and rare values that would need repeats
    stay below their targets; ``mixing.gaps`` tells by how much. ``op4_mixing`` gives the copies that meet the targets.
    """
    return queries.mixed(docs, repeats=False).filter("kept").select("doc.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding: one row per document."""
    return queries.digested(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language), ("MinHash near-dedup", drop_near_duplicates), ("secret scan", redact_secrets),
    ("mixing", mix_sources), ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each result is written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_dir(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL cannot express compression classifiers or byte-pair merges.
ORACLE_SQL: str | None = None
