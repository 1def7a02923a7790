"""One query per operator over the given tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm import (
    byte_bpe, embedding_dedup, exact_dedup, fill_in_middle, language_id, minhash, mixing, quality_classifier, quality_rules, secret_scan, token_counts, warc_fixity,
    whitening,
)
from sojourn.session import scratch_dir

PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Workers need the package; where it is not installed, they find it beside the driver's.
    spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id") -> Column:
    """The language classifier holds out documents of remainder 2."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def language_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    return language_id.fit(docs.filter(~(fold().eqNullSafe(F.lit(2))) & F.col("lang").isNotNull()))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_classifier.classify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.col("votes")[name].alias(f"vote_{name}") for name in quality_classifier.labellers()], "posterior", "score", "good", F.col("good").alias("kept"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_dictionaries(docs))
    return found.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of this run alone, so that every distinct text is encoded.
    counts = token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_dir(spark, "token-cache"),
        by_word=True, normalise=token_counts.squeeze_spaces,
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


MIXED = ["mix_source", "mix_lang", "mix_topic"]


def mixed(docs: DataFrame, repeats: bool = True) -> DataFrame:
    """Documents with their sampling decision; raked to smoothed shares of sources, languages and topics."""
    tokens = mixing.token_count(F.col("text"))
    labels = [F.col("source"), F.col("lang"), mixing.layout_topic(F.col("text"), tokens)]
    return mixing.mix(docs, dict(zip(MIXED, labels)), tokens, repeats=repeats)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", *MIXED, "n_tokens", "weight", "rate", "probability", "copies", "kept")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages against a replica in which some bodies are altered and some records are overwritten."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    one = warc_fixity.archive(pages)
    altered = F.when(F.col("page_id") % 97 == 5, F.translate("html", "e", "3")).otherwise(F.col("html"))
    two = warc_fixity.archive(pages.withColumn("html", altered))
    lost = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint"), F.lit(89)) == 1
    return warc_fixity.audit(one, two.filter(~lost))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository is a source and language, an owner a source."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, F.concat_ws("/", "source", "lang"), "source")
    named = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("bigint")

    return found.select(
        "doc.doc_id", *[count("kind", kind).alias(f"n_{kind}") for kind in secret_scan.KINDS], F.sha2(named, 256).alias("base_sha256"),
        named.alias("spans"), count("verdict", "live").alias("n_live"), count("verdict", "example").alias("n_example"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.array_join("failed_rules", ",").alias("failed_rules"), "kept",
    )


def digested(docs: DataFrame) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, decoded_col="decoded", keep=["doc_id"])
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"), scratch_dir(spark, "cuckoo-index"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), keep=["doc_id"])
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_quality_classifier": op1, "op2_language_id": op2, "op3_token_counts": op3, "op4_mixing": op4, "op5_warc_fixity": op5,
    "op6_secret_scan": op6, "op7_embedding_dedup": op7, "op8_quality_rules": op8, "op9_byte_bpe": op9, "op10_minhash_dedup": op10,
    "op11_embedding_whitening": op11, "op12_exact_dedup": op12, "op13_fill_in_middle": op13,
}

ORACLES: dict[str, str] = {
    "op12_exact_dedup": """
      WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
      SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
        doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
      FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op13_fill_in_middle": r"""
      WITH units AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
          regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
        FROM documents),
      drawn AS (
        SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS two,
          CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
            WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM units),
      cut AS (
        SELECT doc_id, text, n, form, array_to_string(u[1:least(one, two)], '') AS p,
          array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS m, array_to_string(u[greatest(one, two) + 1:], '') AS s
        FROM drawn)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
        sha256(text) AS restored_sha256
      FROM cut""",
}
