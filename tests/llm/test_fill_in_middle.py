"""Fill-in-middle against a plain loop and DuckDB, and back to the texts."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from sojourn.llm import fill_in_middle, queries
from workload.check import compare, connect

SF = "/root/testdata/sf0.001"


def brute(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_awkward_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "\n\t", "one", " one", "one ", "a<P>b", "<S", "x <M> y", "\x1f\xa0 \x00 z", "é" * 70_000, "w " * 300_000]
    texts += ["".join(rng.choice(" \t\nab é你\x0c🎉<PSM>") for _ in range(rng.randrange(40))) for _ in range(600)]
    rows = [(i, t, "f", "o", i, "dot") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "no id here", None, None, None, None), (4, "one id, another text", "f", "o", 4, "dot")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, output string, row bigint, `a.b` string")
    cut = fill_in_middle.fill_in_middle(docs)
    assert cut.columns == ["doc_id", "text", "row", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = cut.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    forms = {r.form: r["count"] for r in fill_in_middle.fill_in_middle(docs, seed=7, rate=90, spm=20).groupBy("form").count().collect()}
    assert 320 < forms["plain"] < 480 and 600 < forms["spm"] < 840


def test_empty(spark):
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query(spark):
    assert compare(queries.QUERIES["op13_fill_in_middle"](spark, SF), connect(SF), queries.ORACLES["op13_fill_in_middle"]).startswith("ok 200")
