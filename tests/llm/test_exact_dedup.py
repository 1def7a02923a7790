"""The cuckoo index against dictionaries, and its filters on their own."""

from __future__ import annotations

import hashlib
import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sojourn.llm import exact_dedup, queries
from sojourn.llm.cuckoo import CuckooFilter, keys
from sojourn.llm.exact_dedup import CuckooIndex
from sojourn.sources import versions
from workload.check import compare, connect

SF = "/root/testdata/sf0.001"


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append(doc_id)
    found = []
    for doc_id, text in rows:
        ids = [i for i in groups[normal(text)] if i is not None]
        keep = max(ids, default=None)
        found.append((doc_id, keep, len(groups[normal(text)]), doc_id == keep, hashlib.sha256(normal(text).encode()).hexdigest()))
    return sorted(found, key=repr)


def reported(index):
    return sorted((tuple(r) for r in index.report().collect()), key=repr)


def live(index):
    """Fingerprints in all filters."""
    return sum(CuckooFilter.from_bytes(bytes(r.payload)).count() for r in index._read("filters", exact_dedup.FILTERS).collect())


def test_filter_inserts_grows_and_deletes():
    digests = [os.urandom(32) for _ in range(20_000)]
    hashes, prints = keys(digests)
    made = CuckooFilter.build(hashes, prints)
    assert made.contains(hashes, prints).all() and made.count() == len(digests)
    other = keys([os.urandom(32) for _ in range(50_000)])
    assert made.contains(*other).mean() < 0.001
    made.remove(hashes[:9000], prints[:9000])
    assert made.count() == 11_000 and made.contains(hashes[9000:], prints[9000:]).all() and made.contains(hashes[:9000], prints[:9000]).mean() < 0.001
    again = CuckooFilter.from_bytes(made.to_bytes())
    assert (again.table == made.table).all()
    assert not CuckooFilter(16).insert(hashes[:80], prints[:80])  # 64 slots
    full = CuckooFilter(1024)
    assert full.insert(hashes[:3800], prints[:3800]) and full.contains(hashes[:3800], prints[:3800]).all()  # 93 % by moving others


def test_awkward_rows(spark, tmp_path):
    rows = [(i, t, "d", 1, "s", "x") for i, t in enumerate([None, "", " ", "Abc", "aBC", "abc ", "ÄB", "äb", "ÄB", "i", "I", "İ", "x" * 300_000, "X" * 300_000, "z" * 50])]
    rows += [(3, "ABC", "d", 1, "s", "x"), (3, "ABC", "d", 1, "s", "x"), (None, "abc", None, None, None, None), (None, "only here", None, None, None, None), (14, "other text", "d", 1, "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string, n_bytes int, shard string, `a.b` string").repartition(3)
    found = exact_dedup.mark_duplicates(docs, str(tmp_path / "index"), shards=4)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute([r[:2] for r in rows])
    assert exact_dedup.mark_duplicates(docs.limit(0), str(tmp_path / "empty")).count() == 0


def test_batches_deletions_and_overflow(spark, tmp_path):
    """Small first filters must grow by the stored keys; a deleted digest is absent, and live again when it returns."""
    rng = np.random.default_rng(4)
    index, rows = CuckooIndex(spark, str(tmp_path / "index"), shards=2), []

    def insert(new, load):
        for _ in range(2):  # the second time changes nothing
            index.insert(spark.createDataFrame(new, "doc_id bigint, text string").repartition(4), load_id=load)
        rows.extend(new)

    def check():
        assert reported(index) == brute(rows)
        assert live(index) == len({normal(t) for _, t in rows})

    insert([(i, f"Text {rng.integers(60)}") for i in range(100)], "a")
    check()
    small = versions.current(spark, index.path)
    insert([(i, f"text {rng.integers(3000)}") for i in range(100, 1500)], "b")
    check()
    assert versions.current(spark, index.path).number == small.number + 1
    gone = set(range(50, 1500, 2))
    index.delete(spark.createDataFrame([(i,) for i in gone] + [(None,), (9999,)], "doc_id bigint"))
    deleted = {normal(t) for i, t in rows if i in gone}
    rows[:] = [r for r in rows if r[0] not in gone]
    check()
    asked = spark.createDataFrame([(t,) for t in sorted(deleted)] + [("never seen",), (rows[0][1],)], "text string")
    found = {bytes(r.digest): r.live for r in index.may_hold(asked).collect()}
    held = {normal(t) for _, t in rows}
    for text in [*deleted, "never seen", normal(rows[0][1])]:
        assert found[hashlib.sha256(text.encode()).digest()] == (text in held)
    insert([(5000 + k, t.upper()) for k, t in enumerate(sorted(deleted - held)[:40])], "c")
    check()


def test_false_hits_enter_the_filter(spark, tmp_path, monkeypatch):
    """With filters that say yes to everything, verification alone decides and no digest is lost."""
    index = CuckooIndex(spark, str(tmp_path / "index"), shards=1)
    rows = [(i, f"t{i % 30}") for i in range(40)]

    def all_hits(batches):
        for batch in batches:
            part = batch.filter(pc.equal(batch.column(1), exact_dedup.INSERT))
            yield pa.RecordBatch.from_arrays([*part.columns[2:6], pa.array([True] * len(part))], ["digest", "n_bytes", "n", "top", "hit"])

    monkeypatch.setattr(exact_dedup, "_probe", all_hits)
    index.insert(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2))
    monkeypatch.undo()
    assert reported(index) == brute(rows) and live(index) == 30


def test_failed_insert_leaves_the_index(spark, tmp_path, monkeypatch):
    index = CuckooIndex(spark, str(tmp_path / "index"))
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id bigint, text string")
    index.insert(docs, load_id="one")
    with monkeypatch.context() as patch:
        patch.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("stop")))
        with pytest.raises(RuntimeError, match="stop"):
            index.insert(docs.withColumn("doc_id", F.col("doc_id") + 10), load_id="two")
    assert reported(index) == brute([(1, "a"), (2, "A"), (3, "b")])
    index.insert(docs.withColumn("doc_id", F.col("doc_id") + 10), load_id="two")
    assert reported(index) == brute([(1, "a"), (2, "A"), (3, "b"), (11, "a"), (12, "A"), (13, "b")])


def test_query(spark):
    assert compare(queries.QUERIES["op12_exact_dedup"](spark, SF), connect(SF), queries.ORACLES["op12_exact_dedup"]).startswith("ok 200")
