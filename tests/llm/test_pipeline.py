"""The pipeline's stages, each against its own input, and the registered queries on the smallest tables."""

from __future__ import annotations

import gc
import weakref
from pathlib import Path

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from sojourn.llm import byte_bpe, language_id, minhash, queries, worker

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        rows = {r.doc_id: r for r in docs.collect()}
        assert set(rows) <= set(before) and docs.count() == len(rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name in ("language ID", "MinHash near-dedup", "mixing"):
            assert len(rows) >= 0.7 * len(before)
        else:
            assert len(rows) == len(before)
        before = rows
    assert set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_empty_input(spark, tmp_path):
    docs = queries.table(spark, SF, "documents").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k))) if k < 3 else docs


def test_repeated_rows_stay_once(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l"), (None, "m n o p q r"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 2]


def test_rows_go_by_id_and_text(spark):
    """One id with a copy of another document and a text of its own: the copy goes, the other text stays; of equal rows the first does."""
    copy, own = " ".join(f"c{i}" for i in range(40)), " ".join(f"o{i}" for i in range(40))
    rows = [(1, copy, "b"), (2, copy, "a"), (2, own, "a"), (3, f"{own} x", "a"), (4, "alone", "z"), (4, "alone", "y"), (None, copy, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {(1, copy, "b"), (2, own, "a"), (4, "alone", "y"), (None, copy, "a")}


def test_queries_read_whole_tables(spark):
    for name, query in queries.QUERIES.items():
        n = int(name[2:].split("_")[0])
        if n == 5:
            continue
        table, per_row = "embeddings" if n in (7, 11) else "documents", 16 if n == 11 else 1
        assert query(spark, SF).count() == per_row * queries.table(spark, SF, table).count(), name


def test_stages_drop_what_others_left_in_a_worker():
    """Spark reuses workers between stages: the transducer of the last stage must not stay beside the first two stages of a later run."""
    vocabulary = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    texts = pa.array(["one two three four five six", None])
    ids = pa.array([1, 2], pa.int64())
    tasks = [
        (minhash._describe(5), [ids, ids, texts]), (minhash._bitmaps(5), [ids, texts]), (minhash._confirm(5, 80), [ids, ids, texts, texts]),
        (worker.keeping_nothing(language_id._words), [pa.array(["a", "b"]), pa.array(["one", "two"])]),
    ]
    for task, columns in tasks:
        codec = weakref.ref(byte_bpe._codec(vocabulary, public_tokenizers.PATTERN))
        assert codec() is byte_bpe._codec(vocabulary, public_tokenizers.PATTERN)
        assert list(task(iter([pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])])))
        gc.collect()
        assert codec() is None
