"""Exact duplicates through a persistent cuckoo-filter index of live digests.

The index is a versioned folder of three tables: ``rows`` (every live document's id, digest and length), ``filters`` (one cuckoo filter per
shard of the digests) and ``shared`` (digests confirmed to have several documents). A batch is digested in one pass over
its texts, which are not moved. Copies within an Arrow batch are combined, then every remaining entry is
dealt to the shard of its digest and probed there, against the stored filter and against a filter of the batch itself.
An entry without a hit is new for certain. Hits are verified against the content the buckets hold, by the whole SHA-256 and length of
the normalised text; only they are joined. New digests and hits that proved false enter the filters. A filter that overflows is built
anew at a larger size from the stored keys of its shard. Deleting a document removes its digest from the filter with its last live row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from sojourn.llm.arrays import text_blocks
from sojourn.llm.cuckoo import CuckooFilter, keys
from sojourn.session import materialize
from sojourn.sources import versions

#: Shards of a new index. About a million live digests per shard are a comfortable task: 4,096 shards serve 4 billion.
SHARDS = 64
CHUNK = 8192
ROWS = StructType([StructField("doc_id", LongType()), StructField("digest", BinaryType()), StructField("n_bytes", LongType())])
FILTERS = StructType([StructField("shard", IntegerType()), StructField("payload", BinaryType())])
SHARED = StructType([StructField("digest", BinaryType())])
PART = "part"
#: What a row that reaches a shard's task is, in the order in which it is dealt with.
FILTER, STORED, REMOVE, INSERT = range(4)
_IN = {"shard": "int", "kind": "int", "digest": "binary", "n_bytes": "bigint", "n": "bigint", "top": "bigint", "payload": "binary"}
_FLAGGED = "digest binary, n_bytes bigint, n bigint, top bigint, hit boolean"
_ENTRIES = "digest binary, n_bytes bigint, n bigint, top bigint"


def shard_of(digest: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, SHA-256 and length of each text with A-Z lowered; NULL counts as empty."""
    for batch in batches:
        for first, data, rows in text_blocks(batch.column(1)):
            texts = pa.LargeStringArray.from_buffers(len(rows) - 1, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
            body = memoryview(pc.ascii_lower(texts).buffers()[2] or b"")
            digests = [hashlib.sha256(body[a:b]).digest() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)), pa.array(digests, pa.binary()), pa.array(np.diff(rows), pa.int64())], ROWS.names
            )


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_digest, ROWS)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry per digest of an Arrow batch: a hot text sends one row per batch on, not one per copy."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("digest").aggregate([("n_bytes", "max"), ("digest", "count"), ("doc_id", "max")])
        for part in table.to_batches():
            yield pa.RecordBatch.from_arrays([part.column(name) for name in ("digest", "n_bytes_max", "digest_count", "doc_id_max")], ["digest", "n_bytes", "n", "top"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each shard together, from batches in the order of shards."""
    shard, held = None, []
    for batch in batches:
        shards = np.asarray(batch.column(0))
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                if held and shards[a] != shard:
                    yield shard, pa.Table.from_batches(held)
                    held = []
                shard = int(shards[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield shard, pa.Table.from_batches(held)


def _of_kind(rows: pa.Table, kind: int) -> pa.Table:
    return rows.filter(pc.equal(rows["kind"], kind))


def _stored_filter(rows: pa.Table) -> CuckooFilter | None:
    payloads = _of_kind(rows, FILTER)["payload"]
    return CuckooFilter.from_bytes(payloads[0].as_py()) if len(payloads) else None


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with ``hit``: whether the stored filter, or the entries before, may hold their digest."""
    for _, rows in _by_shard(batches):
        stored, entries = _stored_filter(rows), _of_kind(rows, INSERT).combine_chunks()
        if not len(entries):
            continue
        hashes, prints = keys(entries["digest"].to_pylist())
        hit = stored.contains(hashes, prints) if stored else np.zeros(len(hashes), bool)
        seen, own = CuckooFilter(), []
        for low in range(0, len(hashes), CHUNK):
            part = np.arange(low, min(low + CHUNK, len(hashes)))
            part = part[~hit[part]]
            first = np.unique(seen.slot_keys(hashes[part], prints[part]), return_index=True)[1]
            repeated = np.ones(len(part), bool)
            repeated[first] = False
            hit[part] = repeated | seen.contains(hashes[part], prints[part])
            fresh = part[~hit[part]]
            own.append(fresh)
            if len(fresh) and not seen.insert(hashes[fresh], prints[fresh]):
                every = np.concatenate(own)
                seen = CuckooFilter.build(hashes[every], prints[every], 2 * len(seen.table))
        for part in entries.append_column("hit", pa.array(hit)).select(["digest", "n_bytes", "n", "top", "hit"]).to_batches():
            yield part


def _update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The new filter of each shard; no payload if the digests overflow a filter whose stored keys are not among the rows."""
    for shard, rows in _by_shard(batches):
        made = _stored_filter(rows)
        stored, removed, inserted = (keys(_of_kind(rows, kind)["digest"].to_pylist()) for kind in (STORED, REMOVE, INSERT))
        if made is None:
            both = [np.concatenate(pair) for pair in zip(stored, inserted)]
            made = CuckooFilter.build(*both)
        else:
            made.remove(*removed)
            if not made.insert(*inserted):
                made = None
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made and made.to_bytes()], pa.binary())], FILTERS.names)


class CuckooIndex:
    """An index in a folder of shared storage. Every change is one new version; a failed one leaves the last as it was.

    ``shards`` is fixed by the first change; filters grow on their own. One change at a time: a second one raises ``VersionConflict``.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS):
        self.spark, self.path = spark, path.rstrip("/")
        self.shards = versions.current(spark, self.path).info.get("shards", shards)

    def _read(self, part: str, schema: StructType, at: versions.Version | None = None) -> DataFrame:
        return versions.read_parts(self.spark, self.path, at or versions.current(self.spark, self.path), schema, [versions.part_name(PART, part)])

    def _write(self, rows: DataFrame, part: str) -> str:
        folder = versions.new_folder()
        versions.write_rows(rows.withColumn(PART, F.lit(part)), self.path, folder, PART)
        return folder

    def _written(self, folder: str, schema: StructType) -> DataFrame:
        return versions.read_folder(self.spark, self.path, folder, schema)

    def _publish(self, base: versions.Version, load: str, **folders: list[str]) -> None:
        parts = {versions.part_name(PART, name): found for name, found in folders.items()}
        present = {name: [f for f in found if name in versions.folder_parts(self.spark, self.path, f)] for name, found in parts.items()}
        versions.publish(self.spark, self.path, base, present, load, {"shards": self.shards})

    def _folders(self, base: versions.Version, part: str) -> list[str]:
        return list(base.parts.get(versions.part_name(PART, part), []))

    def _dealt(self, rows: DataFrame, role: int) -> DataFrame:
        have = {c: F.col(c) for c in rows.columns}
        columns = {"kind": F.lit(role), "shard": have.get("shard", shard_of(F.col("digest"), self.shards) if "digest" in have else None)}
        return rows.select(*[columns.get(name, have.get(name, F.lit(None))).cast(kind).alias(name) for name, kind in _IN.items()])

    def _in_shards(self, *rows: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, rows).repartition("shard").sortWithinPartitions("shard", "kind")

    def probe(self, rows: DataFrame, base: versions.Version) -> DataFrame:
        """Entries of digested rows, combined where they were read, with ``hit``."""
        entries = rows.mapInArrow(_combine, _ENTRIES)
        dealt = self._in_shards(self._dealt(self._read("filters", FILTERS, base), FILTER), self._dealt(entries, INSERT))
        return materialize(dealt.mapInArrow(_probe, _FLAGGED), "probed")

    def _settle(self, base: versions.Version, stored: DataFrame, inserted: DataFrame, removed: DataFrame | None = None) -> str:
        """Writes the filters after insertions and removals. ``stored`` are the digests before the insertions and after the removals."""
        changes = [self._dealt(inserted, INSERT), *([self._dealt(removed, REMOVE)] if removed is not None else [])]
        filters = self._dealt(self._read("filters", FILTERS, base), FILTER)
        made = materialize(self._in_shards(filters, *changes).mapInArrow(_update, FILTERS), "filters")
        full = made.filter("payload is null").select("shard")
        if full.isEmpty():
            return self._write(made.repartition(F.col("shard")), "filters")
        wanted = stored.select("digest", shard_of(F.col("digest"), self.shards).alias("shard")).join(full, "shard", "left_semi").distinct()
        again = self._in_shards(self._dealt(wanted, STORED), changes[0].join(full, "shard", "left_semi"))
        grown = again.mapInArrow(_update, FILTERS)
        return self._write(made.filter("payload is not null").unionByName(grown).repartition(F.col("shard")), "filters")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", load_id: str | None = None) -> None:
        """Adds every row of ``docs``; a load id that was inserted before adds nothing."""
        load = load_id or versions.new_folder()
        if versions.find_load(self.spark, self.path, load):
            return
        base = versions.current(self.spark, self.path)
        added = self._write(digests(docs, id_col, text_col), "rows")
        probed = self.probe(self._written(added, ROWS), base)
        suspects = materialize(probed.filter("hit").select("digest", "n_bytes").distinct(), "suspects")
        stored = self._read("rows", ROWS, base)
        held = probed.filter("not hit").select("digest", "n_bytes").unionByName(stored.select("digest", "n_bytes"))
        # What may hold a hot digest is on the left, where adaptive execution can split it.
        confirmed = materialize(held.join(suspects, ["digest", "n_bytes"], "left_semi").select("digest").distinct(), "confirmed")
        false_hits = suspects.join(confirmed, "digest", "left_anti")
        # A digest that only hit others' fingerprints may have several entries, so it is shared if they are.
        several = probed.filter("hit").join(false_hits.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.sum("n").alias("n"))
        # Copies combined in one Arrow batch had no second entry to hit.
        alone = probed.filter("not hit and n > 1").select("digest")
        shared = self._write(confirmed.unionByName(several.filter("n > 1").select("digest")).unionByName(alone).distinct(), "shared")
        fresh = probed.filter("not hit").select("digest").unionByName(false_hits.select("digest"))
        filters = self._settle(base, stored, fresh)
        self._publish(base, load, rows=[*self._folders(base, "rows"), added], filters=[filters], shared=[*self._folders(base, "shared"), shared])

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Removes the live rows of these ids; NULL and unknown ids remove nothing."""
        base = versions.current(self.spark, self.path)
        stored = self._read("rows", ROWS, base)
        wanted = materialize(ids.select(F.col(id_col).cast("bigint").alias("doc_id")).dropna().distinct(), "ids")
        left = self._write(stored.join(wanted, "doc_id", "left_anti"), "rows")
        live = self._written(left, ROWS)
        touched = materialize(stored.join(wanted, "doc_id", "left_semi").select("digest").distinct(), "touched")
        gone = touched.join(live.join(touched, "digest", "left_semi").select("digest").distinct(), "digest", "left_anti")
        filters = self._settle(base, live, gone.limit(0), gone)
        self._publish(base, versions.new_folder(), rows=[left], filters=[filters], shared=self._folders(base, "shared"))

    def may_hold(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """Digest and length of the distinct texts of ``docs``, and ``live``: whether a live row has the text. Only hits are looked up."""
        rows = digests(docs.select(F.lit(None).alias("doc_id"), text_col), "doc_id", text_col).select("doc_id", "digest", "n_bytes").distinct()
        base = versions.current(self.spark, self.path)
        filters = self._dealt(self._read("filters", FILTERS, base), FILTER)
        entries = self._dealt(rows.withColumns({"n": F.lit(1), "top": F.lit(None)}), INSERT)
        probed = materialize(self._in_shards(filters, entries).mapInArrow(_probe, _FLAGGED), "probed")
        hits = materialize(probed.filter("hit").select("digest", "n_bytes"), "hits")
        found = self._read("rows", ROWS, base).join(hits, ["digest", "n_bytes"], "left_semi").select("digest", "n_bytes").distinct()
        found = materialize(found.withColumn("live", F.lit(True)), "found")
        return probed.select("digest", "n_bytes").join(found, ["digest", "n_bytes"], "left").withColumn("live", F.coalesce("live", F.lit(False)))

    def report(self) -> DataFrame:
        """One row per live row: ``doc_id, keep_id, group_size, kept, text_sha256``.

        The largest id of equal texts stays, NULL ids below all others. Rows of one id and equal texts are the same document and stay or go together.
        """
        rows = self._read("rows", ROWS)
        shared = materialize(self._read("shared", SHARED).distinct(), "shared")
        groups = rows.join(shared, "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
        groups = materialize(groups, "groups")
        # The rows are on the left, so that adaptive execution can split a hot digest.
        joined = rows.join(groups, "digest", "left")
        keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
        return joined.select(
            "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def mark_duplicates(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` through a new index at ``path``: its ``report``.

    Texts are equal when they are after lowering A-Z; NULL counts as empty. An empty table gives no rows; other columns are ignored. Runs jobs while it is built.
    """
    index = CuckooIndex(docs.sparkSession, path, shards)
    index.insert(docs, id_col, text_col)
    return index.report()
