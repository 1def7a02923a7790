"""Links between vectors of high cosine, by tiled comparison in the order of principal components.

Unit vectors are turned so that the leading dimensions carry most of the variance, and dealt into blocks of
``BLOCK`` rows along the first of them. Two blocks whose ranges lie further apart there than any linked
pair can are never compared. Otherwise a tile multiplies the leading ``LEAD`` dimensions only and adds the
product of the suffix norms, which bounds the rest. Pairs whose bound stays below the threshold are done; the
others take in further dimensions step by step and are dropped as soon as the bound allows. What is left is
decided by the cosine of the given components in double precision.

A tile returns link counts and a spanning forest of its links, at most two rows per vector, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.components import components
from sojourn.session import materialize

BLOCK, LEAD, STEP = 4096, 16, 16
#: Rows of a tile multiplied at a time; bounds a task's memory.
STRIP = 512
#: Allowance for single precision in the bounds.
SLACK = 1e-4


def _vectors(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row as doubles; None for a vector that is NULL, empty, zero or holds a NULL or non-finite number."""
    for value in column:
        items = value.as_py()
        if not items or None in items:
            yield None
            continue
        vector = np.array(items, np.float64)
        yield vector if np.isfinite(vector).all() and vector.any() else None


def _unit(vector: np.ndarray) -> np.ndarray:
    """Scaled first, so that neither very large nor very small components overflow when squared."""
    vector = vector / np.abs(vector).max()
    return vector / np.sqrt(vector @ vector)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units, digests, dims = [], [], []
        for vector in _vectors(batch.column(1)):
            units.append(None if vector is None else _unit(vector).tobytes())
            digests.append(None if vector is None else hashlib.blake2b((vector + 0.0).tobytes(), digest_size=16).digest())
            dims.append(0 if vector is None else len(vector))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(digests, pa.binary()), pa.array(units, pa.binary()), pa.array(dims, pa.int32()),
        ], ["vec_id", "digest", "unit", "dim"])


def _moments(dim: int):
    """Partial sums of the outer products, one row per matrix row and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(dim), dim), pa.int32()), pa.array(np.tile(np.arange(dim), dim), pa.int32()),
            pa.array(total.ravel()),
        ], ["i", "j", "value"])

    return run


def _turn(axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, len(axes))
            first = pa.array(x @ axes[:, 0])
            yield pa.RecordBatch.from_arrays([*batch.columns, first], [*batch.schema.names, "first"])

    return run


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of a sorted partition."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([
            *batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(seen, seen + n), pa.int64()),
        ], [*batch.schema.names, "part", "rank"])
        seen += n


def _forest(n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest place it is connected with."""
    root = np.arange(n)
    while len(rows):
        low = np.minimum(root[rows], root[cols])
        before = root.copy()
        np.minimum.at(root, root[rows], low)
        np.minimum.at(root, root[cols], low)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            break
        open_ = root[rows] != root[cols]
        rows, cols = rows[open_], cols[open_]
    return root


def _survivors(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose cosine may reach the threshold. ``sa[k]`` holds the norms of what follows dimension k."""
    dim, lead = a.shape[1], min(LEAD, a.shape[1])
    # The suffix norms ride along as one more dimension, so one product gives the bound.
    left = np.hstack([a[:, :lead], sa[lead][:, None]])
    right = np.hstack([b[:, :lead], sb[lead][:, None]])
    bound = left @ right.T
    rows, cols = np.nonzero(bound >= threshold - SLACK)
    done = bound[rows, cols] - sa[lead][rows] * sb[lead][cols]
    for low in range(lead, dim, STEP):
        high = min(low + STEP, dim)
        done = done + np.einsum("ij,ij->i", a[rows, low:high], b[cols, low:high])
        keep = done + sa[high][rows] * sb[high][cols] >= threshold - SLACK
        rows, cols, done = rows[keep], cols[keep], done[keep]
    return rows, cols


def _tile(axes: np.ndarray, threshold: float):
    dim = len(axes)

    def unpack(ids: bytes, copies: bytes, units: bytes):
        exact = np.frombuffer(units, np.float64).reshape(-1, dim)
        turned = (exact @ axes).astype(np.float32)
        squares = np.cumsum((turned.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
        suffix = np.sqrt(np.vstack([squares.T, np.zeros(len(exact))])).astype(np.float32)
        return np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64), exact, turned, suffix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["a"] == row["b"]
                ids_a, copies_a, exact_a, a, sa = unpack(row["ids_a"], row["copies_a"], row["units_a"])
                ids_b, copies_b, exact_b, b, sb = (ids_a, copies_a, exact_a, a, sa) if same else unpack(row["ids_b"], row["copies_b"], row["units_b"])
                n, places = len(ids_a), len(ids_a) + (0 if same else len(ids_b))
                count, root = np.zeros(places, np.int64), np.arange(places)
                for low in range(0, n, STRIP):
                    rows, cols = _survivors(a[low : low + STRIP], b, sa[:, low : low + STRIP], sb, threshold)
                    rows = rows + low
                    if same:
                        rows, cols = rows[rows < cols], cols[rows < cols]
                    sure = np.zeros(len(rows), bool)
                    for at in range(0, len(rows), 1 << 16):
                        part = slice(at, at + (1 << 16))
                        sure[part] = np.einsum("ij,ij->i", exact_a[rows[part]], exact_b[cols[part]]) >= threshold
                    rows, cols = rows[sure], cols[sure]
                    np.add.at(count, rows, copies_b[cols])
                    np.add.at(count, cols if same else cols + n, copies_a[rows])
                    if len(rows):
                        joined = _forest(places, np.concatenate([rows, np.arange(places)]), np.concatenate([cols if same else cols + n, root]))
                        root = joined
                ids = ids_a if same else np.concatenate([ids_a, ids_b])
                hit = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[hit]), pa.array(ids[root[hit]]), pa.array(count[hit])], ["node", "toward", "links"],
                )

    return run


def _link_length(usable: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Links and component of each distinct vector of one length: ``digest, links, component_id``."""
    spark = usable.sparkSession
    classes = usable.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.any_value("unit").alias("unit"))
    classes = classes.select(F.xxhash64("digest").alias("salt"), "digest", "vec_id", "copies", "unit")
    # A class is known by its row number; ids may repeat.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sums = classes.select("unit").mapInArrow(_moments(dim), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    moments = np.zeros((dim, dim))
    for row in sums.collect():
        moments[row["i"], row["j"]] = row["value"]
    axes = np.ascontiguousarray(np.linalg.eigh(moments)[1][:, ::-1])

    turned = classes.select("node", "unit", "copies").mapInArrow(_turn(axes), "node bigint, unit binary, copies bigint, first double")
    ordered = turned.repartitionByRange("first", "node").sortWithinPartitions("first", "node")
    ordered = materialize(ordered.mapInArrow(_rank, "node bigint, unit binary, copies bigint, first double, part int, rank bigint"), "ordered")
    # Places in the whole order, from the sizes of the partitions.
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("size")).orderBy("part").collect()
    before = np.cumsum([0, *[r["size"] for r in sizes]]).tolist()
    starts = spark.createDataFrame([(r["part"], b) for r, b in zip(sizes, before)], "part int, before bigint")
    blocks = ordered.join(starts, "part").withColumn("block", F.floor((F.col("before") + F.col("rank")) / BLOCK))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        first = table["first"].to_numpy()
        return pa.table({
            "block": table["block"].slice(0, 1), "low": [first.min()], "high": [first.max()],
            "ids": pa.array([table["node"].to_numpy().tobytes()], pa.binary()),
            "copies": pa.array([table["copies"].to_numpy().tobytes()], pa.binary()),
            "units": pa.array([b"".join(table["unit"].to_pylist())], pa.binary()),
        })

    packed = blocks.select("block", "node", "copies", "unit", "first").groupBy("block").applyInArrow(
        pack, "block bigint, low double, high double, ids binary, copies binary, units binary"
    )
    packed = materialize(packed, "blocks")
    # Blocks are in order of their ranges: each meets itself and those after it that begin within reach.
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    ranges = packed.select("block", "low", "high").orderBy("block").collect()
    lows = np.array([r["low"] for r in ranges])
    last = [int(np.searchsorted(lows, r["high"] + reach, side="right")) - 1 for r in ranges]
    spans = spark.createDataFrame([(r["block"], ranges[k]["block"]) for r, k in zip(ranges, last)], "a bigint, upto bigint")
    pairs = spans.select("a", F.explode(F.sequence("a", "upto")).alias("b"))
    side = lambda s: packed.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "units")])
    tiles = pairs.join(side("a"), "a").repartition("a", "b").join(side("b"), "b")
    found = materialize(tiles.mapInArrow(_tile(axes, threshold), "node bigint, toward bigint, links bigint"), "found")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("node").alias("a"), F.col("toward").alias("b")))
    named = classes.join(counted, "node", "left").join(label, "node", "left")
    named = named.select("digest", "vec_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(materialize(least, "least"), "component")
    return materialize(named.select("digest", (F.col("links") + F.col("copies") - 1).alias("links"), "component_id"), "labels")


def link_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows of cosine >= ``threshold``, ``component_id`` is the smallest id reachable
    by such links. Vectors that are NULL, empty, zero or hold a NULL or non-finite component have no links. Vectors of different
    lengths have no cosine and are never linked; each length has axes and tiles of its own, one after the other. Equal
    vectors are compared as one with their number, and count as linked with each other. A row without an
    id is never linked and is kept, with component NULL. Repeated rows are copies like any others. An empty table
    gives none. Runs jobs while it is built.
    """
    given = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    clean = materialize(given.mapInArrow(_clean, "vec_id bigint, digest binary, unit binary, dim int"), "vectors")
    usable = clean.filter("dim > 0 and vec_id is not null")
    dims = sorted(r["dim"] for r in usable.select("dim").distinct().collect())
    none = vectors.sparkSession.createDataFrame([], "digest binary, links bigint, component_id bigint")
    named = reduce(DataFrame.unionByName, [_link_length(usable.filter(F.col("dim") == dim), dim, threshold) for dim in dims], none)
    own = F.when((F.col("dim") > 0) & F.col("vec_id").isNotNull(), F.col("digest"))
    result = clean.select("vec_id", own.alias("digest")).join(named, "digest", "left")
    result = result.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
