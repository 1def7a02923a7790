"""Near-duplicates by one-permutation hashing, with links confirmed on whole shingle sets.

A document's set holds the distinct shingles of ``words`` words after lower-casing A-Z. One pass hashes
every shingle once, deals it to one of ``BINS`` bins and keeps each bin's minimum; an empty bin borrows
from the first filled bin of its own fixed random order, so that borrowed bins agree between two sets
with the sets' similarity as well. Bands of ``ROWS`` bins name buckets.

Within a bucket no all-pairs list is made. Its first document, the one with the most exact copies, is the
centre and is compared with the others: one star. Buckets whose documents are then one component are settled.
The documents of the others meet again in buckets of two bands each, ``OFFSETS`` times with other
bands, again as one star per bucket, each bucket with a random centre of its own; only documents of different
components are compared. So a document has at most ``BANDS * (1 + len(OFFSETS))`` candidates, however
large its buckets are, and finds its nearer neighbours in the later, narrower ones.

Before texts are fetched, a pair must pass exact tests: set sizes that allow the similarity, and bitmaps of the
sets: a bit that only one side has is a shingle that the other lacks, which bounds the intersection.

At similarity 0.8 a pair shares no bucket with odds of 3e-6. A pair alone in a bucket is always compared; one in
larger buckets only if either is a centre there, so links of a family can be missed while its component is
still found through others. README has measured shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.arrays import mix, shingle_set, word_blocks
from sojourn.llm.components import components
from sojourn.llm.worker import keeping_nothing
from sojourn.session import materialize

BINS, ROWS = 256, 6
BANDS = BINS // ROWS
_SHIFT = np.uint64(64 - 8)
#: A later bucket is named by a band and the one so many further on.
OFFSETS = (1, 5, 11)
#: Words of 64 bits of the bitmaps.
BITMAP = 32
#: Bits of the filter of wanted keys: 64 bits a row, so 262,144 rows or 4 MB at most, whatever is put in.
SLOTS = 1 << 24
#: Pairs of texts confirmed at a time.
PAIRS = 256


@lru_cache
def _orders() -> np.ndarray:
    """For each bin, the order in which it looks for a filled bin."""
    return np.random.default_rng(20).permuted(np.tile(np.arange(BINS, dtype=np.uint8), (BINS, 1)), axis=1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One minimum per bin of a non-empty sorted set, empty bins filled by optimal densification."""
    bins = (shingles >> _SHIFT).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    values, has = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[filled], has[filled] = shingles[first], True
    empty = np.flatnonzero(~has)
    if len(empty):
        orders = _orders()
        for low, high in ((0, 16), (16, BINS)):
            tried = orders[empty, low:high]
            hit = has[tried]
            at = hit.argmax(axis=1)
            found = hit[np.arange(len(empty)), at]
            values[empty[found]] = values[tried[found, at[found]]]
            empty = empty[~found]
            if not len(empty):
                break
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """Bucket keys of a signature."""
    rows = values[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix(keys * np.uint64(31) + rows[:, i])
    return keys.view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(words: int):
    """(id, text key, set size, digest, bucket keys) of (id, text key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, keys = [], [], []
            for block in word_blocks(batch.column(2), lower=True):
                for row in range(len(block)):
                    found = shingle_set(block.hashes[block.range(row)], words)
                    counts.append(len(found))
                    digests.append(digest(found) if len(found) else None)
                    keys.append(bands(signature(found)) if len(found) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ], ["doc_id", "key", "n_shingles", "digest", "bands"])

    return keeping_nothing(run)


def _bitmaps(words: int):
    """(node, bitmap, bits) of (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, bits = [], []
            for block in word_blocks(batch.column(1), lower=True):
                for row in range(len(block)):
                    places = np.unique(shingle_set(block.hashes[block.range(row)], words) % np.uint64(BITMAP * 64))
                    words_ = np.zeros(BITMAP, np.uint64)
                    np.bitwise_or.at(words_, (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63)))
                    maps.append(words_.view(np.int64))
                    bits.append(len(places))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(maps, pa.list_(pa.int64())), pa.array(bits, pa.int64())], ["node", "bitmap", "bits"]
            )

    return keeping_nothing(run)


def _possible(percent: int) -> Column:
    """Whether the bitmaps leave the similarity possible; never false for a pair that has it."""
    shared = F.lit(0)
    for i in range(BITMAP):
        shared = shared + F.bit_count(F.col("bitmap")[i].bitwiseAND(F.col("bitmap_a")[i]))
    most = F.least(F.col("n") - F.col("bits") + shared, F.col("n_a") - F.col("bits_a") + shared)
    return 100 * most >= percent * (F.col("n") + F.col("n_a") - most)


def _confirm(words: int, percent: int):
    """Keeps the pairs (a, b, text of a, text of b) whose sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, np.zeros(0, np.uint64)
        for whole in batches:
            for start in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(start, PAIRS)
                heads, keep = batch.column(0).to_pylist(), []
                # Pairs of one centre mostly follow each other; its set is made once for all of them.
                fresh = [i for i, a in enumerate(heads) if a != (heads[i - 1] if i else last)]
                sets = {} if last is None else {last: first}
                for block in word_blocks(batch.column(2).take(pa.array(fresh, pa.int64())), lower=True):
                    for row in range(len(block)):
                        sets[heads[fresh[block.first + row]]] = shingle_set(block.hashes[block.range(row)], words)
                for block in word_blocks(batch.column(3), lower=True):
                    for row in range(len(block)):
                        one, two = sets[heads[block.first + row]], shingle_set(block.hashes[block.range(row)], words)
                        both = len(np.intersect1d(one, two, assume_unique=True))
                        union = len(one) + len(two) - both
                        keep.append(union > 0 and 100 * both >= percent * union)
                last, first = heads[-1], sets[heads[-1]]
                kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"])
                yield kept.filter(pa.array(keep, pa.bool_()))

    return keeping_nothing(run)


def _wanted_only(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among ``wanted``, by a filter of ``SLOTS`` bits.

    Never drops a wanted row; how many others stay only decides how much the join that follows shuffles.
    """
    def slot(c: Column) -> Column:
        return F.pmod(c, F.lit(SLOTS))

    one = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    cells = wanted.select(slot(F.col(key)).alias("slot")).groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(one).alias("bits"))
    marked = df.withColumn("slot", slot(F.col(key))).withColumn("cell", F.shiftright("slot", 6))
    # Bounded by SLOTS / 64 rows of two numbers.
    return marked.join(F.broadcast(cells), "cell").filter(F.col("bits").bitwiseAND(one) != 0).select(*[F.col(c) for c in df.columns])


def _similar(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The stored pairs (a, b) that are similar enough by their whole texts."""
    heads = texts.join(pairs.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    second = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(heads.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    rows = both.select("a", "b", "text_a", "text_b")
    return materialize(rows.mapInArrow(_confirm(words, percent), "a bigint, b bigint"), "found")


def _stars(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Each row of (bucket, node, turn, ...) beside its bucket's centre, whose carried columns end in ``_a``."""
    # Only the first row of a bucket leaves a task, so a hot bucket is not gathered.
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("turn", "node"))
    heads = rows.withColumn("place", place).filter("place = 1")
    heads = materialize(heads.select("bucket", F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in carried]), "centres")
    return rows.join(heads, "bucket").filter("node <> a")


def _components(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``components`` of the confirmed links between nodes that share a bucket; ``members`` is (bucket, band, node, n, turn)."""
    sizes = 100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")
    maps = materialize(texts.mapInArrow(_bitmaps(words), "node bigint, bitmap array<bigint>, bits bigint"), "bitmaps")
    pairs = _stars(members, ["n"]).filter(sizes).select("a", F.col("node").alias("b"), "n_a", "n").distinct()
    pairs = pairs.join(maps.select(F.col("node").alias("b"), "bitmap", "bits"), "b")
    pairs = pairs.join(maps.select(F.col("node").alias("a"), F.col("bitmap").alias("bitmap_a"), F.col("bits").alias("bits_a")), "a")
    found = _similar(materialize(pairs.filter(_possible(percent)).select("a", "b"), "pairs"), texts, words, percent)
    label = components(found)
    labelled = members.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = materialize(labelled.select("bucket", "band", "node", "n", "component"), "labelled")
    state = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    # A bucket of two has had its only pair compared.
    opened = materialize(state.filter("low < high and size > 2").select("bucket"), "open")
    if opened.isEmpty():
        return label
    within = labelled.join(opened, "bucket", "left_semi").select("node").distinct()
    # At most BANDS keys a node.
    keys = labelled.join(materialize(within, "within"), "node", "left_semi").groupBy("node").agg(
        F.first("n").alias("n"), F.first("component").alias("component"),
        F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("keys"),
    )
    nodes = materialize(keys.join(maps, "node"), "nodes")
    for k, offset in enumerate(OFFSETS):
        named = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> if(keys[i] is null or keys[(i + {offset}) % {BANDS}] is null, "
                       f"null, xxhash64(i, keys[i], keys[(i + {offset}) % {BANDS}])))")
        rows = nodes.select("node", "n", "component", "bitmap", "bits", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("bucket"))
        beside = _stars(rows.withColumn("turn", F.xxhash64("bucket", "node")), ["n", "component", "bitmap", "bits"])
        beside = beside.filter((F.col("component") != F.col("component_a")) & sizes & _possible(percent))
        ends = beside.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        pairs = materialize(ends, "pairs")
        if pairs.isEmpty():
            continue
        new = _similar(pairs, texts, words, percent)
        # Components are joined by their new links only.
        own = materialize(nodes.select("node", "component"), "own")
        for end in ("a", "b"):
            new = new.join(own.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}")), end)
        merged = components(new, "component_a", "component_b").select(F.col("node").alias("component"), F.col("component").alias("into"))
        # The smallest nodes of merged components had no label of their own before.
        label = label.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component")).union(merged)
        if k == len(OFFSETS) - 1:
            break
        moved = nodes.join(merged, "component", "left")
        nodes = materialize(moved.select("node", "n", F.coalesce("into", "component").alias("component"), "keys", "bitmap", "bits"), "nodes")
    return label


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``, and ``xxhash64`` of the text if ``key_col`` names it.

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets. ``component_id``
    is the smallest id reachable by links, ``kept`` whether it is the document's own.

    Runs jobs while it is built and stores intermediate tables in the shared folder. Documents with equal
    sets are one node, so a group of copies costs one row however large it is. A NULL or blank text has an
    empty set and is linked with nothing. Repeated rows have one and the same result each; a row without
    an id is never linked: its ``component_id`` is NULL and it is kept. An empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    described = source.mapInArrow(
        _describe(words), "doc_id bigint, key bigint, n_shingles bigint, digest binary, bands array<bigint>"
    ).withColumn("row", F.monotonically_increasing_id())
    described = materialize(described, "described")
    classes = described.filter("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min(F.struct("doc_id", "row", "key")).alias("best"), F.count(F.lit(1)).alias("copies"),
        F.min("n_shingles").alias("n"),
    )
    classes = materialize(classes.select(
        "digest", F.col("best.row").alias("node"), F.col("best.doc_id").alias("doc_id"), F.col("best.key").alias("key"), "copies", "n",
    ), "classes")
    # The first row of each class stands for it; its row number is unique, so this join keeps one row per class.
    leading = described.select("row", "bands").join(classes.select(F.col("node").alias("row"), "n", "copies"), "row")
    # The turn is random below six bits that rank the number of copies, most first.
    rank = F.lit(63) - F.least(F.floor(F.log2("copies")), F.lit(62))
    turn = F.shiftleft(rank.cast("bigint"), 57) + F.pmod(F.xxhash64("row"), F.lit(1 << 57))
    leading = materialize(leading.select(F.col("row").alias("node"), "n", turn.alias("turn"), "bands"), "leading")
    rows = leading.select("node", "n", "turn", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket")
    shared = materialize(shared, "shared")
    # An inner join, as the optimizer moves a semi-join ahead of the filter.
    members = materialize(_wanted_only(rows, "bucket", shared).join(shared, "bucket"), "members")
    wanted = materialize(members.select("node").distinct().join(classes, "node").select("node", "doc_id", "key"), "wanted")
    texts = _wanted_only(source, "key", wanted).join(wanted, ["doc_id", "key"]).select("node", "text").dropDuplicates(["node"])
    label = _components(members, materialize(texts, "texts"), words, percent)
    # Row order is not id order, so a component's id is the smallest id of its classes.
    grouped = classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = materialize(grouped.select("digest", "doc_id", "copies", "node", "component"), "grouped")
    linked = grouped.filter("component <> node").select("component").distinct()
    least = grouped.join(linked, "component", "left_semi").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = grouped.join(materialize(least, "least"), "component", "left")
    named = named.withColumn("component_id", F.coalesce("least", "doc_id"))
    named = materialize(named.filter("copies > 1 or component_id <> doc_id").select("digest", "component_id"), "named")
    key = [F.col("key").alias(key_col)] if key_col else []
    result = described.select("doc_id", "n_shingles", "digest", *key).join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    result = result.select("doc_id", "n_shingles", own.alias("component_id"), *([key_col] if key_col else []))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
