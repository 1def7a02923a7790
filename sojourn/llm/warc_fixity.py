"""Fixity audit of WARC archives by Merkle trees over offset ranges.

Each record has an archive, a byte offset and a digest. A leaf covers a fixed range of ``LEAF`` bytes and hashes the
records that start in it, in the order of offsets; a node above hashes its ``FANOUT`` children. Two replicas are
compared root by root, and only the children of differing nodes are looked at, down to the records. Nodes are keyed
by archive, level and range, so an archive of any size is spread over the cluster and no order over it is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.session import materialize

LEAF, FANOUT = 1 << 18, 16
#: Pages per archive when archives are made from a table of pages.
PAGES = 1000


def warc_record(url: Column, body: Column) -> Column:
    """Bytes of a WARC response record; NULL counts as empty."""
    body = F.encode(F.coalesce(body, F.lit("")), "utf-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "utf-8"), body, F.encode(F.lit("\r\n\r\n"), "utf-8"))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``(archive, offset, length, digest)``: the records of pages, laid one after another in archives.

    Archives hold the pages of ``PAGES`` consecutive ids. Pages without an id form archives by a hash of their content.
    Repeated rows are records of their own; equal ones follow each other in any order.
    """
    record = warc_record(F.col(url_col).cast("string"), F.col(body_col).cast("string"))
    number = F.floor(F.col(id_col) / PAGES).cast("string")
    spread = F.concat(F.lit("x"), F.pmod(F.xxhash64(url_col, body_col), F.lit(1 << 20)).cast("string"))
    rows = pages.select(F.coalesce(number, spread).alias("archive"), F.col(id_col).alias("place"), record.alias("record"))
    rows = rows.select("archive", "place", F.octet_length("record").cast("bigint").alias("length"), F.sha2("record", 256).alias("digest"))
    order = Window.partitionBy("archive").orderBy("place", "digest")
    return rows.select("archive", (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "digest")


def _node(parts: list[str], value: Column) -> Column:
    """Digest of a group's values in the order of ``parts``; groups are bounded by the range they cover."""
    listed = F.array_sort(F.collect_list(F.struct(*parts, value.alias("value"))))
    return F.sha2(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", *[x[p] for p in parts], x["value"])), ","), 256)


def tree(records: DataFrame) -> DataFrame:
    """``(archive, level, node, digest)`` of ``(archive, offset, length, digest)``; the highest level is 1 node per archive."""
    value = F.concat_ws(":", "length", "digest")
    leaves = records.groupBy("archive", F.floor(F.col("offset") / LEAF).alias("node")).agg(_node(["offset"], value).alias("digest"))
    level = materialize(leaves.select("archive", F.lit(0).alias("level"), "node", "digest"), "leaves")
    levels, top, depth = level, level.agg(F.max("node")).first()[0] or 0, 0
    while top > 0:
        top, depth = top // FANOUT, depth + 1
        above = level.withColumn("child", F.col("node")).groupBy("archive", F.floor(F.col("child") / FANOUT).alias("node"))
        level = materialize(above.agg(_node(["child"], F.col("digest")).alias("digest")).select("archive", F.lit(depth).alias("level"), "node", "digest"), "level")
        levels = levels.union(level)
    return levels


def differing_leaves(one: DataFrame, two: DataFrame) -> DataFrame:
    """``(archive, node)`` of the leaves that differ between two trees, reached from the roots by differing nodes only."""
    depth = max(one.agg(F.max("level")).first()[0] or 0, two.agg(F.max("level")).first()[0] or 0)
    open_ = None
    for level in range(depth, -1, -1):
        sides = [
            t.filter(F.col("level") == level).select("archive", "node", F.col("digest").alias(name)) for t, name in ((one, "one"), (two, "two"))
        ]
        if open_ is not None:
            sides = [s.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(
                open_.select("archive", F.col("node").alias("parent")), ["archive", "parent"], "left_semi"
            ).drop("parent") for s in sides]
        open_ = sides[0].join(sides[1], ["archive", "node"], "full").filter(~F.col("one").eqNullSafe(F.col("two"))).select("archive", "node")
        open_ = materialize(open_, "differing")
    return open_


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """``(archive, offset, length, status)`` of the records that differ: ``changed``, ``missing`` (in two) or ``extra``.

    Both tables are ``(archive, offset, length, digest)``; rows with a NULL archive or offset are left out, repeated
    rows count once. Replicas that agree give no rows, an empty replica makes all records of the other missing or extra.
    ``length`` is that of the first replica where it has the record. Runs jobs while it is built.
    """
    sides = [materialize(r.select("archive", "offset", "length", "digest").filter("archive is not null and offset is not null").distinct(), "records") for r in (one, two)]
    leaves = differing_leaves(*map(tree, sides))
    parts = [
        s.withColumn("node", F.floor(F.col("offset") / LEAF)).join(leaves, ["archive", "node"], "left_semi")
        .select("archive", "offset", F.col("length").alias(f"length_{n}"), F.col("digest").alias(f"digest_{n}"))
        for s, n in zip(sides, ("one", "two"), strict=True)
    ]
    both = parts[0].join(parts[1], ["archive", "offset"], "full")
    status = F.when(F.col("digest_two").isNull(), "missing").when(F.col("digest_one").isNull(), "extra").otherwise("changed")
    differs = ~(F.col("digest_one").eqNullSafe(F.col("digest_two")) & F.col("length_one").eqNullSafe(F.col("length_two")))
    return both.filter(differs).select("archive", "offset", F.coalesce("length_one", "length_two").alias("length"), status.alias("status"))
