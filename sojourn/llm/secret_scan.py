"""Secrets in texts, told apart by who owns them across the corpus.

Candidates are found by pattern in whole texts. The digest of each candidate value is counted over distinct
repositories and owners: a value that many owners share is a copied example; one that a single owner or few
have, and that looks random, is a live-looking credential. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sojourn.session import materialize

#: The kinds in order, what each matches and the length from which a match counts.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: A value with this many owners is an example.
EXAMPLE_OWNERS = 3
#: A live-looking value has at least so many different characters, a letter and a digit among them.
LEAST_CHARACTERS = 8
MARK = "[REDACTED]"


def _value(kind: str, match: Column) -> Column:
    return F.regexp_extract(match, PATTERNS[kind], 2) if kind == "assign" else match


def may_hold(text: Column) -> Column:
    """Whether a text has any match, before lengths are looked at."""
    parts = [PATTERNS["assign"], PATTERNS["access"], PATTERNS["hex"]]
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in parts)), F.lit(False))


def locate(texts: DataFrame) -> DataFrame:
    """``(row, kind, start, end, value)`` of all candidates of ``(row, text)``, in code points, end exclusive.

    The text between matches and the matches alternate, so running sums of their lengths give the places.
    """
    found = None
    for kind in KINDS:
        pattern = F.lit(PATTERNS[kind])
        gaps = F.transform(F.split("text", PATTERNS[kind], -1), F.length)
        matches = F.regexp_extract_all("text", pattern, F.lit(0))
        # One gap more than matches; the last one is not needed.
        pieces = F.posexplode(F.arrays_zip(gaps.alias("gap"), matches.alias("match")))
        rows = texts.select("row", pieces.alias("at", "piece")).select("row", "at", "piece.*").filter("match is not null")
        before = Window.partitionBy("row").orderBy("at")
        end = F.sum(F.col("gap") + F.length("match")).over(before)
        rows = rows.select("row", F.lit(kind).alias("kind"), end.alias("end"), "match", _value(kind, F.col("match")).alias("value"))
        rows = rows.filter(F.length("value") >= LEAST[kind])
        rows = rows.select("row", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "value")
        found = rows if found is None else found.unionByName(rows)
    return found


def ownership(candidates: DataFrame) -> DataFrame:
    """``(digest, repositories, owners)`` from ``(digest, repository, owner)``; NULL counts as one of each."""
    seen = candidates.select("digest", F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner"))
    seen = materialize(seen.distinct(), "ownership")
    return seen.groupBy("digest").agg(F.countDistinct("repository").alias("repositories"), F.countDistinct("owner").alias("owners"))


def _verdict() -> Column:
    value = F.col("value")
    random = (
        (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        & ~value.rlike("(?i)example|sample|placeholder|changeme")
    )
    return F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when(random, "live").otherwise("unclear")


def scan(docs: DataFrame, repository: Column | str = "source", owner: Column | str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` as column ``doc`` (a struct of all its columns) with ``spans``, by start, then kind as listed.

    A span has ``kind, start, end, value, repositories, owners, verdict`` (``live``, ``example`` or ``unclear``).
    A NULL text counts as empty and has no spans. Repeated rows are scanned each; they do not make a value
    more widely owned. NULL repositories and owners count as one of each. Texts without any match, mostly the
    great majority, pass by without a shuffle; the others are stored once. Runs jobs while it is built.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.struct("*").alias("doc"), text.alias("text"), *[
        (F.col(c) if isinstance(c, str) else c).cast("string").alias(name) for c, name in ((repository, "repository"), (owner, "owner"))
    ])
    suspects = materialize(given.filter(may_hold(F.col("text"))).withColumn("row", F.monotonically_increasing_id()), "suspects")
    # The text of each suspect goes to the task that has its row number, and from there on only the matches.
    spans = locate(suspects.select("row", "text")).join(suspects.select("row", "repository", "owner"), "row")
    spans = materialize(spans.withColumn("digest", F.sha2("value", 256)), "spans")
    owned = materialize(ownership(spans), "owned")
    judged = spans.join(owned, "digest").withColumn("verdict", _verdict())
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order")
    listed = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", order, "kind", "end", "value", "repositories", "owners", "verdict"
    ))).alias("spans"))
    listed = materialize(listed, "listed")
    shape = "array<struct<kind:string,start:bigint,end:bigint,value:string,repositories:bigint,owners:bigint,verdict:string>>"
    own = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "value", "repositories", "owners", "verdict")]))
    none = F.array().cast(shape)
    hit = suspects.join(listed, "row", "left").select("doc", F.coalesce(own.cast(shape), none).alias("spans"))
    return hit.union(given.filter(~may_hold(F.col("text"))).select("doc", none.alias("spans")))


def redact(docs: DataFrame, repository: Column | str = "source", owner: Column | str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with every live-looking value replaced by ``MARK``; examples stay. A column ``n_chars`` is renewed."""
    found = scan(docs, repository, owner, text_col)
    live = F.array_distinct(F.transform(F.filter("spans", lambda s: s["verdict"] == "live"), lambda s: s["value"]))
    longest_first = F.array_sort(live, lambda a, b: F.length(b) - F.length(a))
    text = F.aggregate(longest_first, F.col(f"doc.`{text_col}`"), lambda done, value: F.replace(done, value, F.lit(MARK)))
    found = found.select("doc", F.when(F.size(live) > 0, text).otherwise(F.col(f"doc.`{text_col}`")).alias("clean"), (F.size(live) > 0).alias("changed"))
    columns = []
    for c in docs.columns:
        old = F.col(f"doc.`{c}`")
        new = {text_col: F.col("clean"), "n_chars": F.when(F.col("changed"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(old)}
        columns.append(new.get(c, old).alias(c))
    return found.select(*columns)
