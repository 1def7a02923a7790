"""Contains-search of a stored profile through an inverted index of its keys and names.

Every position of a folded text gives a gram of up to three characters, shorter ones at its end. Postings (gram, subject) are
stored by buckets of a gram's first two characters, each in the order of grams. A keyword of three characters or more is looked
up by its rarest grams, a shorter one by the grams that begin with it. That finds every subject that may match; the exact test is then made on the
stored rows of these subjects alone. A changed name only adds postings: what an old one still finds fails the exact test.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn.functions.text import strip_accents
from sojourn.operators.lookups import Lookup, attach_lookups
from sojourn.operators.search import MAX_HITS, matches, newest_first, page, squeezed
from sojourn.plans.stored_profile import StoredProfile
from sojourn.schema import SUBJECT
from sojourn.session import materialize
from sojourn.sources import versions

SIZE, HEAD = 3, 2
#: Grams of a keyword that candidates must have; the exact test sees to the others.
RAREST = 3
BUCKETS = 64
POSTINGS, COUNTS = "postings_of", "counts_of"
POSTING_SCHEMA = T.StructType([T.StructField("gram", T.StringType()), T.StructField(SUBJECT, T.StringType())])
COUNT_SCHEMA = T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])


def grams(text: Column) -> Column:
    """All grams of a text, one per position; NULL and empty texts have none."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(SIZE))))


def forms(keyword: str) -> tuple[Column, Column]:
    """The texts of which one must be contained for ``matches`` to hold."""
    raw = F.lit(keyword.strip())
    return squeezed(strip_accents(raw)), squeezed(raw)


@dataclass(frozen=True)
class NameIndex:
    """An index at ``path`` of a stored profile; ``buckets`` is fixed by the first refresh."""

    spark: SparkSession
    path: str
    profile: StoredProfile
    buckets: int = BUCKETS

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(F.substring(gram, 1, HEAD)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, column: str) -> str:
        folder = versions.new_folder()
        placed = rows.withColumn(column, self._bucket(F.col("gram"))).hint("rebalance", F.col(column))
        versions.write_rows(placed.sortWithinPartitions(column, *rows.columns), self.path, folder, column)
        return folder

    def refresh(self) -> versions.Version:
        """Indexes the summaries that changed since the last refresh, all of them at the first."""
        base, seen = versions.current(self.spark, self.path), versions.current(self.spark, self.profile.path)
        if base.number and base.info["buckets"] != self.buckets:
            raise ValueError(f"{self.path} was built with {base.info['buckets']} buckets")
        since = base.info["profile"] if base.number else 0
        if since == seen.number:
            return base
        rows, name = self.profile.changed_summaries(since, seen), F.col("name")
        texts = F.array(F.replace(SUBJECT, F.lit(" "), F.lit("")), squeezed(name), squeezed(strip_accents(name)))
        found = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.coalesce(grams(t), F.array().cast("array<string>")))))
        postings = self._write(rows.select(F.explode(found).alias("gram"), SUBJECT).distinct(), POSTINGS)
        stored = versions.read_folder(self.spark, self.path, postings, POSTING_SCHEMA)
        counts = self._write(stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), COUNTS)
        parts = {
            part: [*base.parts.get(part, []), folder] for folder in (postings, counts) for part in versions.folder_parts(self.spark, self.path, folder)
        }
        return versions.publish(self.spark, self.path, base, parts, versions.new_folder(), {"profile": seen.number, "buckets": self.buckets})

    def _read(self, column: str, schema: T.StructType, wanted: Sequence[str]) -> DataFrame:
        """Rows whose gram is one of ``wanted``, or begins with it if it is shorter than a head."""
        at = versions.current(self.spark, self.path)
        whole = [w for w in wanted if len(w) >= HEAD]
        if len(whole) < len(wanted):
            buckets = list(range(self.buckets))
        else:
            heads = self.spark.range(1).select(F.explode(F.array(*[self._bucket(F.lit(w)) for w in whole])).alias("b"))
            buckets = sorted({r.b for r in heads.collect()})
        names = [versions.part_name(column, b) for b in buckets]
        test = [F.col("gram") == w if len(w) == SIZE else F.startswith("gram", F.lit(w)) for w in wanted]
        return versions.read_parts(self.spark, self.path, at, schema, names).filter(reduce(Column.__or__, test))

    def candidates(self, keyword: str) -> DataFrame:
        """Subjects that may match, each once: all that do, and few that do not."""
        texts = set(self.spark.range(1).select(*[f.alias(f"f{i}") for i, f in enumerate(forms(keyword))]).first())
        found = []
        for text in texts:
            if len(text) < SIZE:
                found.append(self._read(POSTINGS, POSTING_SCHEMA, [text]).select(SUBJECT))
                continue
            wanted = sorted({text[i : i + SIZE] for i in range(len(text) - SIZE + 1)})
            counts = self._read(COUNTS, COUNT_SCHEMA, wanted).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most one per gram of the keyword
            if len(counts) < len(wanted):
                continue  # a gram that no text has
            rarest = [r.gram for r in sorted(counts, key=lambda r: (r.n, r.gram))[:RAREST]]
            both = self._read(POSTINGS, POSTING_SCHEMA, rarest).distinct().groupBy(SUBJECT).agg(F.count(F.lit(1)).alias("n"))
            found.append(both.filter(F.col("n") == len(rarest)).select(SUBJECT))
        none = self.spark.createDataFrame([], T.StructType([POSTING_SCHEMA[SUBJECT]]))
        return reduce(DataFrame.unionByName, found, none).distinct()

    def search(self, keyword: str, lookups: Sequence[Lookup] = (), limit: int | None = MAX_HITS, accent_insensitive: bool = False) -> DataFrame:
        """What ``search_fuzzy`` finds in the fact table of the profile, from the index and the rows of its candidates."""
        subjects = materialize(self.candidates(keyword), "search-candidates") if len(keyword.strip()) >= 2 else self.candidates("\0\0\0").limit(0)
        rows = self.profile.read_subjects(subjects).filter(matches(keyword, accent_insensitive))
        return page(attach_lookups(rows, lookups) if lookups else rows, newest_first(), limit)
