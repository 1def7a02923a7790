"""Contains-search through the index against the search that scans all intervals."""

from __future__ import annotations

import random

import pytest

from sojourn.operators.lookups import Lookup
from sojourn.operators.search import search_fuzzy
from sojourn.plans.name_index import NameIndex
from sojourn.plans.stored_profile import StoredProfile
from sojourn.sources import tables, versions
from tests.conftest import rows

AS_OF = "2024-12-31"
KEYWORDS = ["an", "ann", "nAn n", "ông", "ONG", "dan", "Đan", "é", "é́", " a", "a", "", "aab", "bab a", "P1", "p12", "12", "ß", "x_%", "anna-lena maria", "nothing like it", "́́"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("index")
    profile = StoredProfile(spark, str(base / "profile"), str(base / "fact"), buckets=8)
    return profile, NameIndex(spark, str(base / "index"), profile, buckets=16)


def load(make_stays, profile, rng, n, day):
    names = ["Ann An", "Anna-Lena Maria", "Ông Đan", "ONG DAN", "José é", "aab", "ba b a", "Straße", None, "", "x_% y", "🎉 an 🎉"]
    tables.append_stays(make_stays(*[
        {"subject": f"p{rng.randrange(60)}", "name": rng.choice(names), "start": f"2024-{rng.randrange(1, 13):02d}-{day:02d}", "updated": f"2024-02-{day:02d}"} for _ in range(n)
    ]), profile.fact)


def no_lookups(spark):
    return [Lookup("none", spark.createDataFrame([], "doc string"), "S", "doc")]


def test_same_as_scanning(spark, make_stays, stored):
    profile, index = stored
    rng = random.Random(6)
    columns = ["subject", "name", "start_date"]
    for day in (1, 2):
        load(make_stays, profile, rng, 70, day)
        profile.refresh(AS_OF)
        index.refresh()
        stays = tables.read_stays(spark, profile.fact)
        for keyword in KEYWORDS if day == 2 else KEYWORDS[:3]:
            fold = len(keyword) % 2 == 0
            want = rows(search_fuzzy(stays, no_lookups(spark), keyword, AS_OF, None, fold), *columns)
            assert rows(index.search(keyword, limit=None, accent_insensitive=fold), *columns) == want, keyword
    assert index.refresh() == versions.current(spark, index.path)



def test_reads_buckets_of_the_keyword_only(spark, stored, monkeypatch):
    """Runs after the other test: no interval is read, nor any bucket but those of rare grams and of candidates."""
    profile, index = stored
    read, real = [], versions.read_parts

    def watched(spark_, root, at, schema, only=None):
        read.extend((root, name) for name in (at.parts if only is None else only) if name in at.parts)
        return real(spark_, root, at, schema, only)

    monkeypatch.setattr(versions, "read_parts", watched)
    assert rows(index.search("lena"), "name") and not [r for r in read if r[0] == profile.fact]
    assert len({name for root, name in read if root == index.path}) <= 4
