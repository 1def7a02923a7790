"""Language identification through the registered query: brute force over the same dictionaries, held-out accuracy, ties."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
import regex

from sojourn.llm import language_id, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def dictionaries(docs):
    return queries.language_dictionaries(docs)


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_dictionaries_by_brute_force(docs, dictionaries):
    """Fewer rows than the sample in all languages but one, so every training text counts there."""
    counts, sizes = defaultdict(Counter), Counter()
    for r in docs.collect():
        if not held(r.doc_id) and r.lang is not None and regex.search(r"\p{L}", r.text or ""):
            counts[r.lang].update(language_id.letters(r.text).decode().split())
            sizes[r.lang] += 1
    assert set(dictionaries) == set(counts)
    for lang in [lang for lang in counts if sizes[lang] <= language_id.SAMPLE]:
        words, room = [], language_id.DICTIONARY
        for word, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0])):
            room -= len(word.encode()) + 1
            if room < 0:
                break
            words.append(word)
        assert dictionaries[lang].decode() == " ".join(reversed(words))


def test_query_by_brute_force(spark, docs, dictionaries):
    rows, compressors = {r.doc_id: r for r in queries.op2(spark, SF).collect()}, language_id.Compressors(dictionaries)
    texts = {r.doc_id: r for r in docs.collect()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r.held_out == held(i) and 0 <= r.score <= 1 and (r.lang_pred, r.score) == compressors.classify(texts[i].text)
    for short in (True, False):
        known = [(r.lang_pred == texts[i].lang) for i, r in rows.items() if r.held_out and texts[i].lang and (len(texts[i].text or "") < 1024) == short]
        assert sum(known) / len(known) > 0.97


def test_ties_and_long_texts(spark):
    same = {"aa": b"one two three", "bb": b"one two three"}
    docs = spark.createDataFrame([(1, "one two"), (2, "three " * 400_000), (3, "7 + 7"), (4, None)], "doc_id int, text string")
    rows = {r.doc_id: r for r in language_id.identify(docs, same).collect()}
    assert [(rows[i].lang_pred, rows[i].score, rows[i].accepted) for i in (1, 2)] == [("aa", 0.0, False)] * 2
    assert {rows[i].lang_pred for i in (3, 4)} == {"und"}


def test_hot_language(spark):
    rows = [(i, f"wort{i % 50} und mehr", "de") for i in range(9000)] + [(i, "mot et phrase", "fr") for i in range(9000, 9005)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language_id.fit(train)
    assert found["fr"] == b"phrase mot et" and set(found["de"].split()) == {b"und", b"mehr", b"wort"}
