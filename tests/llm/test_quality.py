"""Weak-label classifier and guaranteed cutoffs: brute force, labels, awkward rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sojourn.llm import measures, quality_classifier, quality_rules, queries

SF = "/root/testdata/sf0.01"


def brute_em(votes: list[tuple[int, ...]]) -> list[float]:
    """The same model document by document, for a fixed number of rounds."""
    posterior = [1 / (1 + math.exp(-2 * sum(v) - math.log(4))) for v in votes]
    for _ in range(3000):
        share = {1: (sum(posterior) + 0.8) / (len(votes) + 1)}
        share[0] = 1 - share[1]
        rates = {}
        for side, prior in ((1, {-1: 0.1, 0: 8.0, 1: 1.9}), (0, {-1: 1.9, 0: 8.0, 1: 0.1})):
            weight = [p if side else 1 - p for p in posterior]
            for k in range(len(votes[0])):
                seen = {x: prior[x] + sum(w for w, v in zip(weight, votes, strict=True) if v[k] == x) for x in prior}
                rates[side, k] = {x: n / sum(seen.values()) for x, n in seen.items()}
        chance = [{side: share[side] * math.prod(rates[side, k][x] for k, x in enumerate(v)) for side in (0, 1)} for v in votes]
        posterior = [c[1] / (c[0] + c[1]) for c in chance]
    return posterior


def test_em_by_documents():
    rng = np.random.default_rng(5)
    truth = rng.random(60) < 0.7
    votes = [tuple(int(-1 if not good and rng.random() < 0.6 else 1 if k == 2 and good and rng.random() < 0.7 else 0) for k in range(3)) for good in truth]
    counted = Counter(votes)
    patterns = np.array(sorted(counted))
    posterior, accuracy = quality_classifier.fit_accuracies(patterns, np.array([counted[tuple(p)] for p in patterns], float))
    by_pattern = dict(zip(map(tuple, patterns.tolist()), posterior, strict=True))
    assert [by_pattern[v] for v in votes] == pytest.approx(brute_em(votes), abs=1e-4)
    assert (accuracy > 0.8).all()
    nothing, _ = quality_classifier.fit_accuracies(np.zeros((0, 3), np.int64), np.zeros(0))
    assert len(nothing) == 0


def test_features_by_row():
    texts = ["", None, "ab", "abc abc abc abc abc abc", "über " * 20, "x" * 40, " ".join(map(str, range(300)))]
    for text, row in zip(texts, quality_classifier._vectors(pa.array(texts)), strict=True):
        data = (text or "").encode()
        runs = [data[i : i + 16] for i in range(len(data) - 15)]
        assert row[-1] ** 2 == pytest.approx(1 - len(set(runs)) / len(runs) if runs else 0)
        assert (row[:-1] ** 2).sum() == pytest.approx(1 if len(data) > 2 else 0)


def test_score_decides_and_finds_both_classes(spark):
    docs, labels = (queries.table(spark, SF, n) for n in ("documents", "labels"))
    found = quality_classifier.classify(docs)
    rows = found.join(labels, "doc_id").collect()
    assert all(r.good == (r.score >= 0.5) for r in rows)
    for quality, least in ((0, 0.85), (1, 0.97)):
        assert np.mean([r.good == (quality == 1) for r in rows if r.quality == quality]) >= least
    query = {r.doc_id: r for r in queries.op1(spark, SF).collect()}
    assert len(query) == docs.count() and all(query[r.doc_id].good == r.good for r in rows)


def test_levels_by_brute_force(spark):
    """Through the registered query: the level of every stratum from the labels, the verdict of every document from its counts."""
    docs, labels = (queries.table(spark, SF, n) for n in ("documents", "labels"))
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    measured = {r.doc_id: r for r in measures.with_measures(docs).collect()}

    def excess(r, rule):
        part, whole, scale = quality_rules.RULES[rule]
        return (r[part] / r[whole] if r[whole] else 0.0) / scale

    worst = {i: max(excess(r, rule) for rule in quality_rules.RULES) for i, r in measured.items()}
    strata = {r.lang or "" for i, r in measured.items() if i in good}
    levels = {}
    for stratum in strata:
        held = [worst[i] for i, r in measured.items() if i in good and (r.lang or "") == stratum]
        levels[stratum] = None
        for level in quality_rules.LEVELS:
            k = sum(x > level for x in held)
            tail = sum(math.comb(len(held), j) * 0.02**j * 0.98 ** (len(held) - j) for j in range(k + 1))
            if k >= 0.02 * len(held) or tail > 0.05 / len(strata):
                break
            levels[stratum] = level
    rows = queries.op8(spark, SF).collect()
    assert len(rows) == len(measured)
    for r in rows:
        m = measured[r.doc_id]
        level = levels.get(m.lang or "")
        names = [rule for rule in quality_rules.RULES if level is not None and excess(m, rule) > level]
        failed = m.n_words < 10 or 100 * m.n_repeat_words > 20 * m.n_words
        assert (r.failed_rules, r.base_failed, r.kept) == (",".join(names), failed, not failed and not names), r.doc_id


def test_clashing_columns_and_many_strata(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(12)), f"l{i % 300}", "s", 5, "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, stratum string, n_words int, level string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    judged = quality_rules.judge(docs, labels)
    assert judged.count() == 3000 and judged.filter("kept and n_words = 12").count() == 3000
    known = measures.with_measures(docs, "text", ["doc_id", "lang"])
    levels = quality_rules.choose_levels(known, labels, "lang", 0.02, 0.05, "doc_id").collect()
    assert len(levels) == 300 and all(r.level is None and r.n_good == 10 for r in levels)
