"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document. Most of them look for one defect each and vote bad or not at all: that
a text lacks one defect is no vote for its being good. Votes are counted by pattern over the whole corpus, and
expectation-maximisation on the patterns estimates how often each labeller votes on good and on bad documents, and each
pattern's chance of being good. These posteriors label a bounded sample, on which a logistic regression over hashed
byte trigrams and the share of repeated bytes is trained; it scores every document, and its score alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm.arrays import extended, mix, text_blocks
from sojourn.llm.measures import with_measures
from sojourn.session import materialize

#: Hashed features, bytes of a run whose repetition is one more feature, and documents in the training sample at most.
FEATURES, RUN, SAMPLE = 1024, 16, 6000
#: What is believed of the good share before any vote, and the change of posteriors at which estimates count as settled.
PRIOR_GOOD, SETTLED = 0.8, 1e-9


def _ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def labellers() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 none. Each looks for one defect; only ``prose`` votes good: on running text of varied wording."""
    letters = _ratio("n_letters", "word_chars")
    prose = (
        (F.col("n_words") >= 50) & (letters >= 0.9) & (_ratio("n_repeat_words", "n_words") < 0.1) & _ratio("n_stops", "n_words").between(0.02, 0.4)
        & _ratio("word_chars", "n_words").between(3, 9) & (_ratio("n_upper", "n_letters") < 0.15)
    )
    bad = {
        "symbols": _ratio("n_symbols", "word_chars") > 0.05, "upper": _ratio("n_upper", "n_letters") > 0.5,
        "marks": _ratio("n_marks", "n_words") > 0.3, "repeats": _ratio("n_repeat_words", "n_words") > 0.3,
        "lines": _ratio("n_dup_lines", "n_lines") > 0.5, "letters": (F.col("n_words") > 0) & (letters < 0.8),
    }
    return {name: F.when(found, -1).otherwise(0) for name, found in bad.items()} | {"prose": F.when(prose, 1).otherwise(0)}


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good per pattern, chance of a right vote per labeller among its votes) by EM.

    A labeller votes good, bad or nothing, with chances of its own for good and for bad documents. Starts from the sum of
    votes and the prior, so that "good" keeps its meaning, smooths every estimate, and goes on until the posteriors settle;
    each round raises the likelihood, and a round that no longer does ends it too.
    """
    posterior = 1 / (1 + np.exp(-2.0 * patterns.sum(axis=1) - np.log(PRIOR_GOOD / (1 - PRIOR_GOOD))))
    cast = [patterns == vote for vote in (-1, 0, 1)]
    # Pseudo-counts of votes of bad, nothing and good: few wrong votes are expected of either class.
    before = {"good": (0.1, 8.0, 1.9), "bad": (1.9, 8.0, 0.1)}
    reached, change = -np.inf, np.inf
    while len(patterns) and change > SETTLED:
        good, bad = counts * posterior, counts * (1 - posterior)
        prior = (good.sum() + PRIOR_GOOD) / (counts.sum() + 1)
        sides = []
        for weight, chance, name in ((good, prior, "good"), (bad, 1 - prior, "bad")):
            seen = [weight @ votes + more for votes, more in zip(cast, before[name], strict=True)]
            rates = [part / sum(seen) for part in seen]
            sides.append(np.log(chance) + sum(votes @ np.log(rate) for votes, rate in zip(cast, rates, strict=True)))
        likelihood = float(counts @ np.logaddexp(*sides))
        renewed = 1 / (1 + np.exp(np.clip(sides[1] - sides[0], -500, 500)))
        change = 0.0 if abs(likelihood - reached) <= 1e-13 * abs(likelihood) else float(np.abs(renewed - posterior).max())
        posterior, reached = renewed, likelihood
    good, bad = counts * posterior, counts * (1 - posterior)
    return posterior, ((good @ cast[2]) + (bad @ cast[0]) + 1) / (counts @ ~cast[1] + 2)


def _runs(data: np.ndarray) -> np.ndarray:
    """A hash per position of the ``RUN`` bytes from there on."""
    found = data.astype(np.uint64)
    for width in (1, 2, 4):
        found = found[:-width] << np.uint64(8 * width) | found[width:]
    return mix(mix(found[:-8]) + found[8:])


def _vectors(column: pa.Array) -> Iterator[np.ndarray]:
    """Per row, roots of shares: of its byte trigrams by hash, and of its runs of bytes that occur earlier in it."""
    for _, data, rows in text_blocks(column):
        wide = data.astype(np.uint64)
        codes = wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:] if len(data) > 2 else np.zeros(0, np.uint64)
        codes = (mix(codes) % np.uint64(FEATURES)).astype(np.int64)
        for low, high in zip(rows[:-1], rows[1:], strict=True):
            counts = np.bincount(codes[low : max(high - 2, low)], minlength=FEATURES)
            runs = _runs(data[low:high]) if high - low >= RUN else np.zeros(0, np.uint64)
            again = 1 - len(np.unique(runs)) / len(runs) if len(runs) else 0.0
            yield np.sqrt(np.append(counts / max(high - low - 2, 1), again))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_vectors(batch.column(1)))
        flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
        ends = pa.array(np.arange(len(rows) + 1) * (FEATURES + 1), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["posterior", "features"])


def _score(weights: np.ndarray, intercept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([float(row @ weights) + intercept for row in _vectors(batch.column(1))])
            values = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["row", "score"])

    return run


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: its id, the labellers' votes (``votes``, a map), ``posterior``, ``score``, ``good``.

    ``posterior`` comes from the votes alone and only trains; ``score`` (0 to 1) comes from the trained scorer, and ``good`` is
    whether it reaches ``threshold``. A NULL text counts as empty; an empty text has no trigram, so its score is
    the scorer's intercept. Repeated rows have equal results. If all documents of the sample lean to one side the score
    is the mean posterior. An empty table gives none. Runs jobs while it is built.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    slim = docs.select(F.col(id_col).alias("id"), text)
    voters = labellers()
    votes = F.array(*[v.cast("int") for v in voters.values()]).alias("votes")
    patterns = with_measures(slim, "text", ["id"]).select(votes).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    # At most 3 ** labellers rows.
    found = patterns.orderBy("votes").collect()
    table = np.array([r["votes"] for r in found], np.int64).reshape(-1, len(voters))
    posterior, _ = fit_accuracies(table, np.array([r["n"] for r in found], np.float64))
    lookup = F.create_map(*[
        x for row, p in zip(table.tolist(), posterior.tolist(), strict=True) for x in (F.lit(",".join(map(str, row))), F.lit(p))
    ]) if len(table) else F.create_map(F.lit(""), F.lit(0.5))
    of_votes = F.element_at(lookup, F.array_join(F.col("votes").cast("array<string>"), ",")).alias("posterior")

    def marked(rows: DataFrame) -> DataFrame:
        return with_measures(rows, "text", ["id", "text"]).select("id", "text", votes).select("*", of_votes)

    # The smallest hashes: a bound that about 1.2 * SAMPLE rows stay below keeps the others out of the sort's one last task.
    share = min(1.0, 1.2 * SAMPLE / max(sum(r["n"] for r in found), 1))
    order = F.xxhash64("id", "text")
    few = slim.filter(order <= F.lit(int(share * (2**64 - 1)) - 2**63)) if share < 1 else slim
    sample = marked(few.orderBy(order, "id").limit(SAMPLE)).select("posterior", "text")
    features = materialize(sample.mapInArrow(_features, "posterior double, features array<double>"), "features")
    weights, intercept = train(features)
    # The measures' pass hands the text on, so that votes and scores of a row come from one scan.
    rows = marked(slim).select(F.struct("id", "votes", "posterior").alias("row"), "text")
    schema = extended(rows.schema["row"], score="double")
    scored = rows.mapInArrow(_score(weights, intercept), schema).select("row.*", "score")
    named = F.map_from_arrays(F.array(*map(F.lit, voters)), F.col("votes"))
    good = F.col("score") >= threshold
    return scored.select(F.col("id").alias(id_col), named.alias("votes"), "posterior", "score", good.alias("good"))


def train(features: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on ``(posterior, features)``; each row counts for both classes."""
    both = features.select(array_to_vector("features").alias("features"), F.lit(1.0).alias("label"), F.col("posterior").alias("share")).union(
        features.select(array_to_vector("features").alias("features"), F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("share"))
    ).filter("share > 1e-6")
    mean, sides = both.agg(F.sum(F.col("label") * F.col("share")) / F.sum("share"), F.countDistinct("label")).first()
    if sides < 2:
        share = min(max(mean if mean is not None else 0.5, 1e-6), 1 - 1e-6)
        return np.zeros(FEATURES + 1), float(np.log(share / (1 - share)))
    model = LogisticRegression(weightCol="share", maxIter=30, regParam=1e-4, standardization=False).fit(both)
    return model.coefficients.toArray(), float(model.intercept)
