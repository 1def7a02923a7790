"""Quality rules whose cutoffs carry a guarantee against false rejection.

All rules of a stratum are tightened together along one fixed path of levels, and each level is tested on labelled good
documents from the most lenient to the strictest. A level passes if the exact (Clopper-Pearson) upper bound of the share of
good documents that any rule rejects stays below ``max_rejection``; testing stops at the first failure, so the order itself
needs no correction, and the rules need none either, as they are tested as one. The error probability is divided by the
number of strata. A stratum with too few labels (below 217 of good documents for four strata at the defaults) passes no level and
its documents are judged by the base rule alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm.measures import with_measures
from sojourn.session import materialize

MAX_REJECTION, ERROR = 0.02, 0.05
#: Levels in the order of testing; a rule's cutoff is its scale times the level.
LEVELS = tuple(round(1 - 0.05 * i, 2) for i in range(20))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


#: Each rule rejects when this share is above its cutoff. The scale is the share that no kind of text is expected to exceed.
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.3), "upper": ("n_upper", "n_letters", 0.8), "dup_lines": ("n_dup_lines", "n_lines", 0.9),
    "repeats": ("n_repeat_words", "n_words", 0.8), "marks": ("n_marks", "n_words", 0.8),
}


def _excess(rule: str) -> Column:
    part, whole, scale = RULES[rule]
    return _share(part, whole) / scale


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, summed from exact log terms."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return 1.0 if k >= n else 0.0
    logs = math.lgamma(n + 1), math.log(p), math.log1p(-p)
    terms = (logs[0] - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * logs[1] + (n - i) * logs[2] for i in range(k + 1))
    return min(1.0, math.fsum(map(math.exp, terms)))


def bounded(k: int, n: int, rate: float, error: float) -> bool:
    """Whether the exact upper bound of a rate with ``k`` of ``n`` seen is at most ``rate``, up to ``error``.

    The bound is below ``rate`` exactly if so few cases would be that rare at ``rate`` itself.
    """
    return n > 0 and k < rate * n and binomial_tail(k, n, rate) <= error


def choose_levels(measured: DataFrame, labels: DataFrame, stratum_col: str, max_rejection: float, error: float, id_col: str) -> DataFrame:
    """``(stratum, level, n_good)`` for every stratum with labelled good documents; the level is NULL where none is guaranteed.

    Documents are counted per stratum and level where they lie, the tests run one stratum a row; nothing but the number of strata
    reaches the driver. A document with labels of both kinds, or without one, is not used.
    """
    good = labels.select(F.col("doc_id").alias(id_col), F.col("quality")).groupBy(id_col).agg(F.min("quality").alias("least"))
    good = materialize(good.filter("least = 1").select(id_col), "good")
    known = measured.join(good, id_col, "left_semi").withColumn("excess", F.greatest(*map(_excess, RULES)))
    counts = known.groupBy(F.col(stratum_col).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n_good"), F.array(*[F.count_if(F.col("excess") > level) for level in LEVELS]).alias("rejected"),
    )
    counts = materialize(counts, "good-counts")
    each = error / max(counts.count(), 1)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [strictest(k, n, max_rejection, each) for n, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), batch.column(1)], ["stratum", "level", "n_good"])

    return counts.mapInArrow(test, "stratum string, level double, n_good bigint")


def strictest(rejected: list[int], n: int, rate: float, error: float) -> float | None:
    """The last level before the first one whose bound on false rejections is above ``rate``."""
    passed = None
    for level, k in zip(LEVELS, rejected, strict=True):
        if not bounded(k, n, rate, error):
            break
        passed = level
    return passed


def judge(
    docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", max_rejection: float = MAX_REJECTION, error: float = ERROR,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its id, stratum and counts, ``base_failed``, ``failed_rules``, ``kept``.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad); NULLs there count as absent. A NULL or blank text has no
    words and fails the base rule (fewer than 10 words, or over 20 % of them repeated). NULL strata are one
    stratum. Repeated rows get equal verdicts; without documents or labels there is no level. A share equal to
    its cutoff passes. Runs jobs while it is built.
    """
    slim = docs.select(
        F.col(id_col).cast("bigint").alias(id_col), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
        F.col(text_col).alias("text"),
    )
    measured = materialize(with_measures(slim, "text", [id_col, "stratum"]), "measured")
    levels = materialize(choose_levels(measured, labels, "stratum", max_rejection, error, id_col), "levels")
    measured = measured.join(levels.select("stratum", F.col("level").alias("_level")), "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(_excess(rule) > F.col("_level"), F.lit(rule)) for rule in RULES]))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measured.withColumn("base_failed", base).withColumn("failed_rules", failed).drop("_level")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
