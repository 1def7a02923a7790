"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only.

Tokens are summed per cell of all dimensions. Raking scales the cells in turn to each dimension's target
shares until all hold. A cell's mass over its tokens is the weight of a token in it; scaled to the budget, it is the
rate of its documents: how many copies of each are expected in the sample. Rates above 1 repeat documents, since rare
cells are too small for their targets otherwise. Without repeats such cells end at 1 and the sample misses the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.session import materialize

MAX_ROUNDS, TOLERANCE = 30, 1e-6
#: Default targets: each value's share of tokens to this power. Below 1 lifts the rare values.
TEMPERATURE = 0.7
#: Share of the tokens to sample.
KEEP = 0.8
NONE = "(none)"


def token_count(text: Column) -> Column:
    """Words as tokens, where no count is given."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("bigint")


def layout_topic(text: Column, tokens: Column) -> Column:
    """A topic from a text's form, for tables that carry none."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.contains(" | "), "table").when(text.rlike(r"[#*$%&]{3}"), "markup")
        .when(text.rlike(r"(?i)licen[sc]e|rights reserved"), "notice").when(tokens < 50, "short").otherwise("prose")
    )


def smoothed(cells: DataFrame, dimension: str, power: float = TEMPERATURE) -> DataFrame:
    """``(value, target)``: each value's token share to ``power``."""
    return cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("target")).withColumnRenamed(dimension, "value")


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` (dimensions and ``tokens``) with ``mass``, whose marginals are in proportion to the targets.

    ``targets`` has a table ``(value, target)`` per dimension. Values without a target, or of target 0, get no mass;
    targets of absent values are shared out to the others. Each round is stored, so its plan does not grow.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = {}
    for name, table in targets.items():
        table = table.groupBy(F.col("value").alias(name)).agg(F.sum("target").alias("target"))
        table = materialize(table.join(cells.select(name).distinct(), name, "left_semi"), "targets")
        whole = table.agg(F.sum("target")).first()[0] or 0
        wanted[name] = table.select(name, (F.col("target") / whole * total).alias("wanted"))
    cells = cells.withColumn("mass", F.col("tokens").cast("double"))
    for _ in range(MAX_ROUNDS):
        gaps = []
        for name, table in wanted.items():
            seen = materialize(cells.groupBy(name).agg(F.sum("mass").alias("seen")).join(table, name, "left"), "marginals")
            gaps.append(seen.agg(F.max(F.abs(F.coalesce("wanted", F.lit(0.0)) - F.col("seen")))).first()[0] or 0.0)
            scale = F.when(F.col("seen") > 0, F.coalesce("wanted", F.lit(0.0)) / F.col("seen")).otherwise(0.0)
            cells = cells.join(seen.select(name, scale.alias("scale")), name)
            cells = cells.withColumn("mass", F.col("mass") * F.col("scale")).drop("scale")
        cells = materialize(cells, "raked")
        if max(gaps, default=0.0) <= TOLERANCE * total:
            break
    return cells


def calibrate(cells: DataFrame, keep: float = KEEP, repeats: bool = False) -> DataFrame:
    """Adds ``weight`` (mass per token), ``rate`` (copies expected of a document) and ``probability``, the rate but
    at most 1, that samples ``keep`` of the tokens.

    With ``repeats`` rates are in proportion to the weights. Without, no rate is above 1: weights are raised together
    until the expected tokens meet the budget; cells that reach 1 stay there. If all cells of positive weight reach 1
    before that, all of them are taken whole.
    """
    rated = cells.withColumn("weight", F.when(F.col("tokens") > 0, F.col("mass") / F.col("tokens")).otherwise(0.0))
    rated = materialize(rated, "rated")
    row = rated.agg(F.sum("tokens"), F.sum("mass")).first()
    budget, scale = keep * (row[0] or 0), keep * (row[0] or 0) / row[1] if row[1] else 0.0
    for _ in range(0 if repeats else MAX_ROUNDS):
        full = F.col("weight") * scale >= 1
        taken, open_ = rated.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("mass")).otherwise(0.0))
        ).first()
        if not open_ or taken >= budget:
            break
        new = (budget - taken) / open_
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    rate = F.round(F.col("weight") * scale, 9)
    rated = rated.withColumn("rate", rate if repeats else F.least(rate, F.lit(1.0)))
    return rated.withColumn("probability", F.least("rate", F.lit(1.0)))


def mix(
    docs: DataFrame, dimensions: dict[str, Column], tokens: Column, targets: dict[str, DataFrame] | None = None,
    keep: float = KEEP, id_col: str = "doc_id", seed: int = 7, repeats: bool = True,
) -> DataFrame:
    """``docs`` as column ``doc`` (a struct of all its columns) with its dimensions, ``n_tokens``, ``weight``, ``rate``,
    ``probability``, ``copies`` and ``kept``.

    ``dimensions`` names three or any number of labels with their expressions; NULL labels count as ``(none)``.
    Without ``targets`` each dimension is smoothed. ``copies`` says how often the sample holds the document: the whole
    part of its rate, and one more where the remainder exceeds a hash of the id, so a run repeats and repeated rows go
    together; ``kept`` is whether it holds it at all. Without ``repeats`` no document has more than one copy, at the
    price of the targets; ``gaps`` tells by how much they are missed. Documents without tokens have weight 0 and rate 1,
    as they cost none of the budget. A NULL id is hashed like a value. An empty table gives none. Runs jobs while it is built.
    """
    labels = [F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(NONE)).alias(name) for name, c in dimensions.items()]
    names = list(dimensions)
    told = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), *labels, F.coalesce(tokens, F.lit(0)).cast("bigint").alias("n_tokens"))
    cells = materialize(told.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"), "cells")
    chosen = targets or {name: smoothed(cells, name) for name in names}
    cells = materialize(calibrate(rake(cells, chosen), keep, repeats).select(*names, "weight", "rate"), "rates")
    joined = told.join(cells, names, "left")
    spin = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    free = F.col("n_tokens") == 0
    rate = F.when(free, 1.0).otherwise(F.coalesce("rate", F.lit(0.0)))
    whole = F.floor(rate)
    copies = whole + (spin < rate - whole).cast("bigint")
    return joined.select(
        "doc", *names, "n_tokens", F.when(free, 0.0).otherwise(F.coalesce("weight", F.lit(0.0))).alias("weight"),
        rate.alias("rate"), F.least(rate, F.lit(1.0)).alias("probability"), copies.alias("copies"), (copies > 0).alias("kept"),
    )


def gaps(mixed: DataFrame, names: list[str], targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``dimension, value, corpus, target, expected, sampled, gap``: token shares of each value in a result of ``mix``.

    ``expected`` is by rates, ``sampled`` by copies; ``gap`` is the sampled share less the target. ``targets`` are those
    given to ``mix``. Runs one job while it is built.
    """
    counted = [F.sum(F.col("n_tokens") * F.col(c)).alias(c) for c in ("rate", "copies")]
    cells = mixed.filter("n_tokens > 0").groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), *counted)
    cells, united = materialize(cells, "sampled"), None
    for name in names:
        table = targets[name] if targets else smoothed(cells, name)
        table = table.groupBy(F.col("value").alias(name)).agg(F.sum("target").alias("target"))
        seen = cells.groupBy(name).agg(*[F.sum(c).alias(c) for c in ("tokens", "rate", "copies")]).join(table, name, "left")
        wholes = seen.agg(*[F.sum(c).alias(f"all_{c}") for c in ("tokens", "target", "rate", "copies")])
        shares = {c: F.coalesce(F.col(c) / F.nullif(F.col(f"all_{c}"), F.lit(0)), F.lit(0.0)) for c in ("tokens", "target", "rate", "copies")}
        part = seen.crossJoin(F.broadcast(wholes)).select(
            F.lit(name).alias("dimension"), F.col(name).alias("value"), shares["tokens"].alias("corpus"), shares["target"].alias("target"),
            shares["rate"].alias("expected"), shares["copies"].alias("sampled"), (shares["copies"] - shares["target"]).alias("gap"),
        )
        united = part if united is None else united.union(part)
    return united
