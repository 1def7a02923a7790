"""Keyed upsert and label corrections as joins.

The batch is reduced to one row per key first, inside the input tasks, and stored. The current table
is always the streamed side of a left join, so a small batch reaches it without shuffling it, and with
a large batch adaptive execution can split the current rows of a hot key. A full outer join would
allow neither.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn.functions.text import norm_key, strip
from sojourn.operators.filters import all_of
from sojourn.schema import ATTRIBUTES, LABEL, START, SUBJECT, UPDATED
from sojourn.session import materialize

KEYS = (SUBJECT, START)
ACTION = "action"
KEPT, UPDATED_ROW, INSERTED = "kept", "updated", "inserted"


def stamp(now: dt.datetime, schema: T.StructType) -> Column:
    """The load time as wall-clock time. As text, since a datetime literal would be an instant and shift
    with the session's time zone."""
    return F.lit(now.isoformat(sep=" ")).cast(schema[UPDATED].dataType)


def last_per_key(batch: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The last input row of each key, as the largest of position and row: each row is shuffled once, not as value and as order."""
    rest = [c for c in batch.columns if c not in (*keys, position)]
    last = batch.groupBy(*keys).agg(F.max(F.struct(F.col(position).alias("_at"), *rest)).alias("last"))
    return last.select(*keys, *[f"last.`{c}`" for c in rest])


def _same(keys: Sequence[str], null_safe: bool) -> Column:
    pairs = [(F.col(k), F.col(f"_{k}")) for k in keys]
    return all_of(a.eqNullSafe(b) if null_safe else a == b for a, b in pairs)


def _prefixed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in columns])


def matched_rows(current: DataFrame, batch: DataFrame, keys: Sequence[str] = KEYS, null_safe: bool = False) -> DataFrame:
    """Current rows whose key the batch has."""
    wanted = materialize(_prefixed(batch, keys).distinct(), "batch-keys")
    return current.join(wanted, _same(keys, null_safe), "left_semi")


def new_rows(current: DataFrame, latest: DataFrame, keys: Sequence[str] = KEYS, null_safe: bool = False) -> DataFrame:
    """Rows of a batch with unique keys whose key the current table lacks.

    The table is first cut down to the distinct keys it shares with the batch.
    """
    found = current.join(_prefixed(latest, keys), _same(keys, null_safe), "left_semi")
    shared = _prefixed(found, keys).distinct()
    return latest.join(shared, _same(keys, null_safe), "left_anti")


def changed_rows(
    current: DataFrame,
    latest: DataFrame,
    now: dt.datetime,
    keys: Sequence[str] = KEYS,
    attributes: Sequence[str] = ATTRIBUTES,
    null_safe: bool = False,
    marks: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Current rows with the values of the batch row that has their key, and what happened to them.

    A column ``action`` of stored rows is replaced where the row is updated and kept as it is elsewhere, and so are
    the columns of ``marks``; without a stored one every row has an action.
    """
    hit = F.col("_hit").isNotNull()
    incoming = _prefixed(latest, [*keys, *attributes, LABEL]).withColumn("_hit", F.lit(True))
    joined = current.join(incoming, _same(keys, null_safe), "left")
    values = {a: F.when(hit, F.col(f"_{a}")).otherwise(F.col(a)) for a in attributes}
    values[LABEL] = F.when(hit & (F.col(f"_{LABEL}") != ""), F.col(f"_{LABEL}")).otherwise(F.col(LABEL))
    values[UPDATED] = F.when(hit, stamp(now, current.schema)).otherwise(F.col(UPDATED))
    values[ACTION] = F.when(hit, UPDATED_ROW).otherwise(F.col(ACTION) if ACTION in current.columns else F.lit(KEPT))
    values |= {name: F.when(hit, mark).otherwise(F.col(name)) for name, mark in (marks or {}).items()}
    return joined.withColumns(values).select(*current.columns, *([] if ACTION in current.columns else [ACTION]))


def added_rows(
    updated: DataFrame, latest: DataFrame, schema: T.StructType, now: dt.datetime, keys: Sequence[str] = KEYS, null_safe: bool = False
) -> DataFrame:
    """Rows of the batch whose key is not among the updated rows, in the columns of ``schema``."""
    shared = _prefixed(updated, keys).distinct()
    added = latest.join(shared, _same(keys, null_safe), "left_anti").withColumn(UPDATED, stamp(now, schema))
    return added.select(*schema.names)


def upsert_latest(
    current: DataFrame,
    latest: DataFrame,
    now: dt.datetime,
    keys: Sequence[str] = KEYS,
    attributes: Sequence[str] = ATTRIBUTES,
    null_safe: bool = False,
) -> DataFrame:
    """``upsert_tagged`` for a stored batch that already has one row per key.

    The current table is read once: its rows are stored with the action they underwent, and the keys that
    matched tell which rows of the batch are new.
    """
    changed = materialize(changed_rows(current, latest, now, keys, attributes, null_safe), "changed")
    added = added_rows(changed.filter(F.col(ACTION) == UPDATED_ROW), latest, current.schema, now, keys, null_safe)
    return changed.unionByName(added.withColumn(ACTION, F.lit(INSERTED)))


def merged_rows(
    current: DataFrame,
    batch: DataFrame,
    now: dt.datetime,
    position: str,
    dealt_by: Mapping[str, Column],
    keys: Sequence[str] = KEYS,
    attributes: Sequence[str] = ATTRIBUTES,
    null_safe: bool = False,
    marks: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``upsert_tagged`` by one shuffle, for a table that is written anew: rows of table and batch meet where they are written.

    They are dealt by ``dealt_by``, columns that follow from the keys and stay with the rows. ``marks`` are columns of the table that
    updated and inserted rows get, as the action.
    """
    rest = [c for c in batch.columns if c not in (*keys, position)]
    new, old = F.struct(F.col(position).alias("_at"), *rest), F.struct(*[c for c in current.columns if c not in keys])
    given = batch.select(*keys, new.alias("_new"))
    have = current.select(*keys, old.alias("_old"))
    both = given.unionByName(have, allowMissingColumns=True).withColumns(dict(dealt_by)).repartition(*dealt_by)
    # The last batch row of a key comes first, the rows of the table follow those of the batch.
    of_key = W.partitionBy(*dealt_by, *keys).orderBy(F.desc_nulls_last("_new"))
    stored = F.max(F.col("_old").isNotNull()).over(of_key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    seen = both.select("*", F.row_number().over(of_key).alias("_n"), F.first("_new").over(of_key).alias("_last"), stored.alias("_stored"))
    matches = F.lit(True) if null_safe else all_of(F.col(k).isNotNull() for k in keys)
    kept = seen.filter(F.col("_old").isNotNull() | ((F.col("_n") == 1) & ~(F.col("_stored") & matches)))
    added = F.col("_old").isNull()
    hit = added | (F.col("_last").isNotNull() & matches)
    values = {a: F.when(hit, F.col(f"_last.{a}")).otherwise(F.col(f"_old.{a}")) for a in attributes}
    values[LABEL] = F.when(added | (hit & (F.col(f"_last.{LABEL}") != "")), F.col(f"_last.{LABEL}")).otherwise(F.col(f"_old.{LABEL}"))
    values[UPDATED] = F.when(hit, stamp(now, current.schema)).otherwise(F.col(f"_old.{UPDATED}"))
    values[ACTION] = F.when(added, INSERTED).when(hit, UPDATED_ROW).otherwise(F.col(f"_old.{ACTION}"))
    values |= {name: F.when(hit, mark).otherwise(F.col(f"_old.{name}")) for name, mark in (marks or {}).items()}
    return kept.select(*dealt_by, *[values[c].alias(c) if c in values else F.col(c) for c in current.columns])


def upsert_tagged(
    current: DataFrame,
    batch: DataFrame,
    now: dt.datetime,
    position: str,
    keys: Sequence[str] = KEYS,
    attributes: Sequence[str] = ATTRIBUTES,
    null_safe: bool = False,
) -> DataFrame:
    """The whole new table with the action each row underwent.

    A matched row takes the batch's attributes, and its label unless that is blank. With plain
    equality a NULL key part never matches, so such rows are inserted at every load; ``null_safe``
    makes them match.
    """
    latest = materialize(last_per_key(batch, keys, position), "batch")
    return upsert_latest(current, latest, now, keys, attributes, null_safe)


def upsert(current: DataFrame, batch: DataFrame, now: dt.datetime, position: str, **options) -> DataFrame:
    """The new table after the batch; see ``upsert_tagged``."""
    return upsert_tagged(current, batch, now, position, **options).drop(ACTION)


def action_counts(tagged: DataFrame | GroupedData) -> DataFrame:
    return tagged.agg(
        F.count_if(F.col(ACTION) == INSERTED).alias("inserted"),
        F.count_if(F.col(ACTION) == UPDATED_ROW).alias("updated"),
    )


def apply_labels(
    current: DataFrame, labels: DataFrame, now: dt.datetime, position: str, key: str = SUBJECT, label: str = LABEL
) -> DataFrame:
    """Set label and update time on every row of the listed keys. The last label of a key wins.

    Rows without a key or without a label change nothing.
    """
    given = labels.select(
        norm_key(F.col(key)).alias("_key"), strip(F.col(label)).alias("_label"), F.col(position).alias("_at")
    ).filter((F.col("_key") != "") & (F.col("_label") != ""))
    last = given.groupBy("_key").agg(F.max_by("_label", F.struct("_at", "_label")).alias("_label"))
    last = materialize(last, "labels")
    when = stamp(now, current.schema)
    joined = current.join(last, F.upper(F.col(SUBJECT)) == F.col("_key"), "left")
    hit = F.col("_label").isNotNull()
    return joined.withColumns(
        {LABEL: F.coalesce("_label", LABEL), UPDATED: F.when(hit, when).otherwise(F.col(UPDATED))}
    ).select(*current.columns)
