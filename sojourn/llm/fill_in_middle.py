"""Fill-in-middle transformation in pyarrow.compute, a batch at a time.

The units of a batch's texts are one list array over the text bytes, without a copy. Flattened, every unit has the index of its parent
and from it an ordinal, which decides its role. Units are filtered by role, rebuilt into one list per text
and joined to pieces, and the pieces are joined around the markers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm.arrays import SPACE, extended, text_blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_EMPTY = pa.scalar("", pa.large_string())
MADE = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the digest of ``seed:id``; a NULL id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def unit_lists(data: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """Units of each text: a run of white space with the word after it, or white space at the end.

    ``data`` are the bytes of all texts, ``rows`` their offsets. Units tile a text, so the end of one is the start of the next.
    """
    word = ~SPACE[data]
    last = np.zeros(len(data), bool)
    last[rows[1:][rows[1:] > rows[:-1]] - 1] = True
    follows = np.ones(len(data), bool)
    follows[:-1] = SPACE[data[1:]]
    ends = np.flatnonzero(last | (word & follows)) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    units = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(ends, rows, side="right"), pa.int32()), units)


def _modulo(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _rebuilt(values: pa.Array, mask: pa.Array, counts: pa.Array) -> pa.Array:
    """One piece per text from the flattened units of one role, ``counts`` of them in each text."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)]).cast(pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(values, mask)), _EMPTY)


def pieces(lists: pa.ListArray, one: pa.Array, two: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Prefix, middle and suffix of each text; the two draws pick the cuts among its n + 1 places."""
    n = pc.list_value_length(lists).cast(pa.int64())
    places = pc.add(n, 1)
    cuts = _modulo(one, places), _modulo(two, places)
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    values, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = pc.subtract(pc.cumulative_sum(n), n)
    ordinals = pc.subtract(pa.array(np.arange(len(values))), pc.take(starts, parents))
    before, until = pc.less(ordinals, pc.take(low, parents)), pc.less(ordinals, pc.take(high, parents))
    return (
        _rebuilt(values, before, low), _rebuilt(values, pc.and_not(until, before), pc.subtract(high, low)),
        _rebuilt(values, pc.invert(until), pc.subtract(n, high)),
    )


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts], _EMPTY)


def _transform(texts: pa.Array, lists: pa.ListArray, h: list[pa.Array], rate: int, spm: int) -> list[pa.Array]:
    marked = [pc.match_substring(texts, marker) for marker in (PREFIX, SUFFIX, MIDDLE)]
    plain = pc.or_(pc.or_(pc.equal(pc.binary_length(texts), 0), pc.or_(pc.or_(*marked[:2]), marked[2])),
                   pc.greater_equal(_modulo(h[2], pa.scalar(100)), rate))
    cut = pc.invert(plain)
    is_spm = pc.less(_modulo(h[3].filter(cut), pa.scalar(100)), spm)
    prefix, middle, suffix = pieces(lists.filter(cut), h[0].filter(cut), h[1].filter(cut))
    order = pc.if_else(
        is_spm, _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle),
    )
    absent = pa.nulls(len(texts), pa.int64())
    return [
        pc.list_value_length(lists).cast(pa.int64()),
        pc.replace_with_mask(pa.array([PLAIN] * len(texts)), cut, pc.if_else(is_spm, SPM, PSM)),
        pc.replace_with_mask(absent, cut, pc.utf8_length(prefix).cast(pa.int64())),
        pc.replace_with_mask(absent, cut, pc.utf8_length(middle).cast(pa.int64())),
        pc.replace_with_mask(texts, cut, order).cast(pa.string()),
    ]


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """Adds ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (NULL if plain) and ``output``.

    Of 100 texts about ``rate`` are cut, and of 100 of these about ``spm`` have their suffix first; both follow from the id
    alone. Texts that are empty or hold a marker stay plain. A NULL text counts as empty, a NULL id as an empty one.
    The columns ``keep`` are kept, all if it is None, but for those called like a new one, which are replaced. Rows
    are independent: repeated rows give repeated results, rows of one id and different texts the same draws, an empty table none.
    Texts are worked on in blocks of about a MB, a longer one alone.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in MADE]
    source = docs.select(F.struct(*kept).alias("row"), F.col(text_col).cast("string").alias("given"), *[h.alias(f"h{k}") for k, h in enumerate(draws(id_col, seed))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, rows in text_blocks(batch.column(1)):
                part = batch.slice(first, len(rows) - 1)
                data = np.ascontiguousarray(data)
                texts = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(data))
                made = _transform(texts, unit_lists(data, rows), [part.column(2 + k) for k in range(4)], rate, spm)
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["row", *MADE])

    return source.mapInArrow(run, extended(source.schema["row"], **MADE)).select("row.*", *MADE)


def restore(output: Column, form: Column) -> Column:
    """The exact text an output was made from. No two markers can overlap and no piece holds one, so each occurs once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    order = {PSM: (1, 3, 2), SPM: (2, 3, 1)}
    whole = F.when(form == PLAIN, output)
    for name, places in order.items():
        whole = whole.when(form == name, F.concat(*[F.get(parts, F.lit(k)) for k in places]))
    return whole
