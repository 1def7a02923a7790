"""Counts that heuristic quality rules and labellers look at, from whole texts, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.arrays import SPACE, Words, extended, windows, word_blocks

#: Words per window in which repetition is looked for.
WINDOW = 5
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_stops",
)


def _table(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in chars]] = True
    return found


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _table("abcdefghijklmnopqrstuvwxyz")
_LETTER[0xC0:] = True
#: What each per-byte count counts; continuation bytes of UTF-8 are 0x80 to 0xBF.
_BYTES = {
    "word_chars": ~SPACE & ~np.array([0x80 <= b < 0xC0 for b in range(256)]),
    "n_symbols": _table("#*$%&|<>"), "n_upper": _UPPER, "n_letters": _LETTER, "n_marks": _table("!?"), "n_stops": _table(".;:,"),
}


def _repeated(hashes: np.ndarray) -> int:
    """Words that lie in a window found twice or more."""
    found = windows(hashes, WINDOW)
    _, inverse, counts = np.unique(found, return_inverse=True, return_counts=True)
    if len(counts) == len(found):
        return 0
    again = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def _lines(block: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines that hold a word, and those of them equal to an earlier line."""
    breaks = np.flatnonzero(block.data == 0x0A)
    starts = np.union1d(block.rows[:-1], breaks + 1)
    starts = starts[starts < len(block.data)]
    row = np.searchsorted(block.rows, starts, side="right") - 1
    next_break = np.append(breaks, len(block.data))[np.searchsorted(breaks, starts)]
    ends = np.minimum(next_break, block.rows[row + 1])
    worded = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    row, hashes = row[worded], block.hash_ranges(starts[worded], ends[worded])
    total = np.bincount(row, minlength=len(block))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    same = np.zeros(len(row), bool)
    same[1:] = (row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])
    return total, np.bincount(row[same], minlength=len(block))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a column; NULL counts as empty."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in COUNTS}
    for block in word_blocks(column):
        parts["n_words"].append(np.diff(block.bounds))
        for name, table in _BYTES.items():
            sums = np.concatenate([[0], np.cumsum(table[block.data])])
            parts[name].append(sums[block.rows[1:]] - sums[block.rows[:-1]])
        lines, again = _lines(block)
        parts["n_lines"].append(lines)
        parts["n_dup_lines"].append(again)
        parts["n_repeat_words"].append(np.array([_repeated(block.hashes[block.range(r)]) for r in range(len(block))], np.int64))
    return {name: np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64) for name, found in parts.items()}


def with_measures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns if None, but for earlier ones of these names) and the counts as bigint columns."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    kept = F.struct(*[F.col(f"`{c}`") for c in names])
    source = docs.select(kept.alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[c]) for c in COUNTS]], ["row", *COUNTS])

    schema = extended(source.schema["row"], **dict.fromkeys(COUNTS, "bigint"))
    return source.mapInArrow(run, schema).select("row.*", *COUNTS)
