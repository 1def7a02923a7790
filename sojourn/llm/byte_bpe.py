"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

For a vocabulary in which every token rebuilds itself from its bytes, a token sequence is the encoding of
its bytes exactly if each pair of neighbours encodes to itself. So the encoding of a prefix is known by
its last token, and the next position's last token follows from those of the positions up to one token
length back. The transducer's state is what that needs: the positions at which a token may have started, each with
its place in the trie of tokens, the token that ends there and the tokens not emitted yet. Reading a byte moves
them on and may add one; the tokens on which all their paths agree are emitted. States and arcs are made
when a text first needs them and are dropped together when there are too many, so memory is bounded.
"""

from __future__ import annotations

import base64
import codecs
import gc
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm.arrays import extended
from sojourn.llm.worker import kept, trim

#: Arcs, pairs and pieces that a worker remembers at most; each table starts afresh beyond.
MAX_ARCS, MAX_PAIRS, MAX_PIECES = 600_000, 300_000, 150_000
#: Rows per Arrow batch that a task returns.
ROWS = 256


def load_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes to rank from a rank file's content."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines.splitlines()))}


#: A position at which a token may have started: the trie node of the bytes since, the token that ends at the
#: position (-1 at the start of the piece), and the tokens up to there that are not emitted yet.
Live = tuple[int, int, tuple[int, ...]]


class Transducer:
    """Maps the bytes of one piece to token ids. Tokens are known by their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: The two tokens that a token's last merge joins; absent for single bytes.
        self.halves: dict[int, tuple[int, int]] = {}
        #: Tokens that their own bytes do not merge to; only a piece that equals one becomes it.
        self.whole: dict[bytes, int] = {}
        for token, rank in ranks.items():
            parts = self._merge(token, rank)
            if len(parts) == 2:
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            elif len(token) > 1:
                self.whole[token] = rank
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._grow_trie([token for token in ranks if token not in self.whole])
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _grow_trie(self, tokens: list[bytes]) -> None:
        """Nodes of the tokens' prefixes: child by node and byte, the token that ends there, whether any goes on."""
        self.child: dict[int, int] = {}
        self.token_at, self.goes_on = [-1], [True]
        for token in tokens:
            node = 0
            for byte in token:
                self.goes_on[node] = True
                step = node << 8 | byte
                node = self.child.setdefault(step, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.goes_on.append(False)
            self.token_at[node] = self.ranks[token]

    def _forget(self) -> None:
        self.numbers: dict[tuple[Live, ...], int] = {}
        self.states: list[tuple[Live, ...]] = []
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._state(((0, -1, ()),))

    def _state(self, live: tuple[Live, ...]) -> int:
        known = self.numbers.setdefault(live, len(self.states))
        if known == len(self.states):
            self.states.append(live)
        return known

    def _merge(self, text: bytes, below: int) -> list[bytes]:
        """Merges of rank less than ``below`` one by one: lowest rank first, leftmost on ties."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _neighbours(self, one: int, two: int) -> bool:
        """Whether two tokens stay apart when their bytes are encoded together.

        Undoes the merges of both, latest first. Just before the later one, the pieces at the border must not
        have had an earlier merge with each other; of equal ranks the left one goes first.
        """
        text, ranks, halves = self.bytes_of, self.ranks, self.halves
        limit = 1 << 60
        while True:
            if ranks.get(text[one] + text[two], 1 << 60) < limit:
                return False
            left, right = halves.get(one), halves.get(two)
            if left is not None and (right is None or one > two):
                limit, one = one, left[1]
            elif right is not None:
                limit, two = two + 1, right[0]
            else:
                return True

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The arc of a state for a byte: the next state and the ids emitted."""
        child, token_at, goes_on, pairs = self.child, self.token_at, self.goes_on, self.pairs
        live, ended = [], None
        for node, last, path in self.states[state]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            rank = token_at[node]
            if rank >= 0 and ended is None:
                if last >= 0:
                    pair = last << 32 | rank
                    apart = pairs.get(pair)
                    if apart is None:
                        if len(pairs) >= MAX_PAIRS:
                            pairs.clear()
                        apart = pairs[pair] = self._neighbours(last, rank)
                else:
                    apart = True
                if apart:
                    ended = (0, rank, (*path, rank))
            if goes_on[node]:
                live.append((node, last, path))
        if ended is not None:
            live.append(ended)
        # The tokens that all paths begin with are settled.
        out = live[0][2]
        if out:
            for _, _, path in live[1:]:
                while path[: len(out)] != out:
                    out = out[:-1]
            if out:
                live = [(node, last, path[len(out) :]) for node, last, path in live]
        return self._state(tuple(live)), out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece, in one pass over its bytes."""
        if piece in self.whole:
            return [self.whole[piece]]
        if len(self.arcs) >= MAX_ARCS:
            self._forget()
        state, ids, arcs = self.start, [], self.arcs
        for byte in piece:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                arc = arcs[state << 8 | byte] = self._arc(state, byte)
            state, out = arc
            if out:
                ids += out
        # The last path is the one that ends with the piece.
        ids += self.states[state][-1][2]
        return ids


class _Pieces(dict):
    """Packed ids by piece; an absent piece runs through the transducer.

    A full table becomes the old one, whose pieces are taken over when they occur again.
    """

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.old = machine, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = self.machine.encode(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= MAX_PIECES:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


class Codec:
    """Encodes texts to packed ids, and decodes packed ids, with one vocabulary and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(Transducer(ranks))
        #: Token bytes by rank, for ranks without gaps as a list, which is the faster lookup.
        self.tokens = {rank: token for token, rank in ranks.items()}
        if sorted(self.tokens) == list(range(len(self.tokens))):
            self.tokens = [self.tokens[rank] for rank in range(len(self.tokens))]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode_bytes(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def decode_stream(chunks: Iterable[bytes], errors: str = "replace") -> Iterator[str]:
    """Text from byte chunks that may end within a character.

    The incremental decoder is a UTF-8 state machine that carries the bytes of an unfinished character over
    to the next chunk. Malformed input gives U+FFFD where ``bytes.decode`` gives it.
    """
    decoder = codecs.getincrementaldecoder("utf-8")(errors)
    for chunk in chunks:
        if text := decoder.decode(chunk):
            yield text
    if text := decoder.decode(b"", final=True):
        yield text


def _codec(content: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary; it grows to about 250 MB and goes when another operator's task begins."""
    return kept("byte_bpe", (hash(content), pattern), lambda: Codec(load_ranks(content), pattern))


def _shared(spark: SparkSession, path: str):
    """The vocabulary file, read once on the driver; it is a few MB whatever the data."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds ``out_col``, the ids of each whole text as little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of a rank file on the driver. ``decoded_col``, if given, gets the bytes decoded from
    these ids in the same pass. A NULL text counts as empty and has no ids. The columns ``keep`` are kept, all if it
    is None, but for those already called like a new one, which are replaced. Rows are independent:
    repeated rows give repeated results, an empty table an empty one.
    """
    def both(codec: Codec, text: str) -> tuple[bytes, ...]:
        packed = codec.encode(text)
        return (packed, codec.decode_bytes(packed)) if decoded_col else (packed,)

    made = [out_col, *([decoded_col] if decoded_col else [])]
    return _apply(docs, vocabulary, pattern, text_col, made, "string", both, keep)


def decode(docs: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the bytes of packed ids; NULL counts as no ids. An id outside the vocabulary is an error."""
    return _apply(docs, vocabulary, pattern, ids_col, [out_col], "binary", lambda codec, packed: (codec.decode_bytes(packed),))


def decode_text(docs: DataFrame, ids_col: str, vocabulary: str, pattern: str, out_col: str = "decoded_text", chunk: int = 4096) -> DataFrame:
    """Adds ``out_col``, the text of packed ids, decoded ``chunk`` ids at a time."""
    def run(codec: Codec, packed: bytes) -> tuple[str]:
        step = 4 * chunk
        return ("".join(decode_stream(codec.decode_bytes(packed[i : i + step]) for i in range(0, len(packed), step))),)

    return _apply(docs, vocabulary, pattern, ids_col, [out_col], "binary", run, kind_out="string")


def _apply(
    docs: DataFrame, vocabulary: str, pattern: str, in_col: str, made: list[str], kind: str, work, keep: list[str] | None = None,
    kind_out: str = "binary",
) -> DataFrame:
    content = _shared(docs.sparkSession, vocabulary)
    empty = "" if kind == "string" else b""
    rest = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in made]
    source = docs.select(F.struct(*rest).alias("row"), F.col(in_col).cast(kind).alias("given"))
    places = [f"made{i}" for i in range(len(made))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value, pattern)
        target = pa.string() if kind_out == "string" else pa.binary()
        # The tables are many small tuples without cycles, which the collector would walk in vain.
        gc.disable()
        try:
            for batch in batches:
                for low in range(0, batch.num_rows, ROWS):
                    part = batch.slice(low, ROWS)
                    found = [work(codec, x if x is not None else empty) for x in part.column(1).to_pylist()]
                    columns = [pa.array([x[i] for x in found], target) for i in range(len(places))]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["row", *places])
        finally:
            gc.enable()
            trim()

    schema = extended(source.schema["row"], **dict.fromkeys(places, kind_out))
    return source.mapInArrow(run, schema).select("row.*", *[F.col(place).alias(name) for place, name in zip(places, made, strict=True)])
