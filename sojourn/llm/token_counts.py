"""Token counts through a digest cache.

A text's key is the digest of its normalised content and of the tokenizer file. Counts of known keys come
from the cache table by a join; every other distinct content is encoded once and appended to the table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.session import materialize

#: Distinct words whose counts a worker remembers; the table starts afresh beyond.
MAX_WORDS = 500_000
CACHE_SCHEMA = "key binary, n_tokens bigint"
_WORDS = re.compile(r"[^ \t-\r]+")


def squeeze_spaces(text: Column) -> Column:
    """Normalisation for tokenizers that drop white space: its runs become one space."""
    return F.regexp_replace(text, r"[ \t-\r]+", " ")


def library_counter(name: str, content: bytes) -> Callable[[list[str]], list[int]]:
    """Counts whole texts as ``tokenizers`` (.json) or ``sentencepiece`` (.model) does, no tokens added."""
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(found) for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class WordSums:
    """Counts of texts as sums over their words, for tokenizers that never join tokens across white space.

    Words repeat far more than texts, so the library sees each word once per worker and table.
    """

    def __init__(self, count: Callable[[list[str]], list[int]]):
        self.count, self.known = count, {}

    def __call__(self, texts: list[str]) -> list[int]:
        split = [_WORDS.findall(text) for text in texts]
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        new = list({word for words in split for word in words}.difference(self.known))
        for low in range(0, len(new), 4096):
            part = new[low : low + 4096]
            self.known.update(zip(part, self.count(part), strict=True))
        return [sum(map(self.known.__getitem__, words)) for words in split]


_counters: dict[tuple[str, int, bool], Callable[[list[str]], list[int]]] = {}


def _counter(name: str, content: bytes, by_word: bool) -> Callable[[list[str]], list[int]]:
    """One counter per worker process and tokenizer."""
    key = (name, hash(content), by_word)
    if key not in _counters:
        counter = library_counter(name, content)
        _counters[key] = WordSums(counter) if by_word else counter
    return _counters[key]


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, by_word: bool = False,
    normalise: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens``.

    ``tokenizer`` is a file on the driver, ``cache`` the folder of the cache table, made when absent; it must be
    on shared storage and may serve several tokenizers. One job at a time may append to it. ``normalise`` must
    not change a text's count, and ``by_word`` asks for a tokenizer whose tokens never span white space.
    A NULL text counts as empty. Repeated rows are encoded once and all returned; an empty table gives none.
    Runs jobs while it is built.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as file:
        content = file.read()
    shared, version = spark.sparkContext.broadcast(content), hashlib.sha256(content).hexdigest()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.lit(f"{version} "), (normalise or (lambda c: c))(text)), 256))
    keyed = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), key.alias("key"))
    slim = materialize(keyed.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "key"), "keyed")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    # One row of each unknown content is encoded. Joining on both columns spreads the copies of a text.
    place = F.coalesce("doc_id", F.lit(-1)).alias("place")
    misses = slim.groupBy("key").agg(F.min(place).alias("place")).join(known, "key", "left_anti")
    misses = materialize(misses, "misses")
    texts = keyed.withColumn("place", place).join(misses, ["place", "key"], "left_semi").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer, shared.value, by_word)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                counts = pa.array(counter(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts], ["key", "n_tokens"])

    encoded = texts.mapInArrow(run, CACHE_SCHEMA).groupBy("key").agg(F.max("n_tokens").alias("n_tokens"))
    encoded.write.mode("append").parquet(cache)
    spark.catalog.refreshByPath(cache)
    wanted = slim.select("key").distinct()
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).join(wanted, "key", "left_semi")
    known = materialize(known.groupBy("key").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return slim.join(known, "key").select("doc_id", "n_bytes", "n_tokens")
