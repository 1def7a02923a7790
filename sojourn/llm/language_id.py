"""Language identification by compression.

Each language has a dictionary of raw content: the words of sample documents, those of most documents last, where
references to them are shortest. Single words, so that a passage that documents of two languages share
weighs no more than its words. A text is compressed with two cuts of every dictionary: a short one of the commonest words, whose near
references tell most in few bytes, and a long one for the rest. The language with the smallest sum of both sizes
wins, for texts of every length alike, and a narrow lead is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sojourn.llm.arrays import extended
from sojourn.llm.worker import keeping_nothing
from sojourn.session import materialize

#: The dictionaries' sample: this many documents of each language, whole.
SAMPLE = 512
#: Bytes of the two dictionaries, of the commonest words of the sample.
DICTIONARY, SHORT_DICTIONARY = 100_000, 4_000
LEVEL = 5
#: Smallest lead, as a share of the second best size, that is accepted.
MIN_MARGIN = 0.005
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes other than letters become spaces; the bytes of other characters stay.
_ONLY_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def letters(text: str) -> bytes:
    """The form in which texts and dictionaries are compared.

    Lower case, ASCII marks and digits blanked out, each word once: what a text repeats within itself would
    compress with any dictionary and drown the difference.
    """
    return b" ".join(dict.fromkeys(text.lower().encode().translate(_ONLY_LETTERS).split()))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = [word.decode() for word in letters(text).split()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string())], ["lang", "word"])


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """Dictionaries by language from rows with text and language.

    A bounded sample is enough: the ``SAMPLE`` rows of each language that come first in a fixed random
    order, with their whole texts. Their words are counted by documents, and only as many of the commonest as a dictionary holds reach
    the driver; words of equally many documents are taken by the alphabet.
    Rows whose text or language is NULL or blank are left out; without any row there is no dictionary.
    """
    rows = train.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    rows = rows.filter("text rlike '\\\\p{L}' and trim(lang) <> ''").withColumn("order", F.xxhash64("id", "text"))
    # A bound on the hash that about 2 * SAMPLE rows of a language stay below keeps the others out of the language's one window task.
    sizes = materialize(rows.groupBy("lang").agg((F.lit(2.0 * SAMPLE + 64) / F.count(F.lit(1))).alias("share")), "languages")
    few = rows.join(sizes, "lang").filter(F.col("order") / F.lit(2.0**64) + 0.5 < F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "id", "text"))
    chosen = few.withColumn("place", place).filter(F.col("place") <= SAMPLE).select("lang", "text")
    counted = chosen.mapInArrow(keeping_nothing(_words), "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    filled = F.sum(F.octet_length("word") + 1).over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = counted.withColumn("filled", filled).filter(F.col("filled") <= DICTIONARY).select("lang", "filled", "word").collect()
    words: dict[str, list[str]] = {}
    for row in sorted(kept, reverse=True):
        words.setdefault(row["lang"], []).append(row["word"])
    return {lang: " ".join(found).encode() for lang, found in words.items()}


class Compressors:
    """Two compressors per language, built once per task from the dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.pairs = [
            (self._compressor(dictionaries[lang]), self._compressor(dictionaries[lang][-SHORT_DICTIONARY:])) for lang in self.langs
        ]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False,
        )

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and score: the lead over the second best as a share of its size."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        data = letters(text)
        sizes = sorted((sum(len(c.compress(data)) for c in pair), lang) for pair, lang in zip(self.pairs, self.langs, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], 1.0 - sizes[0][0] / sizes[1][0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``accepted`` to ``docs``.

    Whole texts are compressed. A NULL text or one without a letter is ``und`` with score 0 and not accepted;
    so are all texts when there are no dictionaries. On equal sizes the language first in the alphabet is
    named, with score 0. With a single language every text with a letter is that one. Columns are kept, but
    for earlier ones of those names. Rows are independent, so repeated rows and empty tables need no care.
    """
    added = ("lang_pred", "score", "accepted")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    source = docs.select(F.struct(*kept).alias("row"), F.col(text_col).cast("string").alias("text"))
    # A dictionary of at most DICTIONARY bytes per language, however many documents there are.
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                found = [compressors.classify(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                ], ["row", "lang_pred", "score"])

    schema = extended(source.schema["row"], lang_pred="string", score="double")
    done = source.mapInArrow(keeping_nothing(run), schema)
    accepted = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_margin)
    return done.select("row.*", "lang_pred", "score", accepted.alias("accepted"))
