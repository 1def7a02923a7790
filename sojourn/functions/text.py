"""String columns: keys, search forms, accent folding, masking. All built-in expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode has it, plus the four ASCII separator controls.
_SPACE = r"\s\x1c-\x1f"
_ANY_SPACE = f"(?U)[{_SPACE}]+"
_SPACE_CHARACTERS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Letters that have no canonical decomposition, and their usual Latin spelling.
_SPELLED = {
    "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ı": "i",
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
}
# Latin-1 Supplement to Latin Extended-B, and Latin Extended Additional (Vietnamese).
_LATIN_BLOCKS = (range(0x00C0, 0x0250), range(0x1E00, 0x1F00))


def _latin_folding() -> tuple[str, str]:
    """Each accented Latin letter with the one base letter its canonical decomposition starts with."""
    source, target = [], []
    for block in _LATIN_BLOCKS:
        for point in block:
            letter = chr(point)
            base = [c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c)]
            if len(base) == 1 and base[0] != letter:
                source.append(letter)
                target.append(base[0])
    for letter, spelled in _SPELLED.items():
        if len(spelled) == 1:
            source.append(letter)
            target.append(spelled)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _latin_folding()


def strip(c: Column) -> Column:
    """Trim every kind of Unicode whitespace; SQL ``trim`` only knows the plain space."""
    return F.btrim(c, F.lit(_SPACE_CHARACTERS))


def view_key(c: Column) -> Column:
    """Key form used when stored rows are compared: upper case, outer spaces off."""
    return F.trim(F.upper(c))


def norm_key(c: Column) -> Column:
    """Key form used at ingest: upper case, no whitespace, hyphen, underscore or dot anywhere."""
    return F.regexp_replace(F.upper(c), f"(?U)[{_SPACE}\\-_.]+", "")


def strip_accents(c: Column) -> Column:
    """Fold accented Latin letters (Vietnamese included) to ASCII letters. Texts in ASCII are left as they are."""
    folded = F.translate(c, _FOLD_FROM, _FOLD_TO)
    longer = [letter for letter, spelled in _SPELLED.items() if len(spelled) > 1]
    spelled = folded
    for letter in longer:
        spelled = F.replace(spelled, F.lit(letter), F.lit(_SPELLED[letter]))
    folded = F.when(c.rlike(f"[{''.join(longer)}]"), spelled).otherwise(folded)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"\p{M}+", "")).otherwise(c)


def plain_form(c: Column) -> Column:
    """Accent-free and lower case. For several forms of one column, store this in a step of its own and
    take ``search_of`` and ``slug_of`` from it."""
    return F.lower(strip_accents(c))


def search_of(plain: Column) -> Column:
    return strip(F.regexp_replace(plain, _ANY_SPACE, " "))


def slug_of(plain: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(plain, _ANY_SPACE, "_"), "[^a-z0-9_]+", "")


def search_form(c: Column) -> Column:
    """Accent-free, lower case, single spaces."""
    return search_of(plain_form(c))


def slug(c: Column) -> Column:
    """Header form of a value: accent-free, lower case, spaces to ``_``, only ``a-z0-9_`` kept."""
    return slug_of(plain_form(c))


def header_slug(header: str) -> str:
    """``slug`` for one column name, on the driver."""
    folded = header.translate(str.maketrans(_FOLD_FROM, _FOLD_TO))
    folded = folded.translate(str.maketrans(_SPELLED))
    folded = "".join(c for c in unicodedata.normalize("NFD", folded) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9_]", "", re.sub(r"\s+", "_", folded.lower()))


def clean_csv(c: Column) -> Column:
    """Line breaks to one space, quotes doubled, trimmed."""
    one_line = F.regexp_replace(c, r"[\r\n]+", " ")
    return strip(F.replace(one_line, F.lit('"'), F.lit('""')))


def one_line(c: Column, joiner: str = ", ") -> Column:
    """Every newline replaced, as for addresses that wrap inside a table cell."""
    return F.replace(c, F.lit("\n"), F.lit(joiner))


def truncate(c: Column, length: int = 100, suffix: str = "...") -> Column:
    cut = F.concat(F.substring(c, 1, length - len(suffix)), F.lit(suffix))
    return F.when(F.length(c) > length, cut).otherwise(F.coalesce(c, F.lit("")))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]+", "")


def is_valid_key(c: Column) -> Column:
    """At least five letters or digits, nothing else, once normalized. NULL counts as invalid."""
    return _is_key(norm_key(c))


def _is_key(key: Column) -> Column:
    return F.coalesce((F.length(key) >= 5) & key.rlike(r"^[\p{L}\p{N}]+$"), F.lit(False))


def split_keys(c: Column) -> Column:
    """Array of the valid normalized keys in a list separated by comma, semicolon, newline or tab."""
    # Normalized as a whole: one pass over the text instead of one per part.
    parts = F.split(norm_key(F.regexp_replace(c, r"[,;\n\r\t]+", ",")), ",")
    return F.coalesce(F.filter(parts, _is_key), F.array().cast("array<string>"))


def mask(c: Column, show: int = 4) -> Column:
    """Keep ``show`` characters at both ends; a text too short for that is hidden whole."""
    n = F.length(c)
    shown = F.concat(
        F.substring(c, 1, show), F.repeat(F.lit("*"), n - 2 * show), F.right(c, F.lit(show))
    )
    return F.when(n <= 2 * show, F.repeat(F.lit("*"), n)).otherwise(F.coalesce(shown, F.lit("")))


def sha256(c: Column) -> Column:
    """Hex digest; empty or NULL gives the empty string."""
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.sha2(c, 256))


def contains_any(c: Column, keywords: list[str]) -> Column:
    """True when the lower-cased text contains one of the literal keywords; NULL text never does."""
    text = F.coalesce(F.lower(c), F.lit(""))
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def not_blank(c: Column) -> Column:
    """The text itself, or NULL where it is empty or only spaces."""
    return F.when(F.trim(c) != "", c)
