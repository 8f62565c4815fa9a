"""Column functions on words: letters, prefixes, common prefixes and the text forms of the result files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_LETTER = ord("a")
LETTERS = 26


def letter_index(letter: Column) -> Column:
    """0 for a, 25 for z; other characters fall outside."""
    return F.ascii(letter) - FIRST_LETTER


def letters(word: Column, stop_at_space: bool = False) -> Column:
    """The word's letters; with ``stop_at_space`` only those before the first space."""
    text = F.split_part(word, F.lit(" "), F.lit(1)) if stop_at_space else word
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def prefixes(word: Column) -> Column:
    """All non-empty prefixes, shortest first; none of the empty word (a sequence from 1 to 0 would count down)."""
    return F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def parent(prefix: Column) -> Column:
    return F.substring(prefix, F.lit(1), F.length(prefix) - 1)


def last_letter(prefix: Column) -> Column:
    return F.substring(prefix, F.length(prefix), F.lit(1))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Letters that two words share from the start."""
    shorter = F.least(F.length(a), F.length(b))
    return F.array_max(F.filter(F.sequence(F.lit(0), shorter), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def in_alphabet(word: Column) -> Column:
    """Whether all letters are a to z, at least one."""
    return word.rlike("^[a-z]+$")


def upper_flag(flag: Column) -> Column:
    """TRUE or FALSE, as lookups spell booleans."""
    return F.upper(flag.cast("string"))


def null_text(value: Column) -> Column:
    """The value as text, the string null where there is none."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def presence(value: Column) -> Column:
    """1 for a cell with content, -1 for an empty or missing one."""
    return F.when(value.isNull() | (value.cast("string") == ""), F.lit(-1)).otherwise(F.lit(1))


def quantised(value: Column, step: float) -> Column:
    """The nearest multiple of ``step``."""
    return F.floor(value / step + 0.5) * step


def falsy(value: Column) -> Column:
    return ~F.coalesce(value, F.lit(False))


def mismatch(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def cut_at_nul(data: Column) -> Column:
    """Bytes as UTF-8 text up to the first NUL."""
    return F.split_part(F.decode(data, "UTF-8"), F.lit("\0"), F.lit(1))


def trimmed(value: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")
