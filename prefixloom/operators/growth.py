"""Growth of a trie word by word: each row's predecessor, the letters it shares with it, and those it adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.functions.ranks import by_word, numbered
from prefixloom.functions.words import common_prefix_length


def with_previous(rows: DataFrame, by: list[str], ordinal: str = "num_words") -> DataFrame:
    """Adds ``previous``, the word one place before in its group, the empty word at first: an equi-join on the ordinal, so no group is one task's."""
    before = rows.select(*[F.col(c).alias(f"__{c}") for c in by], (F.col(ordinal) + 1).alias("__next"), F.col("word").alias("__word"))
    same = F.col(ordinal) == F.col("__next")
    for c in by:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return rows.join(before, same, "left").select(*rows.columns, F.coalesce("__word", F.lit("")).alias("previous"))


def facts(ranked: DataFrame, by: list[str]) -> DataFrame:
    """word_length, read and new letters of each row in its order."""
    rows = with_previous(ranked, by)
    shared = common_prefix_length(F.col("previous"), F.col("word"))
    return rows.select(*by, "word", F.length("word").alias("word_length"), "num_words", F.length("word").alias("read_letters"), (F.length("word") - shared).alias("new_letters"))


def in_word_order(words: DataFrame, by: list[str]) -> DataFrame:
    """Facts of inserting each group's words in sorted order; new letters add up to the group's nodes."""
    return facts(by_word(words, "num_words", by=by), by)


def in_level_order(words: DataFrame, by: list[str]) -> DataFrame:
    """Facts in the order of levels: by length, then word; one-letter words are complete before the first level."""
    return facts(numbered(words.where(F.length("word") >= 2), [F.length("word"), "word"], "num_words", by), by)


def of_list(words: DataFrame, by: list[str], order: str = "num_words") -> DataFrame:
    """Facts of a list: a word's ordinal and length only."""
    return words.select(*by, "word", F.length("word").alias("word_length"), order)


def zipped(left: DataFrame, right: DataFrame, place: str = "ord") -> DataFrame:
    """Rows of two frames side by side that have the same place; the longer one's rest goes."""
    return left.join(right, place)
