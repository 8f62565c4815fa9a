"""Where words come from: headerless dictionary files, several-column files, texts, and literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixloom.functions.words import presence
from prefixloom.shared import cut


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """The first column of headerless dictionary or stimulus files, with each row's place in its file.

    Lines keep their file order through ``ord``: a file is read by one task if
    it is not split, and its lines are numbered as they come.
    """
    lines = spark.read.schema("word string").csv(path, header=False)
    return lines.select("word", F.monotonically_increasing_id().alias("ord"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, word: the first cell of every line of headerless files, with the line's number from 0 in its file.

    Files may be split anywhere and read by any task in any order: a line's
    place inside its split comes from its ascending id, and a split's offset is
    the count of lines in the splits before it, of which there is one row each.
    """
    lines = spark.read.text(path).select(F.split_part("value", F.lit(","), F.lit(1)).alias("word"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = cut(lines.withColumn("at", F.monotonically_increasing_id()))
    splits = rows.groupBy(F.col("file").alias("f"), F.col("start").alias("s")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("f", "s", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    return rows.join(offsets, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s"))).select("file", (F.col("at") + F.col("offset")).alias("ord"), "word")


def read_columns(spark: SparkSession, path: str, names: list[str], skip_header: bool = False) -> DataFrame:
    """Columns by position, all as text; a header line is data unless ``skip_header``."""
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, header=skip_header, enforceSchema=True)


def read_syllables(spark: SparkSession, path: str, features: int = 12, skip_header: bool = False) -> DataFrame:
    """word, length and the vector of 1 and -1 of ``features`` presence columns."""
    rows = read_columns(spark, path, ["word", "length", *(f"f{k}" for k in range(features))], skip_header)
    return rows.select("word", "length", F.array(*[presence(F.col(f"f{k}")) for k in range(features)]).alias("vector"))


def from_words(spark: SparkSession, words: list[str]) -> DataFrame:
    """An in-memory dictionary in the given order."""
    return spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, ord long")


def words_of_texts(texts: DataFrame, text: str = "text", longest: int | None = None, *keep: str) -> DataFrame:
    """The different runs of a to z of at most ``longest`` letters (None: of any length) in a text column, per value of the ``keep`` columns."""
    runs = texts.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return (runs if longest is None else runs.where(F.length("word") <= longest)).distinct()


def non_words(spark: SparkSession, dictionary: DataFrame, length: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> DataFrame:
    """All strings of ``length`` letters that are no word of the dictionary.

    The strings come from counting, so the number of rows is the alphabet's
    size to the power of the length, dealt over tasks.
    """
    n = len(alphabet)
    place = lambda k: F.substring(F.lit(alphabet), (F.floor(F.col("id") / n**k) % n + 1).cast("int"), F.lit(1))
    strings = spark.range(n**length).select(F.concat(*[place(k) for k in reversed(range(length))]).alias("word"))
    return strings.join(dictionary.select("word"), "word", "left_anti")
