"""Rows that do not fit the alphabet, set apart with the reason, and counts observed while they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from prefixloom.functions.words import in_alphabet


def checked(words: DataFrame) -> DataFrame:
    """Every row with ``reason``: null for a word of a to z, else missing, empty, upper case, or other characters."""
    word = F.col("word")
    reason = F.when(word.isNull(), "missing").when(word == "", "empty").when(in_alphabet(word), None).when(in_alphabet(F.lower(word)), "upper case").otherwise("other characters")
    return words.withColumn("reason", reason)


def quarantine(words: DataFrame, path: str) -> dict[str, int]:
    """Writes good rows to ``kept=true`` and rejected ones, with their reasons, to ``kept=false`` under ``path``, in one pass; gives the counts seen meanwhile.

    The counts (read, kept, rejected) come from the writing job itself, in
    place of a second pass or a clock.
    """
    seen = Observation()
    kept = F.col("reason").isNull()
    rows = checked(words).observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"))
    rows.withColumn("kept", kept).write.partitionBy("kept").parquet(path)
    return dict(seen.get)
