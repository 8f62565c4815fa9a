"""The two experiments as plans: access (search of known and unknown stimuli) and growth (words inserted one by one)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixloom.operators import growth, sampling, trie


def limits(words: DataFrame, low: int, high: int) -> DataFrame:
    """letters, rows, num_words of each length limit that some word fits: its words with and without repeats. One row a limit at most."""
    each = words.where(F.length("word") <= high).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    lengths = each.groupBy(F.length("word").alias("its")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"))
    swept = lengths.withColumn("letters", F.explode(F.sequence(F.lit(low), F.lit(high)))).where(F.col("its") <= F.col("letters"))
    return swept.groupBy("letters").agg(F.sum("n").alias("rows"), F.sum("m").alias("num_words"))


def stimuli(words: DataFrame, others: DataFrame, low: int, high: int, batches: int, k: int = 2) -> DataFrame:
    """(letters, batch, word, is_known): for each length limit and batch a k-th of the words, and as many non-words.

    Each batch has its own random order, that of hashes of word and batch.  All
    batches of a limit draw alike many words, so one row a limit says how many.
    """
    share = F.floor(F.col("rows") / k)
    sizes = F.broadcast(limits(words, low, high).select("letters", F.when(share == 0, F.col("rows")).otherwise(share).alias("n")))

    def drawn(rows: DataFrame, known: bool) -> DataFrame:
        swept = sampling.trials(sampling.sweep(rows.select("word"), low, high), batches)
        placed = sampling.shuffled(swept, F.col("batch"), ["letters", "batch"]).join(sizes, "letters")
        return placed.where(F.col("place") < F.col("n")).select("letters", "batch", "word", F.lit(known).alias("is_known"))

    return drawn(words, True).unionByName(drawn(others, False))


def heights(asked: DataFrame, words: DataFrame, low: int, high: int) -> DataFrame:
    """word, found, and heights: its height in the trie of the words up to each limit, low to high.

    The tries of all limits are one: a node is in a limit's trie just if the
    shortest word that made it is within the limit.  So words are spread and
    met once, whatever the number of limits, and heights combine before the
    shuffle.
    """
    nodes = trie.spread(words.where(F.length("word") <= high)).groupBy("prefix").agg(F.max("whole").alias("is_end"), F.min(F.length("word")).alias("least"))
    met = trie.spread(asked.select("word").distinct()).join(nodes, "prefix")
    depth = F.length("prefix")
    columns = [F.coalesce(F.max(F.when(F.col("least") <= x, depth)), F.lit(0)).alias(f"h{x}") for x in range(low, high + 1)]
    each = met.groupBy("word").agg(F.max(F.col("whole") & F.col("is_end")).alias("found"), *columns)
    return each.select("word", "found", F.array(*[f"h{x}" for x in range(low, high + 1)]).alias("heights"))


def access(words: DataFrame, others: DataFrame, low: int = 3, high: int = 9, batches: int = 10, k: int = 2) -> DataFrame:
    """Fact rows of the access experiment; a limit's trie holds the words up to that length."""
    rows = stimuli(words, others, low, high, batches, k)
    met = heights(words.select("word").unionByName(others.select("word")), words, low, high)
    numbers = F.broadcast(limits(words, low, high).select("letters", "num_words"))
    out = rows.join(met, "word", "left").join(numbers, "letters")
    return out.select(
        "letters", "batch", "word", F.col("is_known").alias("word_known"), F.length("word").alias("word_length"), "num_words",
        F.coalesce("found", F.lit(False)).alias("result"), F.coalesce(F.get("heights", F.col("letters") - low), F.lit(0)).alias("height"),
    )


def confusion(facts: DataFrame) -> DataFrame:
    """Rows by limit, truth and result; an exact store has no row where the two differ."""
    return facts.groupBy("letters", "word_known", "result").agg(F.count(F.lit(1)).alias("n"), F.sum("height").alias("heights"))


def growth_sweep(words: DataFrame, low: int = 3, high: int = 11) -> DataFrame:
    """Fact rows of sorted insertion for each length limit."""
    return growth.in_word_order(sampling.sweep(words.select("word").distinct(), low, high), ["letters"])


def mean_of_repeats(rows: DataFrame, by: list[str], value: str, repeats: int) -> DataFrame:
    """The mean of a measured total over its repeats."""
    return rows.groupBy(*by).agg((F.sum(value) / F.lit(repeats)).alias("mean"))
