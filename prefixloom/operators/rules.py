"""Table-driven programs: rule tables, exact lookup and upsert, and searches and insertions that run what the tables say.

A program says for each state the next state, an opcode, operand slots and a
destination.  Its tables are a relation; they are read once, and the states that
a run goes through become one update of a machine of five slots, which a loop
folds over the letters.  The trie enters through one equi-join that lists each
word's matching depths beforehand, with their ends and checked letters.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixloom.functions.words import letters
from prefixloom.operators.trie import spread

# The programs, in order of their states: (state, method, operands, destination).
PROGRAMS = {
    "Search": [
        (0, "init", "[]", "resultError"), (1, "getWordInit", "[0]", "0"), (2, "getSearchLoop", "[]", "resultError"), (3, "getCheckFalse", "[3]", "resultError"),
        (4, "getNodeEndCheck", "[2]", "resultError"), (5, "getTrue", "[]", "4"), (-1, "end", "[]", "resultError"),
    ],
    "SearchLoop": [
        (0, "init", "[]", "resultOut"), (1, "getNextLetter", "[0]", "1"), (2, "getCheckFalse", "[1]", "resultError"), (3, "getFalse", "[]", "3"),
        (4, "getLetterIndex", "[1]", "1"), (5, "getNextNodeId", "[2,1]", "2"), (6, "getCheckFalse", "[2]", "resultError"), (7, "getExchaustiveCheck", "[2,1]", "resultError"),
        (8, "getTrue", "[]", "3"), (-1, "end", "[]", "resultError"),
    ],
    "Insert": [
        (0, "init", "[]", "resultError"), (1, "getWordInit", "[0]", "0"), (2, "getInsertLoop", "[]", "resultError"), (3, "getCheckFalse", "[3]", "resultError"),
        (4, "setNodeEndWord", "[2]", "resultError"), (5, "getTrue", "[]", "4"), (-1, "end", "[]", "resultError"),
    ],
    "InsertLoop": [
        (0, "init", "[]", "resultOut"), (1, "getNextLetter", "[0]", "1"), (2, "getCheckFalse", "[1]", "resultError"), (3, "getFalse", "[]", "3"),
        (4, "getLetterIndex", "[1]", "1"), (5, "getNextNodeId", "[2,1]", "2"), (6, "getTrue", "[]", "3"), (-1, "end", "[]", "resultError"),
    ],
    "Loop": [(0, "init", "[]", "resultError"), (1, "getFalse", "[]", "resultError"), (2, "getCallbackResult", "[]", "resultError"), (-1, "end", "[]", "resultError")],
}
#: Where a program goes after its last numbered state; the loop program returns to its first.
AFTER_LAST = {"Loop": 1}


def next_state(program: str, state: int, error: bool) -> int:
    """An error, or the end, leads to -1; otherwise states follow one another."""
    last = max(s for s, *_ in PROGRAMS[program])
    if error or state == -1:
        return -1
    return state + 1 if state < last else AFTER_LAST.get(program, -1)


def _builtin_rows() -> list[tuple[str, str, str]]:
    rows = []
    for name, states in PROGRAMS.items():
        for error in (False, True):
            rows += [(f"{name}Sequence", f"{s},{str(error).upper()}", str(next_state(name, s, error))) for s, *_ in states]
        rows += [(f"{name}Method", str(s), m) for s, m, _, _ in states]
        if name != "Loop":
            rows += [(f"{name}Arg", str(s), a) for s, _, a, _ in states]
            rows += [(f"{name}Result", str(s), r) for s, _, _, r in states]
    return rows


def builtin_rules(spark: SparkSession) -> DataFrame:
    """The programs as one relation (model, key, out), as rule files would give it."""
    return spark.createDataFrame(_builtin_rows(), "model string, key string, out string")


def operands(rules: DataFrame) -> DataFrame:
    """The operand rows of rule tables with ``slots``, their JSON text as an array."""
    return rules.where(F.col("model").endswith("Arg")).withColumn("slots", F.from_json("out", "array<int>"))


def rule_files(spark: SparkSession, folder: str) -> list[str]:
    """The names of the CSV files of a folder, in whatever store Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName()[: -len(".csv")] for f in found if f.getPath().getName().endswith(".csv"))


def read_rules(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """Rule files of a folder (all, or those named) as (model, key, out): leading columns whose names end with In are the key, the next is the value."""
    out = None
    for name in rule_files(spark, folder) if names is None else names:
        table = spark.read.csv(f"{folder}/{name}.csv", header=True)
        keys = list(takewhile(lambda c: c.endswith("In"), table.columns))
        value = table.columns[len(keys)]
        one = table.select(F.lit(name).alias("model"), F.concat_ws(",", *keys).alias("key"), F.col(value).alias("out"))
        out = one if out is None else out.unionByName(one)
    return out


def lookup(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """``asked`` (model, key) with ``out``, null where no rule exists."""
    return asked.join(rules, ["model", "key"], "left")


def lookup_all(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``lookup``, but a missing rule is an error."""
    return lookup(asked, rules).withColumn("out", F.when(F.col("out").isNull(), F.raise_error(F.concat(F.lit("no rule "), "model", F.lit(" "), "key"))).otherwise(F.col("out")))


def upsert(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules after changes (model, key, out, seq): the change of the largest ``seq`` wins over others and over the old row."""
    every = rules.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes)
    return every.groupBy("model", "key").agg(F.max_by("out", "seq").alias("out"))


TRACE_SQL = """
WITH RECURSIVE run(program, step, state) AS (
  SELECT program, 0, 0 FROM programs
  UNION ALL
  SELECT /*+ BROADCAST(s) */ run.program, run.step + 1, CAST(s.out AS INT) FROM run JOIN rules s
    ON s.model = concat(run.program, 'Sequence') AND s.key = concat(CAST(run.state AS STRING), ',FALSE')
  WHERE run.state <> -1 AND run.step < {most})
SELECT run.program, CAST(run.step AS INT) AS step, CAST(run.state AS INT) AS state, m.out AS method, coalesce(a.out, '[]') AS operands, coalesce(r.out, 'resultError') AS destination
FROM run JOIN rules m ON m.model = concat(run.program, 'Method') AND m.key = CAST(run.state AS STRING)
LEFT JOIN rules a ON a.model = concat(run.program, 'Arg') AND a.key = CAST(run.state AS STRING)
LEFT JOIN rules r ON r.model = concat(run.program, 'Result') AND r.key = CAST(run.state AS STRING)
"""


def trace(rules: DataFrame, programs: list[str], most: int = 24) -> DataFrame:
    """Each program's states in the order of an undisturbed run, by a recursive query; at most ``most`` steps of a loop.

    Rule tables are programs of a few hundred rows, so each step may broadcast them.
    """
    spark = rules.sparkSession
    return spark.sql(TRACE_SQL.format(most=most).replace("FROM programs", "FROM {programs}").replace("JOIN rules", "JOIN {rules}"), programs=spark.createDataFrame([(p,) for p in programs], "program string"), rules=rules)


#: Rows that a relation of rule tables may have; they are read by the driver.
MOST_RULES = 10_000


@dataclass(frozen=True)
class Program:
    """The rows of one program's tables that a run without errors goes through, in order: (method, operands, destination); and whether it then starts over."""

    steps: list[tuple[str, list[int], str]] = field(default_factory=list)
    again: bool = False


def program(tables: dict[tuple[str, str], str], name: str) -> Program:
    """Follows the sequence table from state 0 to the end; a state that comes again ends the list."""
    steps, seen, state = [], set(), 0
    while True:
        try:
            state = int(tables[f"{name}Sequence", f"{state},FALSE"])
            if state == -1 or state in seen:
                return Program(steps, state != -1)
            method = tables[f"{name}Method", str(state)]
        except KeyError as e:
            raise ValueError(f"no rule {e} of program {name}") from None
        seen.add(state)
        steps.append((method, json.loads(tables.get((f"{name}Arg", str(state)), "[]")), tables.get((f"{name}Result", str(state)), "resultError")))


def tables_of(rules: DataFrame | None) -> dict[tuple[str, str], str]:
    """Rule tables by (model, key), read from a bounded relation; without one, the built-in programs."""
    if rules is None:
        return {(m, k): o for m, k, o in _builtin_rows()}
    rows = rules.select("model", "key", "out").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    return {(r.model, r.key): r.out for r in rows}


@dataclass(frozen=True)
class Machine:
    """Columns that the opcodes read: the word's letters, and for each depth at which its prefix is a node, whether it is an end and the letter that the check has for it (null: none)."""

    letters: Column
    nodes: Column | None


_STATE = "struct<place:int,letter:string,node:int,going:boolean,result:boolean,error:boolean,height:int>"
_FIELDS = ("place", "letter", "node", "going", "result", "error", "height")
_SLOTS = {"1": "letter", "2": "node", "3": "going", "4": "result"}
_NAMES = {int(k): v for k, v in _SLOTS.items()}


def _run(state: Column, steps: Program, m: Machine) -> Column:
    """The state after a program: one update, with a way out at each opcode that may report an error.

    Opcodes that return nothing here (loops, end marks of insertion) are the
    caller's part.
    """
    now = {k: state[k] for k in _FIELDS}
    exits: list[tuple[Column, Column]] = []

    def record(**changed: Column) -> Column:
        return F.struct(*[{**now, **changed}[k].alias(k) for k in _FIELDS]).cast(_STATE)

    def node(k: int) -> Column:
        return F.element_at(m.nodes, now[_NAMES[k]])

    for method, operands, destination in steps.steps:
        out = None
        if method == "getNextLetter":
            out = F.get(m.letters, now["place"])
            now["place"] = now["place"] + 1
        elif method == "getLetterIndex":
            out = (F.ascii(now[_NAMES[operands[0]]]) - 97).cast("string")
        elif method == "getNextNodeId":
            below = now["node"] + 1
            out = below if m.nodes is None else F.when(F.element_at(m.nodes, below).isNotNull(), below)
            now["height"] = F.when(out.isNotNull(), now["height"] + 1).otherwise(now["height"])
        elif method in ("getTrue", "getFalse"):
            out = F.lit(method == "getTrue")
        elif method == "getCheckFalse":
            value = now[_NAMES[operands[0]]]
            out = value.isNull() if operands[0] in (1, 2) else ~F.coalesce(value, F.lit(False))
        elif method == "getNodeEndCheck":
            out = ~F.coalesce(node(operands[0])["is_end"], F.lit(False))
        elif method == "getExchaustiveCheck":
            out = ~node(operands[0])["letter"].cast("string").eqNullSafe(now[_NAMES[operands[1]]])
        if out is None:
            continue
        if destination in _SLOTS:
            now[_SLOTS[destination]] = out
        elif destination == "resultError" and method.startswith("get") and method not in ("getTrue", "getFalse"):
            exits.append((out, record(error=F.lit(True))))
    after = record()
    for reason, then in reversed(exits):
        after = F.when(reason, then).otherwise(after)
    return after


def _outer(tables: dict[tuple[str, str], str], name: str, m: Machine) -> Column:
    """A whole program: the loop opcode runs the program Loop, whose callback is the body, until an error ends it, which ends only the loop.

    A Loop program that comes to its end instead of starting over runs its body once; one without a callback never does.
    Tables without that program loop as the built-in one says.
    """
    zero = F.lit(0)
    start = F.struct(zero.alias("place"), F.lit(None).alias("letter"), zero.alias("node"), F.lit(False).alias("going"), F.lit(False).alias("result"), F.lit(False).alias("error"), zero.alias("height")).cast(_STATE)
    body = program(tables, f"{name}Loop")
    loop = program(tables if ("LoopSequence", "0,FALSE") in tables else tables_of(None), "Loop")
    called = [k for k, (method, _, _) in enumerate(loop.steps) if method == "getCallbackResult"]

    def once(s: Column) -> Column:
        done = 0
        for k in called:
            s = _run(_run(s, Program(loop.steps[done:k]), m), body, m) if k > done else _run(s, body, m)
            done = k + 1
        return _run(s, Program(loop.steps[done:]), m) if done < len(loop.steps) else s

    times = F.sequence(zero, F.size(m.letters)) if loop.again and called else F.array(zero)  # each round takes a letter, or finds that there is none
    looped = F.aggregate(times, start, lambda s, _: F.when(s["error"], s).otherwise(once(s)))
    outer = program(tables, name)
    fresh = lambda s: F.struct(*[(F.lit(False) if k == "error" else s[k]).alias(k) for k in _FIELDS]).cast(_STATE)
    ended = F.transform(F.array(looped), lambda s: _run(fresh(s), outer, m))
    return F.explode(ended)  # a row of its own, so that reading several of its fields runs the program once


def search(queries: DataFrame, nodes: DataFrame, stop_at_space: bool = True, rules: DataFrame | None = None) -> DataFrame:
    """found and height of each query by the Search program of ``rules`` (the built-in one if there are none).

    The letter that the exhaustive check compares is the node's ``letter_index``
    as the relation has it; height counts the nodes that were entered.
    """
    asked = queries.select("word").distinct()
    cutoff = asked.select(F.col("word").alias("whole_word"), (F.split_part("word", F.lit(" "), F.lit(1)) if stop_at_space else F.col("word")).alias("word"))
    letter = F.col("letter_index") if "letter_index" in nodes.columns else F.ascii(F.substring(F.reverse("prefix"), 1, 1)) - 97
    hits = spread(cutoff.select("word").distinct()).join(nodes.select("prefix", "is_end", "depth", letter.alias("letter")), "prefix")
    entry = F.struct(F.col("depth").cast("int").alias("depth"), F.struct("is_end", "letter").alias("node"))
    hits = hits.groupBy(F.col("word").alias("its")).agg(F.map_from_entries(F.collect_list(entry)).alias("nodes"))
    rows = cutoff.join(hits, F.col("word") == F.col("its"), "left")
    machine = Machine(letters(F.col("word")), F.col("nodes"))
    out = rows.select("whole_word", _outer(tables_of(rules), "Search", machine).alias("m"))
    return out.select(F.col("whole_word").alias("word"), F.col("m.result").alias("found"), F.col("m.height").alias("height"))


def insert(words: DataFrame, stop_at_space: bool = True, rules: DataFrame | None = None) -> DataFrame:
    """Nodes (prefix, is_end) that the Insert program makes of the words; the empty word makes none."""
    rows = words.select("word").distinct()
    machine = Machine(letters(F.col("word"), stop_at_space), None)
    run = rows.select(machine.letters.alias("letters"), _outer(tables_of(rules), "Insert", machine).alias("m")).where("m.result")
    made = run.select(F.explode(F.sequence(F.lit(1), F.col("m.height"))).alias("depth"), "letters", "m.node")
    return made.groupBy(F.array_join(F.slice("letters", F.lit(1), F.col("depth")), "").alias("prefix")).agg(F.max(F.col("depth") == F.col("node")).alias("is_end"))
