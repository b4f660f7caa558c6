"""Factors of many samples built in rounds: propose, assign, prune, select a cover, and ask again for what is left uncovered.

Every round works on all samples that are not covered yet. Features are a table
with the factor that each round has assigned to them (one or none); a sample's
features that were assigned alike are one pattern with a count, so what a choice
of factors takes is a row of bounded size, however many features a sample has:
at most (factors of a round + 1) ^ rounds patterns. Both the proposer and the
assigner are given as functions and run in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.sources.tables import discard, materialize, ship_package

Proposer = Callable[[str, list[str], list[str], int, int], list[str]]
Assigner = Callable[[str, list[str]], int]
STATE = (
    "id string, n long, uncovered long, overlap double, factors array<string>, memory array<string>, selected array<int>"
)
ARROW_STATE = pa.schema(
    [("id", pa.string()), ("n", pa.int64()), ("uncovered", pa.int64()), ("overlap", pa.float64()),
     ("factors", pa.list_(pa.string())), ("memory", pa.list_(pa.string())), ("selected", pa.list_(pa.int32()))]
)
#: Parts that a sample's features are ranked in before the best of each are ranked together.
SALTS = 64


@dataclass(frozen=True)
class Settings:
    """Rounds at most, the share of features that must be covered, penalties of overlap and of what stays uncovered, the
    shares that a factor must lie between, features shown to the proposer, and factors that it may give in a round."""

    rounds: int = 3
    threshold: float = 0.9
    overlap: float = 4.0
    uncovered: float = 8.0
    least: float = 0.0
    most: float = 0.4
    shown: int = 32
    proposed: int = 16


def prune(support: list[int], n: int, settings: Settings, iteration: int) -> list[int]:
    """Factors whose support lies in range. After the first round, where fewer than ten do, all with any support, those out of
    range first; if there is none, the four best supported."""
    least = 1 if iteration else max(1, int(n * settings.least))
    most = int(n * settings.most)
    keep = [k for k, s in enumerate(support) if least <= s <= most]
    if iteration and len(keep) < 10:
        keep = [k for k, s in enumerate(support) if s > 0 and k not in set(keep)] + keep
    return keep or [k for k in sorted(range(len(support)), key=lambda k: -support[k])[:4] if support[k] > 0]


def select_cover(
    patterns: list[tuple[frozenset[int], int]], columns: list[int], new: set[int], preferred: set[int], iteration: int, overlap: float, settings: Settings
) -> list[int]:
    """Up to 8 + 2 * iteration of ``columns``: new ones first, then those chosen before that cover more, then by gain.

    A gain is twice the features newly covered, less the penalties of those
    covered more than once and of those that stay uncovered; after the first
    round the penalties are a half and four fifths of theirs. Of equal gains the
    earlier column wins. If nothing is chosen, the five best supported are.
    """
    n = sum(count for _, count in patterns)
    limit = min(8 + 2 * iteration, len(columns))
    support = {c: sum(count for held, count in patterns if c in held) for c in columns}
    times = [0] * len(patterns)  # how often each pattern's features are covered
    chosen: list[int] = []

    def take(column: int) -> None:
        chosen.append(column)
        for k, (held, _) in enumerate(patterns):
            times[k] += column in held

    def newly(column: int) -> int:
        return sum(count for (held, count), t in zip(patterns, times, strict=True) if column in held and not t)

    for column in (c for c in columns if c in new):
        if len(chosen) < limit and support[column] > 0:
            take(column)
    for column in (c for c in columns if c in preferred):
        if len(chosen) < limit and column not in chosen and newly(column) > 0:
            take(column)
    on_overlap, on_rest = (overlap, settings.uncovered) if iteration == 0 else (overlap * 0.5, settings.uncovered * 0.8)
    while len(chosen) < limit:
        rest = [c for c in columns if c not in chosen]
        again = sum(count * max(0, t - 1) for (_, count), t in zip(patterns, times, strict=True))
        covered = sum(count for (_, count), t in zip(patterns, times, strict=True) if t)

        def gain(column: int) -> float:
            more = newly(column)
            twice = again + support[column] - more  # a feature covered once more than the first time
            left = n - covered - more
            # the penalty of what is left is taken off the penalty of overlap, as the method states it
            return 2 * more - (on_overlap * twice - on_rest * left)

        best = max(rest, key=gain)
        take(best)
    if not chosen:
        chosen = [c for c in sorted(columns, key=lambda c: -support[c])[:5] if support[c] > 0]
    return chosen


def advance(row: dict, iteration: int, settings: Settings) -> dict:
    """A sample's next state out of its state, the factors just proposed and its patterns."""
    state = {name: row[name] for name in ARROW_STATE.names}
    overlap = row["overlap"] * (0.5 if iteration and row["uncovered"] > 0.3 * row["n"] else 1.0)
    state["overlap"] = overlap
    if not row["new"]:
        return state
    patterns = [(frozenset(c for c in p["chosen"] if c >= 0), p["count"]) for p in row["patterns"]]
    factors = row["factors"] + row["new"]
    state["factors"] = factors
    support = [sum(count for held, count in patterns if k in held) for k in range(len(factors))]
    columns = prune(support, row["n"], settings, iteration)
    if not columns:
        return state
    fresh, before = set(row["new"]), set(row["memory"])
    new, preferred = ({k for k in columns if factors[k] in names} for names in (fresh, before))
    chosen = select_cover(patterns, columns, new, preferred, iteration, overlap, settings)
    covered = set(chosen)
    uncovered = sum(count for held, count in patterns if not held & covered)
    return state | {"selected": chosen, "memory": [*row["memory"], *(factors[k] for k in chosen if factors[k] not in before)], "uncovered": uncovered}


def first_of_each(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each id: ranked in parts first, so that an id with most of all rows is not ranked by one task."""
    part = Window.partitionBy("id", "_part").orderBy(*order)
    best = rows.withColumn("_part", F.pmod(F.xxhash64("place"), F.lit(SALTS))).withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= k)
    whole = Window.partitionBy("id").orderBy(*order)
    return best.drop("_part").withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= k)


def build_factors(features: DataFrame, propose: Proposer, assign: Assigner, settings: Settings = Settings(), seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """id, place, feature, factors (those chosen that hold it, in order), and id, rank, factor of the choice for each sample.

    ``features(id, place, feature)``: places tell a sample's features apart;
    rows without id are left out.
    ``propose(id, shown features, known factors, uncovered, attempt)`` names
    factors, known and repeated ones of which are left out; after the first
    round it is asked up to three times where over ten features are uncovered.
    ``assign(feature, factors)`` gives a place in the list, or any other number
    for none. A sample ends when ``threshold`` of its features are covered or
    after ``rounds``; features that the chosen factors leave uncovered are then
    assigned once more among these, and have no factor where that fails too. A
    sample of no features has no row.
    """
    spark = features.sparkSession
    ship_package(spark)
    start = features.filter("id IS NOT NULL").select(F.col("id").cast("string").alias("id"), "place", "feature", F.array().cast("array<int>").alias("chosen"))
    table = materialize(start, "features")
    none = F.array().cast("array<string>")
    counted = table.groupBy("id").agg(F.count("*").alias("n"))
    begin = counted.select(
        "id", "n", F.col("n").alias("uncovered"), F.lit(settings.overlap).alias("overlap"), none.alias("factors"), none.alias("memory"), F.array().cast("array<int>").alias("selected")
    )
    states = materialize(begin, "states")

    for iteration in range(settings.rounds):
        active = states.filter(1.0 - F.col("uncovered") / F.col("n") < settings.threshold)
        if active.isEmpty():
            break
        open_features = table.join(active.select("id", "selected"), "id").filter(~F.arrays_overlap("chosen", "selected"))
        order = [F.sha2(F.concat_ws(":", F.lit(seed), "id", F.lit(str(iteration)), F.col("place").cast("string")), 256)] if iteration else [F.col("place")]
        focus = first_of_each(open_features.select("id", "place", "feature"), settings.shown, *order)
        focus = focus.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "feature"))), lambda x: x["feature"]).alias("focus"))
        asked = active.select("id", "uncovered", "factors").join(focus, "id")
        made = materialize(_proposed(asked, propose, iteration, settings), "proposed")
        known = made.join(states.select("id", F.size("factors").alias("base")), "id")
        next_table = materialize(_assigned(table.join(known, "id", "left"), assign), "features")
        patterns = next_table.join(made.select("id"), "id", "left_semi").groupBy("id", "chosen").agg(F.count("*").alias("count"))
        patterns = patterns.groupBy("id").agg(F.collect_list(F.struct("chosen", "count")).alias("patterns"))
        rows = active.join(made, "id", "left").join(patterns, "id", "left")
        rest = states.join(active.select("id"), "id", "left_anti")
        next_states = materialize(_advanced(rows, iteration, settings).unionByName(rest), "states")
        discard(table, states, made)
        table, states = next_table, next_states

    chosen = states.select("id", F.expr("transform(selected, k -> factors[k])").alias("names"), "selected")
    held = table.join(chosen, "id", "left")
    factors = F.transform("selected", lambda k, i: F.when(F.array_contains("chosen", k), F.get(F.col("names"), i)))
    marked = held.select("id", "place", "feature", F.array_compact(factors).alias("factors"), "names")
    return _left_over(marked, assign), chosen.select("id", F.posexplode("names").alias("rank", "factor"))


def _proposed(asked: DataFrame, propose: Proposer, iteration: int, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                new: list[str] = []
                for attempt in range(3 if iteration and x["uncovered"] > 10 else 1):
                    names = propose(x["id"], x["focus"], x["factors"], x["uncovered"], attempt)
                    new = [f for f in dict.fromkeys(map(str, names)) if f not in x["factors"]]
                    if new:
                        break
                if len(new) > settings.proposed:
                    raise ValueError(f"the proposer gave {len(new)} factors; {settings.proposed} were asked for")
                if new:
                    out.append({"id": x["id"], "new": new})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.string()), ("new", pa.list_(pa.string()))]))

    return asked.mapInArrow(run, "id string, new array<string>")


def _assigned(rows: DataFrame, assign: Assigner) -> DataFrame:
    """Features with the factor of this round added to what they were assigned, -1 for none; others as they are."""
    place = next(f for f in rows.schema.fields if f.name == "place").dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for x in batch.select(["feature", "chosen", "new", "base"]).to_pylist():
                own = x["chosen"]
                if x["new"]:
                    k = assign(x["feature"], x["new"])
                    own = [*own, x["base"] + k if 0 <= k < len(x["new"]) else -1]
                chosen.append(own)
            columns = [batch.column(n) for n in ("id", "place", "feature")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(chosen, pa.list_(pa.int32()))], ["id", "place", "feature", "chosen"])

    return rows.mapInArrow(run, f"id string, place {place}, feature string, chosen array<int>")


def _advanced(rows: DataFrame, iteration: int, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([advance(x, iteration, settings) for x in batch.to_pylist()], ARROW_STATE)

    return rows.mapInArrow(run, STATE)


def _left_over(rows: DataFrame, assign: Assigner) -> DataFrame:
    place = next(f for f in rows.schema.fields if f.name == "place").dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.select(["feature", "factors", "names"]).to_pylist():
                own = x["factors"]
                if not own and x["names"]:
                    k = assign(x["feature"], x["names"])
                    own = [x["names"][k]] if 0 <= k < len(x["names"]) else []
                found.append(own)
            columns = [batch.column(n) for n in ("id", "place", "feature")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.string()))], ["id", "place", "feature", "factors"])

    return rows.mapInArrow(run, f"id string, place {place}, feature string, factors array<string>")


def mock_proposer(sample: str, focus: list[str], known: list[str], uncovered: int, attempt: int) -> list[str]:
    """The commonest first letters of the words shown, three of them that are not known yet."""
    letters: dict[str, int] = {}
    for feature in focus:
        for word in feature.split():
            letters[word[0]] = letters.get(word[0], 0) + 1
    ranked = sorted(letters, key=lambda x: (-letters[x], x))
    return [f"begins with {x}" for x in ranked if f"begins with {x}" not in known][:3]


def mock_assigner(feature: str, factors: list[str]) -> int:
    """The first factor whose letter begins one of the first two words."""
    initials = {w[0] for w in feature.split()[:2]}
    return next((k for k, f in enumerate(factors) if f[-1] in initials), -1)
