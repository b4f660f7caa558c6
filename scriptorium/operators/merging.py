"""Merging of many proposed factors into a few for each owner, as a tree reduction over tables.

A merger (a teacher, or a mock) reads a bounded list of proposals and gives a
few factors, each with the aliases of the proposals it stands for. Longer lists
are cut into chunks, each merged by itself, and the factors that come out are
the proposals of the next list, until one list is left. All chunks of all owners
are merged in the same round, a row for each. What follows from a row alone is
done where the row is: an answer that cannot be read halves its list, factors
of halves and of several requests are merged again, an answer without a sound
factor is asked for again. So rounds grow with the number of blocks of a list,
not with the depth of its tree. An item carries as many of its records as a
factor needs, which tells whether a union has so many, however large the sets
are; all records of a factor are found in the end, through the members that each
round has left in the shared folder, so no request or row grows with them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.sources.tables import materialize, number_rows, ship_package

# The kinds of operation that a factor may ask for.
OPERATION_TYPES = ("content_select", "content_omit", "structure", "compression", "lexicalization", "ordering")
# What a swapped condition becomes, and the reason given to a merged factor.
GENERAL_CONDITION = "when applicable to the current abstract"
INTERMEDIATE = "Intermediate factor from hierarchical full-profile merge."

#: Items of an open list that one row may hold; longer lists are packed block by block.
BLOCK = 4096
#: Rounds, and requests one above another within a row, after which a merger that does not shrink its lists is given up.
ROUNDS = 60
SHRINK = "the merger does not shrink its lists"

Merger = Callable[[str, list[dict]], list[dict]]
TEXTS = ("operation_type", "direction", "condition", "reason")
CALLS = (
    "owner string, node string, block long, place int, above string, operation_type string, direction string, condition string,"
    " proof array<string>, members array<string>, open boolean, stuck boolean"
)
ARROW_CALLS = pa.schema(
    [("owner", pa.string()), ("node", pa.string()), ("block", pa.int64()), ("place", pa.int32()), *((f, pa.string()) for f in ("above", *TEXTS[:3])),
     ("proof", pa.list_(pa.string())), ("members", pa.list_(pa.string())), ("open", pa.bool_()), ("stuck", pa.bool_())]
)


@dataclass(frozen=True)
class Limits:
    """Sizes of a merge: factors of an answer, records a factor needs, items of a first chunk (0: any), characters of a
    request (0: any), and further requests where an answer holds no sound factor."""

    max_factors: int = 6
    min_support: int = 1
    chunk_size: int = 0
    budget: int = 0
    retries: int = 1


class UnreadableAnswer(ValueError):
    """The merger's answer is not the JSON that was asked for (most often it was cut off)."""


class _Stuck(Exception):
    """A list within a row is not shrunk."""


def request_chars(items: list[dict]) -> int:
    return len(json.dumps(items, ensure_ascii=False))


def shown(items: list[dict]) -> list[dict]:
    """Items as the merger sees them: under short aliases, which it can copy without error."""
    return [{"alias": f"r{k + 1}", **{f: x[f] for f in TEXTS}} for k, x in enumerate(items)]


def pack(items: list[dict], budget: int) -> list[list[dict]]:
    """Runs of items, each as long as its request stays within ``budget``; one item is a run, however long."""
    if budget <= 0:
        return [items]
    runs: list[list[dict]] = []
    size = 0
    for item in items:
        # a request is the items' own texts, a separator of two before all but the first, and two brackets
        own = request_chars(shown([item])) - 2 + (len(str(len(runs[-1]) + 1)) - 1 if runs else 0)
        if runs and size + 2 + own <= budget:
            runs[-1].append(item)
            size += 2 + own
        else:
            runs.append([item])
            size = 2 + request_chars(shown([item])) - 2
    return runs


def sound_factors(answer: list[dict], aliases: dict[str, int], limits: Limits) -> list[dict]:
    """Factors of an answer with a known kind, a direction and a condition, members by the items' numbers.

    Where the direction is a mere word and the condition a whole sentence, the
    sentence is the direction. What a factor rests on is tested later.
    """
    out = []
    for k, value in enumerate(answer[: limits.max_factors]):
        kind, direction, condition = (str(value.get(f, "")).strip() for f in ("operation_type", "direction", "condition"))
        if len(direction.split()) < 4 <= len(condition.split()):
            direction, condition = condition, GENERAL_CONDITION
        members = sorted({aliases[str(a)] for a in value.get("members", []) if str(a) in aliases})
        if kind in OPERATION_TYPES and direction and condition:
            out.append({"k": k, "operation_type": kind, "direction": direction, "condition": condition, "members": members})
    return out


class _Lists:
    """Lists of one row, merged as far as the row alone decides; a made item knows the row's ``members`` and a ``proof``."""

    def __init__(self, merger: Merger, limits: Limits, rounds: int):
        self.merger, self.limits, self.rounds = merger, limits, rounds
        self.need = max(limits.min_support, 1)

    def asked(self, run: list[dict], depth: int = 0) -> list[dict]:
        """Factors of one request, or of its halves where the answer cannot be read."""
        own = shown(run)
        for attempt in range(self.limits.retries + 1):
            try:
                answer = self.merger(f"merge_repair_{attempt}" if attempt else "merge", own)
            except UnreadableAnswer:
                half = len(run) // 2
                if not half:
                    raise
                return self.merged([f for part in (run[:half], run[half:]) for f in self.asked(part, depth)], depth + 1)
            made: dict[str, dict] = {}
            for f in sound_factors(answer, {x["alias"]: k for k, x in enumerate(own)}, self.limits):
                proof = list({e: None for k in f["members"] for e in run[k]["proof"]})[: self.need]
                if len(proof) == self.need and f["operation_type"] not in made:
                    members = list({a: None for k in f["members"] for a in run[k]["members"]})
                    made[f["operation_type"]] = f | {"reason": INTERMEDIATE, "proof": proof, "members": members}
            if made:
                return list(made.values())
        return []

    def merged(self, items: list[dict], depth: int = 0) -> list[dict]:
        """Factors of a list that one row holds."""
        while items:
            if depth > self.rounds:
                raise _Stuck
            runs = pack(items, self.limits.budget)
            items = [f for run in runs for f in self.asked(run, depth)]
            if len(runs) == 1:
                break
            depth += 1
        return items


def _called(items: DataFrame, merger: Merger, limits: Limits, number: int) -> DataFrame:
    """Factors of round ``number`` for items(owner, node, pos, alias, ..., proof): final ones of lists within a block, else a next list (open)."""
    entry = F.struct("pos", "alias", *TEXTS, "proof")
    lists = items.groupBy("owner", "node", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("items"))
    blocks = items.groupBy("owner", "node").agg((F.floor(F.max("pos") / BLOCK) + 1).alias("blocks"))
    lists = lists.join(blocks, ["owner", "node"]).select("owner", "node", "block", "blocks", "items")
    rounds = ROUNDS

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Lists(merger, limits, rounds)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                own = [x | {"members": [x["alias"]]} for x in row["items"]]
                base = {"owner": row["owner"], "node": row["node"], "block": row["block"], "open": row["blocks"] > 1, "stuck": False}
                try:
                    made = [f for run in pack(own, limits.budget) for f in work.asked(run)] if base["open"] else work.merged(own)
                except _Stuck:
                    base, made = base | {"stuck": True}, [{}]
                out = [base | f | {"place": n, "above": f"{row['node']}#{number}.{row['block']}.{n}"} for n, f in enumerate(made)]
                yield pa.RecordBatch.from_pylist(out, ARROW_CALLS)

    return lists.mapInArrow(call, CALLS)


def _ranked(items: DataFrame, *order: str) -> DataFrame:
    """Items with their place ``pos`` in their list, from 0: a list of any length is numbered by many tasks."""
    numbered = number_rows(items, "owner", "node", *order)
    first = numbered.groupBy("owner", "node").agg(F.min("number").alias("_first"))
    return numbered.join(first, ["owner", "node"]).withColumn("pos", F.col("number") - F.col("_first")).drop("number", "_first", *order)


def merge_proposals(proposals: DataFrame, merger: Merger, limits: Limits = Limits()) -> DataFrame:
    """owner, factor_id, operation_type, direction, condition, support_count of the factors that are left.

    ``proposals(owner, seq, operation_type, direction, condition, reason,
    evidence_ids)``: of one owner ordered by seq, which must be its own for each
    of them. A factor needs
    ``min_support`` different records in every round; of several factors of one
    kind in an answer the first holds. A list for which no factor is sound is
    asked for again, ``retries`` times, and then has none. An owner without
    factors has no row; an empty table gives none.
    """
    return merge_with_records(proposals, merger, limits)[0]


def merge_with_records(proposals: DataFrame, merger: Merger, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """merge_proposals(), and owner, factor_id, evidence_id of all records that each factor rests on."""
    ship_package(proposals.sparkSession)
    alias = F.concat(F.lit("p"), F.col("seq").cast("string")).alias("alias")
    # numbering reads its rows twice, so what they are made of is written first
    whole = materialize(proposals.filter("owner IS NOT NULL").select("owner", F.lit("r").alias("node"), "seq", alias, *TEXTS, "evidence_ids"), "proposals")
    proof = F.slice(F.coalesce(F.array_distinct("evidence_ids"), F.array()), 1, max(limits.min_support, 1)).alias("proof")
    items = _ranked(whole.select("owner", "node", "seq", "alias", *TEXTS, proof), "seq")
    if limits.chunk_size > 0:
        longest = items.groupBy("owner").agg(F.max("pos").alias("_last"))
        cut = F.col("_last") >= limits.chunk_size
        chunk = F.concat(F.lit("r."), F.floor(F.col("pos") / limits.chunk_size).cast("string"))
        items = items.join(longest, "owner").withColumn("node", F.when(cut, chunk).otherwise(F.col("node")))
        items = items.withColumn("pos", F.when(cut, F.col("pos") % limits.chunk_size).otherwise(F.col("pos"))).drop("_last")
    made: list[DataFrame] = []  # the factors of each round

    def listed(rows: DataFrame, *order: str) -> DataFrame:
        """Factors as the items of a next list."""
        return _ranked(rows.select("owner", "node", *order, F.col("above").alias("alias"), *TEXTS[:3], F.lit(INTERMEDIATE).alias("reason"), "proof"), *order)

    def ended(items: DataFrame) -> DataFrame:
        """Final factors of all lists."""
        out = []
        while True:
            if len(made) >= ROUNDS:
                raise ValueError(SHRINK)
            calls = materialize(_called(items, merger, limits, len(made)), "calls")
            made.append(calls)
            state = calls.agg(F.max("stuck").alias("stuck"), F.max("open").alias("open")).first()
            if state["stuck"]:
                raise ValueError(SHRINK)
            out.append(calls.filter("NOT open"))
            if not state["open"]:
                return reduce(DataFrame.unionByName, out)
            items = listed(calls.filter("open"), "block", "place")

    found = ended(items)
    chunks = found.filter("node <> 'r'")
    if limits.chunk_size > 0 and not chunks.isEmpty():
        ordered = chunks.withColumn("ord", F.substring("node", 3, 20).cast("long")).withColumn("node", F.lit("r"))
        found = found.filter("node = 'r'").unionByName(ended(listed(ordered, "ord", "place")))
    named = found.withColumn("factor_id", F.concat(F.lit("f"), (F.col("place") + 1).cast("string")))

    # from the factors down to the proposals: an owner's lists end in different rounds, and what a round has not made is passed on
    reach = named.select("owner", "above", "factor_id")
    for calls in reversed(made):
        members = calls.select("owner", "above", F.explode("members").alias("member"))
        reach = reach.join(members, ["owner", "above"], "left").select("owner", F.coalesce("member", "above").alias("above"), "factor_id").distinct()
    evidence = whole.select("owner", F.col("alias").alias("above"), F.explode("evidence_ids").alias("evidence_id"))
    records = materialize(evidence.join(reach, ["owner", "above"]).select("owner", "factor_id", "evidence_id").distinct(), "records")
    support = records.groupBy("owner", "factor_id").agg(F.count("*").alias("support_count"))
    return named.select("owner", "factor_id", *TEXTS[:3]).join(support, ["owner", "factor_id"]), records


def mock_merger(mode: str, items: list[dict]) -> list[dict]:
    """One factor for each kind of operation, worded as its first item; proposals marked as long in a list of several are answered with a cut-off text."""
    if len(items) > 1 and any(x["reason"] == "long" for x in items):
        raise UnreadableAnswer("the answer was cut off")
    out: dict[str, dict] = {}
    for x in items:
        first = out.setdefault(x["operation_type"], {**{f: x[f] for f in ("operation_type", "direction", "condition")}, "members": []})
        first["members"].append(x["alias"])
    return list(out.values())
