"""Requests to unreliable endpoints in rounds: every round asks what the log of all rounds before has no end for.

The log is a Parquet folder, a part for each round, committed whole. A run that
is stopped goes on with the first round that is missing; equal requests are one
key, and a key that has its answer is not asked again. An endpoint that fails
too often is left alone for some rounds (its circuit is open), then tried with a
share of the keys, and used again if these fare well. A key whose answers cannot
be read, or that no endpoint serves, ends with a status of its own instead of
holding up the others. What a round may ask at once is its number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import repair
from scriptorium.sources.connectors import cache_key
from scriptorium.sources.tables import materialize, ship_package

LOG = "key string, endpoint string, outcome string, value string, response string"
# Fixed value: what is added to a prompt whose answer could not be read.
ASK_AGAIN = (
    "\n\nIMPORTANT JSON RETRY: The previous response could not be parsed as complete JSON. Return the complete JSON object"
    " again, close every string and bracket, and output no text outside the JSON object."
)


@dataclass(frozen=True)
class Endpoint:
    """A name and what answers a prompt; an error of ``ask`` is a failure of the endpoint."""

    name: str
    ask: Callable[[str], str]


@dataclass(frozen=True)
class Policy:
    """Unreadable answers and failures that end a key, when a circuit opens and for how many rounds, the share of keys that
    try it then, requests at once, and whether a round with a key that ended badly is the last."""

    unreadable: int = 6
    failures: int = 6
    trip: float = 0.1
    cooldown: int = 2
    probe: float = 0.0625
    parallel: int = 8
    scalar: bool = False
    fail_fast: bool = False


class RequestsFailed(RuntimeError):
    """Some keys ended without an answer and the policy does not go on; what was answered is in the log."""


def rounds_of(spark: SparkSession, log: str) -> list[int]:
    """Numbers of the rounds that are committed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(log)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    parts = [p.getPath() for p in system.listStatus(folder)]
    done = [p for p in parts if p.getName().startswith("round=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """All committed attempts with their round."""
    parts = [spark.read.schema(LOG).parquet(f"{log}/round={r}").withColumn("round", F.lit(r)) for r in rounds_of(spark, log)]
    out = spark.createDataFrame([], f"{LOG}, round int")
    for part in parts:
        out = out.unionByName(part)
    return out


def states(log: DataFrame, policy: Policy) -> DataFrame:
    """key, unreadable, failed, attempts, status (null while it is to be asked) and its last endpoint and value."""
    unreadable, failed = (F.sum((F.col("outcome") == o).cast("long")) for o in ("unreadable", "failed"))
    last = F.max_by(F.struct("outcome", "endpoint", "value"), "round")
    found = log.groupBy("key").agg(F.count("*").alias("attempts"), unreadable.alias("unreadable"), failed.alias("failed"), last.alias("last"))
    status = (
        F.when(F.col("last.outcome") == "answered", "answered")
        .when(F.col("unreadable") >= policy.unreadable, "unreadable")
        .when(F.col("failed") >= policy.failures, "failed")
    )
    return found.select("key", "attempts", "unreadable", "failed", status.alias("status"), "last.endpoint", "last.value")


def closed_until(history: list[tuple[int, str, int, int]], name: str, policy: Policy) -> dict[int, str]:
    """The circuit of an endpoint (closed, open or probing) for each round from 0 to one past the last of ``history``.

    ``history`` has (round, endpoint, asked, failed). A round in which more than
    the share ``trip`` failed opens it for ``cooldown`` rounds; the next one only
    probes, and what comes of the probes closes or opens it again.
    """
    seen = {r: (asked, failed) for r, e, asked, failed in history if e == name}
    out, opened = {0: "closed"}, None
    for r in range(max([h[0] for h in history], default=-1) + 1):
        asked, failed = seen.get(r, (0, 0))
        if asked and failed > policy.trip * asked:
            opened = r
        elif asked:
            opened = None
        out[r + 1] = "closed" if opened is None else "open" if r - opened < policy.cooldown else "probing"
    return out


def route(todo: DataFrame, endpoints: Sequence[Endpoint], circuits: list[str], policy: Policy) -> DataFrame:
    """``endpoint`` of each key: the first whose circuit lets it through; the last one takes what is left."""
    share = F.pmod(F.xxhash64("key", "attempts"), F.lit(1 << 20)) < int(policy.probe * (1 << 20))
    chosen = F.lit(endpoints[-1].name)
    for endpoint, circuit in reversed(list(zip(endpoints[:-1], circuits[:-1], strict=True))):
        through = {"closed": F.lit(True), "open": F.lit(False), "probing": share}[circuit]
        chosen = F.when(through, endpoint.name).otherwise(chosen)
    return todo.withColumn("endpoint", chosen)


def _asked(todo: DataFrame, endpoints: Sequence[Endpoint], policy: Policy) -> DataFrame:
    """One attempt for each key of ``todo(key, prompt, unreadable, endpoint)``."""
    by_name = {e.name: e.ask for e in endpoints}
    names = [f.split()[0] for f in LOG.split(", ")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                try:
                    response = by_name[x["endpoint"]](x["prompt"] + ASK_AGAIN * bool(x["unreadable"]))
                except Exception as error:  # whatever an endpoint raises is its failure
                    rows.append((x["key"], x["endpoint"], "failed", None, f"{type(error).__name__}: {error}"))
                    continue
                try:
                    value = repair._compact(repair.extract(response, policy.scalar))
                    rows.append((x["key"], x["endpoint"], "answered", value, response))
                except (ValueError, RecursionError):
                    rows.append((x["key"], x["endpoint"], "unreadable", None, response))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 5, names)

    return todo.select("key", "prompt", "unreadable", "endpoint").mapInArrow(ask, LOG)


def ask_in_rounds(requests: DataFrame, endpoints: Sequence[Endpoint], log: str, policy: Policy = Policy(), provider: str = "teacher") -> DataFrame:
    """id, key, status, endpoint, attempts, value for every row of ``requests(id, task, prompt)``.

    ``log`` is a folder that lives on between runs. Rounds end when every key
    has a status, at most after ``unreadable + failures`` of them. Null prompts
    are empty ones; rows of one task and prompt share an attempt and its end; no
    requests make no round.
    """
    spark = requests.sparkSession
    ship_package(spark)
    filled = requests.withColumn("prompt", F.coalesce("prompt", F.lit("")))
    keyed = materialize(filled.select("id", cache_key(F.col("task"), F.col("prompt"), provider).alias("key"), "prompt"), "requests")
    distinct = keyed.select("key", "prompt").dropDuplicates(["key"])
    for _ in range(policy.unreadable + policy.failures + 1):
        done = rounds_of(spark, log)
        r = len(done)
        if done != list(range(r)):
            raise ValueError("the log lacks a round before its last")
        attempts = read_log(spark, log)
        known = states(attempts, policy)
        ended_badly = known.filter("status <> 'answered'").join(distinct.select("key"), "key", "left_semi")
        if policy.fail_fast and r and (bad := ended_badly.select("key", "status").take(3)):
            raise RequestsFailed(", ".join(f"{b['key'][:12]} {b['status']}" for b in bad))
        open_keys = distinct.join(known.filter("status IS NOT NULL").select("key"), "key", "left_anti")
        todo = open_keys.join(known.select("key", "attempts", "unreadable"), "key", "left").fillna(0, ["attempts", "unreadable"])
        if todo.isEmpty():
            break
        counted = attempts.groupBy("round", "endpoint").agg(F.count("*"), F.sum((F.col("outcome") == "failed").cast("long")))
        history = [tuple(x) for x in counted.collect()]  # a row for each round and endpoint
        circuits = [closed_until(history, e.name, policy)[r] if history else "closed" for e in endpoints]
        routed = route(todo, endpoints, circuits, policy).repartition(policy.parallel, "key")
        _asked(routed, endpoints, policy).write.mode("overwrite").parquet(f"{log}/round={r}")
    final = states(read_log(spark, log), policy)
    return keyed.select("id", "key").join(final.select("key", "status", "endpoint", "attempts", "value"), "key").select(
        "id", "key", "status", "endpoint", "attempts", "value"
    )


def faulty_primary(prompt: str) -> str:
    """A mock that is down for every fifth number in a prompt's first word, and cuts off every third answer."""
    number = int(prompt.split()[0])
    if number % 5 == 0:
        raise ConnectionError("no route to the endpoint")
    return f'{{"output":"{number}"}}' if number % 3 or ASK_AGAIN in prompt else '"cut off'


def faulty_fallback(prompt: str) -> str:
    """A mock that answers, but with words alone for every thirty-fifth number."""
    number = int(prompt.split()[0])
    return "Sorry, I cannot." if number % 35 == 0 else f'Here: {{"output":"{number} again"}}'
