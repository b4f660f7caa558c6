"""Tables published with a manifest, in one move, and readers that refuse what does not match it.

A version is written to a folder beside the published ones, counted, and moved
to its place with its manifest inside. A writer that dies leaves a folder that
no reader looks at; a reader takes the last version whose manifest is there.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import clean_title

MANIFEST = "MANIFEST.json"


class GateError(ValueError):
    """A table is missing, or its manifest does not allow what it is wanted for."""


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and place of the published versions, first to last."""
    system, folder = _hadoop(spark, path)
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    numbers = sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())
    return [(k, f"{path}/v{k}") for k in numbers if system.exists(_hadoop(spark, f"{path}/v{k}/{MANIFEST}")[1])]


def _text_of(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())  # a manifest is one line


def digest(rows: DataFrame) -> dict[str, int]:
    """Rows, and the sum of their hashes: the same for any order and partitioning."""
    hashed = rows.select(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(rows.columns)]).cast("decimal(20,0)").alias("h"))
    found = hashed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).alias("hashes")).first()
    return {"rows": found["rows"], "hashes": int(found["hashes"])}


def publish(rows: DataFrame, path: str, facts: dict[str, Any] | None = None) -> dict[str, Any]:
    """Write ``rows`` as the next version of ``path`` with a manifest of its counts, columns and ``facts``; returns the manifest.

    The manifest counts what was written, not what was planned. Two writers
    that want one version do not mix: the second one's move fails, and its
    folder stays unread.
    """
    spark = rows.sparkSession
    system, _ = _hadoop(spark, path)
    number = _versions(spark, path)[-1][0] + 1 if _versions(spark, path) else 0
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    rows.write.mode("error").parquet(f"{staging}/data")
    written = spark.read.schema(rows.schema).parquet(f"{staging}/data")
    manifest = {"version": number, "columns": {n: t for n, t in rows.dtypes}, **digest(written), "facts": facts or {}}
    out = system.create(_hadoop(spark, f"{staging}/{MANIFEST}")[1], False)
    out.write(bytearray((json.dumps(manifest, sort_keys=True) + "\n").encode()))
    out.close()
    place = _hadoop(spark, f"{path}/v{number}")[1]
    if system.exists(place) or not system.rename(_hadoop(spark, staging)[1], place):
        raise GateError(f"version {number} of {path} was published by another writer")
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict[str, Any]:
    versions = _versions(spark, path)
    if not versions:
        raise GateError(f"nothing is published at {path}")
    return json.loads(_text_of(spark, f"{versions[-1][1]}/{MANIFEST}"))


def read_published(
    spark: SparkSession, path: str, require: dict[str, Any] | None = None, forbid: dict[str, Any] | None = None, verify: bool = False
) -> DataFrame:
    """The last version, if its facts have all that ``require`` says and none of what ``forbid`` says.

    A fact that the manifest does not have is neither. With ``verify`` the rows
    are counted and hashed anew, which reads the whole table.
    """
    versions = _versions(spark, path)
    manifest = manifest_of(spark, path)
    facts = manifest["facts"]
    wrong = [f"{k} is {facts.get(k)!r}, not {v!r}" for k, v in (require or {}).items() if facts.get(k) != v]
    wrong += [f"{k} is {v!r}" for k, v in (forbid or {}).items() if k in facts and facts[k] == v]
    if wrong:
        raise GateError(f"{path} is refused: {'; '.join(wrong)}")
    rows = spark.read.parquet(f"{versions[-1][1]}/data")
    if dict(rows.dtypes) != manifest["columns"]:
        raise GateError(f"{path} is refused: its columns are not those of its manifest")
    if verify and digest(rows) != {k: manifest[k] for k in ("rows", "hashes")}:
        raise GateError(f"{path} is refused: its rows are not those of its manifest")
    return rows


def read_keyed(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The last row of each key of a published table; no rows where nothing is published."""
    if not _versions(spark, path):
        return spark.createDataFrame([], schema)
    rows = read_published(spark, path)
    placed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_r"), F.monotonically_increasing_id().alias("_at"))
    return placed.groupBy(F.col(f"_r.`{key}`").alias("_key")).agg(F.max_by("_r", "_at").alias("_r")).select("_r.*")


def shared_parents(spark: SparkSession, path: str) -> DataFrame:
    """A published parent pool with ``parent``, its first text as a clean title; empty pools fail the query.

    Refused where seeds were among the parents or the pool was made without
    history, by its manifest.
    """
    rows = read_published(spark, path, forbid={"seed_parent_used": True, "history_used": False})
    filled = F.assert_true(F.size("parent_pool") > 0, F.concat(F.lit("an empty pool: "), "id")).isNull()
    return rows.withColumn("_ok", filled).filter("_ok").drop("_ok").withColumns(
        {"parent": clean_title(F.get("parent_pool", F.lit(0))["text"]), "parent_source": F.lit("shared_parent_pool_greedy"), "seed_parent_used": F.lit(False)}
    )
