import json
import os
import signal
import subprocess
import sys
import time
from pathlib import Path

import pytest

from scriptorium.sources import manifests as M

ROOT = Path(__file__).resolve().parents[1]


def pool(spark, names):
    return spark.createDataFrame([(n, [{"text": f'Title: "{n} first"'}, {"text": "second"}]) for n in names], "id string, parent_pool array<struct<text:string>>")


def test_versions_and_gates(spark, tmp_path):
    path = f"{tmp_path}/pool"
    with pytest.raises(M.GateError, match="nothing"):
        M.read_published(spark, path)
    assert M.read_keyed(spark, path, "id", "id string, n int").collect() == []
    first = M.publish(pool(spark, "ab"), path, {"history_used": True})
    assert first["version"] == 0 and first["rows"] == 2
    second = M.publish(pool(spark, "cba").repartition(3), path, {"seed_parent_used": False})
    assert second["version"] == 1 and M.digest(pool(spark, "abc")) == {k: second[k] for k in ("rows", "hashes")}
    got = M.shared_parents(spark, path).orderBy("id").collect()
    assert [(r["id"], r["parent"], r["seed_parent_used"]) for r in got] == [(n, f"{n} first", False) for n in "abc"]
    assert M.read_published(spark, path, require={"seed_parent_used": False}, verify=True).count() == 3
    with pytest.raises(M.GateError, match="history_used is None"):
        M.read_published(spark, path, require={"history_used": True})
    for facts in ({"seed_parent_used": True}, {"history_used": False}):
        M.publish(pool(spark, "a"), path, facts)
        with pytest.raises(M.GateError, match="is refused"):
            M.shared_parents(spark, path)
    M.publish(spark.createDataFrame([("a", [])], "id string, parent_pool array<struct<text:string>>"), path)
    with pytest.raises(Exception, match="an empty pool"):
        M.shared_parents(spark, path).collect()


def test_tables_that_do_not_match_their_manifest(spark, tmp_path):
    path = f"{tmp_path}/t"
    M.publish(spark.range(10), path)
    assert M.read_keyed(spark, path, "id", "id long").count() == 10
    spark.range(3).write.mode("append").parquet(f"{path}/v0/data")
    assert M.read_published(spark, path).count() == 13
    with pytest.raises(M.GateError, match="rows are not"):
        M.read_published(spark, path, verify=True)
    manifest = tmp_path / "t/v0" / M.MANIFEST
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark.sparkContext._jsc.hadoopConfiguration()).delete(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(manifest)), False
    )
    with pytest.raises(M.GateError, match="nothing"):
        M.read_published(spark, path)


WRITER = """
import sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from scriptorium.sources import manifests
manifests.digest = lambda rows: (open({flag!r}, "w").close(), time.sleep(600))
manifests.publish(spark.range(99), {path!r}, {{"seed_parent_used": True}})
"""


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path):
    path, flag = f"{tmp_path}/t", tmp_path / "written"
    M.publish(spark.range(10), path)
    child = subprocess.Popen(
        [sys.executable, "-c", WRITER.format(root=str(ROOT), path=path, flag=str(flag))], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True
    )
    for _ in range(600):
        if flag.exists() or child.poll() is not None:
            break
        time.sleep(0.2)
    os.killpg(child.pid, signal.SIGKILL)  # the writer's own process group: its data is there, its manifest is not
    child.wait()
    assert flag.exists() and any(n.startswith("_staging") for n in os.listdir(path))
    assert M.read_published(spark, path, verify=True).count() == 10
    assert M.publish(spark.range(4), path)["version"] == 1 and M.read_published(spark, path).count() == 4
    assert json.loads((tmp_path / "t/v1" / M.MANIFEST).read_text())["rows"] == 4
