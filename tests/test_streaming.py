from pyspark.sql import functions as F

from scriptorium.streaming.incremental import process_arrivals


def test_only_new_or_failed_jobs_run(spark, tmp_path):
    source, results, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(name, ids):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(f'{{"id":"{i}"}}\n' for i in ids))
        work = lambda jobs: jobs.select("id", (F.col("id") != "bad").alias("valid"))
        process_arrivals(spark, source, "id string", results, checkpoint, work).awaitTermination()
        return sorted((r["batch"], r["id"], r["valid"]) for r in spark.read.parquet(results).collect())

    assert arrive("a.jsonl", ["1", "bad", "1"]) == [(0, "1", True), (0, "bad", False)]
    assert arrive("b.jsonl", ["1", "2", "bad"]) == [(0, "1", True), (0, "bad", False), (1, "2", True), (1, "bad", False)]
