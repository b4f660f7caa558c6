import json

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import connectors as C
from scriptorium.sources import readers as R

ITEMS = [{"id": None, "title": " T ", "abstract": "a"}, {"id": "x", "title": "", "abstract": "b"}, {"id": "y", "title": "U", "abstract": "No abstract available."}]


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_json_lines_skip_blanks_and_fail_on_rubbish(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", '{"id":"1"}\n\n{"id":"2"}\n')
    assert R.read_jsonl(spark, good, "id string").filter("id is not null").count() == 2
    assert R.count_lines(spark, good).first()["lines"] == 2
    with pytest.raises(Exception):
        R.read_jsonl(spark, write(tmp_path / "b.jsonl", "{bad"), "id string").collect()


@pytest.mark.parametrize("payload", [[{"id": "1"}, {"id": "2"}], {"golds": [{"id": "1"}, {"id": "2"}]}, {"data": [{"id": "1"}, {"id": "2"}]}])
def test_wrapped_payloads(spark, tmp_path, payload):
    rows = R.read_payload(spark, write(tmp_path / "p.json", payload), "id string")
    assert [r["id"] for r in rows.orderBy("id").collect()] == ["1", "2"]
    assert R.read_payload(spark, str(tmp_path / "p.json"), "id string", 1).count() == 1


def test_questions_meet_their_targets(spark):
    text = "Generate a title for the following abstract of a paper: deep things "
    questions = spark.createDataFrame([("1", text, ITEMS)], R.QUESTIONS)
    outputs = spark.createDataFrame([("1", None, " gold ", None, None, None)], R.OUTPUTS)
    row = R.normalize_questions(questions, outputs, "train").first()
    assert (row["source_text"], row["target"], row["split"]) == ("deep things", "gold", "train")
    assert [(i["id"], i["title"]) for i in row["profile"]] == [("0", "T"), ("y", "U")]
    with pytest.raises(Exception, match="no target"):
        R.normalize_questions(questions, outputs.limit(0), "train").collect()


def test_users_flatten_and_repeats_fail(spark):
    users = spark.createDataFrame([("u", ITEMS, [{"id": "q", "input": "text", "gold": None, "output": "o"}])], R.USERS)
    row = R.flatten_users(users, "test", "base").first()
    assert (row["id"], row["target"], row["filtered_profile_records"]) == ("u:q", "o", 2)
    with pytest.raises(Exception, match="repeated"):
        R.flatten_users(users.union(users), "test", "base").collect()
    with pytest.raises(ValueError):
        R.flatten_users(users, "test", "elsewhere")


def test_shards_and_hydration(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"), F.array_repeat(F.lit("t"), 5).alias("parent_pool"))
    assert [r["id"] for r in R.shard(rows, "id", 3, 6).collect()] == ["3", "4", "5"]
    assert R.merge_shards([rows.filter("id < '5'"), rows.filter("id >= '5'")], 10).count() == 10
    with pytest.raises(Exception, match="expected ids"):
        R.merge_shards([rows, rows], 10).collect()
    slim = spark.createDataFrame([("1", None), ("2", "own")], "id string, source_text string")
    full = spark.createDataFrame([("1", "found")], "id string, source_text string")
    assert {tuple(r) for r in R.hydrate(slim, full).collect()} == {("1", "found"), ("2", "own")}
    with pytest.raises(Exception, match="no source text"):
        R.hydrate(slim, full.limit(0)).collect()


def test_dataset_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", "train"), ("2", "validation")], "id string, split string")
    assert R.write_dataset(rows, str(tmp_path / "d")).count() == 2
    assert spark.read.parquet(str(tmp_path / "d/examples")).count() == 2
    with pytest.raises(ValueError):
        R.write_dataset(rows.limit(0), str(tmp_path / "e"))


def test_cached_answers_are_not_asked_again(spark):
    requests = spark.createDataFrame([("1", "t", "some prompt"), ("2", "t", "some prompt"), ("3", "t", "other")], "id string, task string, prompt string")
    first = C.answer(requests)
    keys = {r["id"]: r["key"] for r in first.collect()}
    assert keys["1"] == keys["2"] != keys["3"]
    cache = first.filter("id = '3'").select("key", F.lit("old").alias("response"))
    got = {r["id"]: r["response"] for r in C.answer(requests, cache).collect()}
    assert got["3"] == "old" and json.loads(got["1"])["output"] == "Some Prompt"
    assert requests.select(C.render("Q: {a} {b}", a=F.col("prompt"), b=F.lit("!")).alias("x")).first()["x"] == "Q: some prompt !"


def test_resume_and_reuse(spark):
    jobs = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    done = spark.createDataFrame([("1", True), ("2", False), ("3", True)], "id string, valid boolean")
    assert {r["id"] for r in C.pending(jobs, done).collect()} == {"2"}
    assert {r["id"] for r in C.pending(jobs, done, jobs.filter("id = '3'")).collect()} == {"2", "3"}
    assert C.reuse(jobs.filter("id = '1'"), jobs).count() == 3
