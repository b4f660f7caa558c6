"""Reading and normalising stage files: JSON lines, wrapped JSON payloads, question/answer files, per-user files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import MISSING_ABSTRACTS, strip_instruction

ITEM = "struct<id:string,title:string,abstract:string>"
QUESTIONS = "id string, input string, profile array<" + ITEM + ">"
TARGET_KEYS = ("output", "target", "answer", "title", "gold")
OUTPUTS = "id string, " + ", ".join(f"{k} string" for k in TARGET_KEYS)
USERS = "user_id string, profile array<" + ITEM + ">, query array<struct<id:string,input:string,gold:string,output:string>>"
WRAPPERS = ("data", "outputs", "questions", "golds")
PARTITIONS = ("base", "reserve", "anchor", "test")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line, blank lines skipped; a malformed line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_payload(spark: SparkSession, path: str, row: str, limit: int | None = None) -> DataFrame:
    """Rows of a whole-file JSON array, or of the array under one of the known wrapper keys; ``limit`` stops early."""
    inner = f"array<{T.StructType.fromDDL(row).simpleString()}>"
    wrapped = ", ".join(f"{k} {inner}" for k in WRAPPERS)
    names = T.StructType.fromDDL(row).names
    both = spark.read.schema(f"{wrapped}, {row}").option("multiLine", True).json(path)
    one = F.array(F.struct(*(F.col(n) for n in names)))
    rows = both.select(F.explode(F.coalesce(*(F.col(k) for k in WRAPPERS), one)).alias("r")).select("r.*")
    return rows if limit is None else rows.limit(limit)


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with more than blanks."""
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).agg(F.count("*").alias("lines"))


def target_of() -> Column:
    """The first of the target keys that has a value."""
    return F.coalesce(*(F.col(k) for k in TARGET_KEYS))


def require(condition: Column, message: str) -> Column:
    """Null where the condition holds; else the query fails with the message."""
    return F.assert_true(condition, message)


def clean_profile(profile: Column, drop_missing_abstracts: bool) -> Column:
    """Items with a title and, if asked, a real abstract; a missing id becomes the item's index."""
    numbered = F.transform(
        profile,
        # names given as values: aliases inside a lambda can be trimmed away
        lambda x, i: F.named_struct(
            F.lit("id"), F.coalesce(x["id"], i.cast("string")), F.lit("title"), F.trim(x["title"]), F.lit("abstract"), F.coalesce(x["abstract"], F.lit(""))
        ),
    )
    return F.filter(
        numbered,
        lambda x: (F.length(F.coalesce(x["title"], F.lit(""))) > 0)
        & (F.lit(not drop_missing_abstracts) | ~F.lower(F.trim(x["abstract"])).isin(*MISSING_ABSTRACTS)),
    )


def normalize_questions(questions: DataFrame, outputs: DataFrame, split: str) -> DataFrame:
    """Questions with their targets; one without a target, or with an empty input, fails the query."""
    answers = outputs.select("id", F.trim(target_of()).alias("target"))
    joined = questions.join(answers, "id", "left")
    text = strip_instruction("input")
    ok = F.col("target").isNotNull() & (F.length(text) > 0)
    checked = joined.filter(require(ok, "a question has no target or no input").isNull())
    return checked.select(
        "id", F.col("input").alias("query"), text.alias("source_text"), "target", clean_profile(F.col("profile"), False).alias("profile"), F.lit(split).alias("split")
    )


def flatten_users(users: DataFrame, split: str, partition: str, drop_missing_abstracts: bool = True) -> DataFrame:
    """One row per query of every user with the user's cleaned profile; repeated users or queries fail the query."""
    if partition not in PARTITIONS:
        raise ValueError(f"partition must be one of {', '.join(PARTITIONS)}")
    counted = users.withColumn("_n", F.count("*").over(W.partitionBy("user_id")))
    rows = counted.filter(require(F.col("_n") == 1, "a user is repeated").isNull()).select(
        "user_id", "profile", clean_profile(F.col("profile"), drop_missing_abstracts).alias("kept"), F.explode("query").alias("q")
    )
    sample = F.concat_ws(":", "user_id", "q.id")
    out = rows.select(
        sample.alias("id"),
        "user_id",
        F.col("q.input").alias("query"),
        strip_instruction("q.input").alias("source_text"),
        F.trim(F.coalesce("q.gold", "q.output")).alias("target"),
        F.col("kept").alias("profile"),
        F.lit(split).alias("split"),
        F.lit(partition).alias("source_partition"),
        (F.size("profile") - F.size("kept")).alias("filtered_profile_records"),
    )
    counted = out.withColumn("_n", F.count("*").over(W.partitionBy("id")))
    return counted.filter(require(F.col("_n") == 1, "a query is repeated").isNull()).drop("_n")


def shard(rows: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows start to end - 1 in the order of a unique column: two bounded sorts, no global numbering."""
    return rows.orderBy(order).offset(start).limit(max(0, end - start))


def hydrate(slim: DataFrame, full: DataFrame) -> DataFrame:
    """Rows without a source text get it from the retrieve stage by id; one that is not there fails the query."""
    filled = slim.join(full.select("id", F.col("source_text").alias("_full")), "id", "left").withColumn(
        "source_text", F.coalesce("source_text", "_full")
    )
    return filled.filter(require(F.col("source_text").isNotNull(), "a row has no source text").isNull()).drop("_full")


def merge_shards(shards: list[DataFrame], expected: int, width: int = 5) -> DataFrame:
    """Union of shards, in id order; wrong counts, repeated ids and pools of another width fail the query."""
    out = shards[0]
    for part in shards[1:]:
        out = out.unionByName(part)
    check = out.agg(F.count("*").alias("n"), F.countDistinct("id").alias("k")).select(
        require((F.col("n") == expected) & (F.col("k") == expected), "the shards do not have the expected ids").isNull().alias("ok")
    )
    wide = out.filter(require(F.size("parent_pool") == width, "a pool has another width").isNull())
    return wide.join(F.broadcast(check), F.col("ok")).drop("ok").orderBy("id")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines under Spark's commit protocol: readers never see half a file set."""
    rows.write.mode("overwrite").json(path)


def write_dataset(rows: DataFrame, path: str) -> DataFrame:
    """Examples by split, and a manifest of counts; a split without rows fails before anything is written."""
    manifest = rows.groupBy("split").agg(F.count("*").alias("examples"), F.countDistinct("id").alias("ids"))
    present = {r["split"] for r in manifest.select("split").collect()}  # two splits
    if not {"train", "validation"} <= present:
        raise ValueError("a split has no examples")
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/examples")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest
