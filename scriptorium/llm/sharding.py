"""Shards of near equal bytes for indivisible groups, by Karmarkar-Karp differencing.

Equal texts are one group, which no shard boundary may cut. A partial partition
is a row of sums, one for each shard; at first every group is one, with its
bytes in one place and nothing in the others. The two partial partitions of
largest spread (largest sum less smallest) are combined again and again, the
largest sums of one onto the smallest of the other, until one is left.

One such heap cannot hold the groups of a large corpus, so it works in rounds
of distributed blocks. A round orders blocks of ``BLOCK`` items by size, leaves
every ``SPARE``-th as it is, and differences the others into ``BUNDLES``
bundles, each an item of the next round; a giant group ends in a bundle of its
own. Rounds end when at most ``FINAL`` items are left, bundles of all scales
and single groups to fill the gaps, and these are differenced into the shards
on the driver. A round divides the items by about twelve.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, exchange_parts, materialize, ship_package, text_or_empty

SHARDS = 16
#: Items of a block, bundles made of it, and how many items come to each that stays as it is.
BLOCK, BUNDLES, SPARE = 4096, 64, 16
#: Most items that are differenced on the driver.
FINAL = 1 << 14
#: Items of a task, where there are more than the session's number of partitions takes.
TASK = 1 << 21
#: Groups with at least this share of all rows, at most so many, meet their rows by a broadcast.
HOT = 10_000


def difference(sizes: list[int], ways: int) -> np.ndarray:
    """The place (0 to ways - 1) of each item: Karmarkar-Karp differencing, ties by order of creation.

    Sums are kept in falling order and less their smallest, which differencing
    never looks at; where each place of the parts has gone is noted, and walked
    back from the last partition to the items.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    heap = [(-int(size), k) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}

    def sums_of(k: int) -> np.ndarray:
        if k < n:
            out = np.zeros(ways, dtype=np.int64)
            out[0] = sizes[k]
            return out
        return sums.pop(k)

    parts: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = sums_of(a) + sums_of(b)[::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order] - joined[order[-1]]
        k = n + len(parts)
        parts.append((a, b, order.astype(np.int32)))
        sums[k] = joined
        heapq.heappush(heap, (-int(joined[0]), k))
    places: dict[int, np.ndarray] = {heap[0][1]: np.arange(ways)}
    out = np.zeros(n, dtype=np.int64)
    for k in range(n + len(parts) - 1, n - 1, -1):
        a, b, order = parts[k - n]
        own = np.empty(ways, dtype=np.int64)
        own[order] = places.pop(k)
        for part, at in ((a, own), (b, own[::-1])):
            if part < n:
                out[part] = at[0]
            else:
                places[part] = at
    if n == 1:
        out[0] = 0
    return out


def bundle_items(items: DataFrame, level: int, tasks: int) -> DataFrame:
    """One round over ``items(item binary, size long)``: each with the item ``above`` of the next round that it is part of.

    A task sorts its items, so that a repeated attempt makes the same bundles,
    and holds one block at a time.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        names: list[bytes] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal block
            order = np.argsort(-np.array(sizes), kind="stable")
            rest = np.delete(order, np.arange(SPARE - 1, len(order), SPARE))
            above: list[bytes] = list(names)
            ways = max(1, min(BUNDLES, len(rest) // SPARE))  # a block that is not full makes fewer
            places = difference([sizes[k] for k in rest], ways)
            for k, place in zip(rest.tolist(), places.tolist(), strict=True):
                above[k] = b"%d.%d.%d.%d" % (level, part, block, place)
            block += 1
            arrays = [pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(above, pa.binary())]
            names.clear()
            sizes.clear()
            return pa.RecordBatch.from_arrays(arrays, ["item", "size", "above"])

        for batch in batches:
            for item, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(item)
                sizes.append(size)
                if len(names) == BLOCK:
                    yield flush()
        if names:
            yield flush()

    return items.repartition(tasks, "item").sortWithinPartitions("item").mapInArrow(bundle, "item binary, size long, above binary")


def place_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``item, shard`` of ``groups(item binary, size long, ...)``, whose items are distinct."""
    spark = groups.sparkSession
    levels: list[DataFrame] = []
    items = groups.select("item", "size")
    while (n := items.count()) > FINAL:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = min(n // BLOCK, max(least, n // TASK))  # full blocks, and no more items in a task than it can sort
        made = materialize(bundle_items(items, len(levels), tasks), "bundles")
        levels.append(made)
        items = made.groupBy(F.col("above").alias("item")).agg(F.sum("size").alias("size"))
    rest = sorted(((bytes(r["item"]), r["size"]) for r in items.collect()), key=lambda r: (-r[1], r[0]))  # FINAL at most
    places = difference([size for _, size in rest], shards)
    table = pa.table({"item": pa.array([k for k, _ in rest], pa.binary()), "shard": pa.array(places.astype(np.int32))})
    placed = spark.createDataFrame(table)
    for made in reversed(levels):
        above = placed.select(F.col("item").alias("above"), "shard")
        placed = made.join(above, "above").select("item", "shard")
    return placed


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", group: Column | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs``: shards of near equal bytes.

    A row's size is its text's UTF-8 bytes and one more. Rows of one ``group``
    (a binary or text column; equal texts by default, null as empty) share a
    shard, however many they are: a group larger than an even share fills a
    shard of its own. Slots count each shard's rows from 0 without gaps. Null
    and repeated ids are kept, repeated rows are one group of as many rows, a
    long text is a large item, an empty table gives an empty result; columns
    other than key and text are not read unless ``group`` does.
    """
    ship_package(docs.sparkSession)
    rows = materialize(_rows(docs, key, group).drop("text"), "rows")
    numbered = materialize(number_in_shards(place_rows(rows, shards)), "numbered")
    discard(rows)
    counts = numbered.groupBy("_part", "shard").agg(F.count("*").alias("n"))  # a row for each task and shard
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    slot = (F.col("_place") + F.col("_start")).alias("slot")
    return numbered.join(starts, ["_part", "shard"]).select("doc_id", "size", "text_crc32", "shard", slot)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", group: Column | None = None) -> None:
    """Write ``doc_id, size, text_crc32, text`` as a Parquet table with a folder ``shard=k`` for each shard.

    A shard is several files where it is large: tasks write ranges of shard, id
    and checksum. Rows are treated as shard_documents() treats them.
    """
    ship_package(docs.sparkSession)
    placed = place_rows(_rows(docs, key, group), shards)
    ranges = exchange_parts(docs)
    order = ("shard", "doc_id", "text_crc32")
    placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("shard").parquet(path)


def _rows(docs: DataFrame, key: str, group: Column | None) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        text.alias("text"),
        F.unhex(F.sha2(text if group is None else F.coalesce(group.cast("string"), F.lit("")), 256)).alias("item"),
    )


def place_rows(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows(item, size, ...)`` with the ``shard`` of their group in place of ``item``.

    Rows of groups with a share of over 1 / HOT find it in a table of fewer than
    HOT rows; the others, none of them frequent, by an exchange in which the
    rows already placed have keys of their own.
    """
    groups = materialize(rows.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    placed = materialize(place_groups(groups, shards), "placed")
    total = groups.agg(F.sum("n")).first()[0] or 0
    frequent = groups.filter(F.col("n") * HOT > total).join(placed, "item").select("item", F.col("shard").alias("_hot"))
    marked = rows.join(F.broadcast(frequent), "item", "left")
    apart = F.concat(F.lit(b"#"), F.hex(F.monotonically_increasing_id()).cast("binary"))
    marked = marked.withColumn("item", F.when(F.col("_hot").isNull(), F.col("item")).otherwise(apart))
    found = marked.join(placed, "item", "left").withColumn("shard", F.coalesce("_hot", "shard"))
    return found.drop("item", "_hot")


def number_in_shards(rows: DataFrame) -> DataFrame:
    """Add the number ``_part`` of a row's task and its place ``_place`` among the task's rows of its shard."""
    names = rows.columns
    at = names.index("shard")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            shards = batch.column(at).to_numpy(zero_copy_only=False)
            places = np.empty(len(shards), dtype=np.int64)
            for shard in np.unique(shards).tolist():
                own = np.flatnonzero(shards == shard)
                places[own] = seen.get(shard, 0) + np.arange(len(own))
                seen[shard] = seen.get(shard, 0) + len(own)
            parts = pa.array(np.full(len(shards), part, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(places)], [*names, "_part", "_place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(number, f"{fields}, _part int, _place long")

