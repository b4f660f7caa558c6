"""Files that are one JSON array of objects, read in splits, and their first rows read from a prefix.

An array need not have a row on each line, so a split cannot know by itself
whether it starts within a string or how deep in objects. Each split therefore
first tells, for either case, how its quotes and brackets come out; from these a
few numbers each split's true start follows, and a second pass cuts the
elements. Fragments end with a closing brace, which is where Spark's text reader
splits, so it does the reading, and any store that it can read will do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.sources.readers import TARGET_KEYS, WRAPPERS
from scriptorium.sources.tables import materialize, ship_package

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.DOTALL)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*?"', re.DOTALL)
_BETWEEN = re.compile(r"[\s,]*")
#: Bytes that a prefix grows by; splits whose states go to every task, beyond which the text moves to them.
BLOCK, MOST_SPLITS = 1 << 16, 1_000_000


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragments of the text up to each closing brace, in order within the split that they are part of."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def turns(fragment: str, within: bool) -> tuple[bool, int]:
    """Whether a fragment that starts ``within`` a string ends in one, and by how much the depth of brackets has changed."""
    at = 0
    if within:
        end = _STRING_END.match(fragment)
        if not end:
            return True, 0
        at = end.end()
    depth = 0
    for token in _TOKEN.finditer(fragment, at):
        c = token.group()
        if c == '"':  # opened and not closed
            return True, depth
        depth += (c in "{[") - (c in "}]")
    return False, depth


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """(file, start) and the rest of the columns of each run of fragments of one split within a batch."""
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rest = [batch.column(k).to_pylist() for k in range(2, batch.num_columns)]
        begin = 0
        for k in range(1, len(files) + 1):
            if k == len(files) or (files[k], starts[k]) != (files[begin], starts[begin]):
                yield (files[begin], starts[begin]), [c[begin:k] for c in rest]
                begin = k


def split_states(fragments: DataFrame) -> DataFrame:
    """file, start, within, depth: the state that each split starts in. A row for each split of the input."""
    names = ["file", "start", "odd0", "depth0", "odd1", "depth1"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for key, (values,) in _by_split(batches):
            state = found.setdefault(key, [False, 0, True, 0])
            for value in values:
                for at in (0, 2):
                    state[at], change = turns(value + "}", state[at])
                    state[at + 1] += change
        rows = [(*key, *s) for key, s in found.items()]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    splits = fragments.mapInArrow(count, "file string, start long, odd0 boolean, depth0 long, odd1 boolean, depth1 long")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A split either ends alike whatever it starts in, or turns the state or leaves it as it is; so the state after a split
    # is the parity of the marks from the last one of the first kind on.
    fixed = splits.withColumn("_run", F.sum((F.col("odd0") == F.col("odd1")).cast("int")).over(order))
    marks = Window.partitionBy("file", "_run").orderBy("start")
    after = fixed.withColumn("_after", F.sum(F.col("odd0").cast("int")).over(marks) % 2 == 1)
    known = after.withColumn("within", F.coalesce(F.lag("_after").over(order), F.lit(False)))
    known = known.withColumn("change", F.when(F.col("within"), F.col("depth1")).otherwise(F.col("depth0")))
    whole = Window.partitionBy("file")
    # the brace added to a file's last fragment is one too many where the array ends as it should
    closed = F.assert_true(F.sum("change").over(whole) == -1, F.concat(F.lit("the array does not end: "), "file")).isNull()
    depth = F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth")
    return known.select("file", "start", "within", depth, closed.alias("closed")).filter("closed").drop("closed")


class _Cutter:
    """Elements of an array out of fragments that follow one another: ``out`` has (kind, text) of what has ended so far.

    A kind is whole, or tail: the end of an element that began before the first
    fragment. What is open after the last fragment is in ``held``.
    """

    def __init__(self, within: bool, depth: int):
        self.within, self.depth = within, depth
        self.held: list[str] = []
        self.tail = depth > 1  # an element is open whose beginning is elsewhere
        self.out: list[tuple[str, str]] = []

    def feed(self, fragment: str) -> None:
        at = begin = since = 0  # since: from where on the fragment is between elements
        if self.within:
            end = _STRING_END.match(fragment)
            at = end.end() if end else len(fragment)
            self.within = end is None
        for token in _TOKEN.finditer(fragment, at):
            c = token.group()
            if c == '"':
                self.within = True
                break
            if c in ("{", "["):
                self.depth += 1
                if self.depth == 1:
                    since = token.end()
                elif self.depth == 2:
                    self.between(fragment[since : token.start()] + c * (c == "["))
                    begin = token.start()
            elif c in ("}", "]"):
                self.depth -= 1
                if self.depth == 1:
                    self.held.append(fragment[begin : token.end()])
                    self.out.append(("tail" if self.tail else "whole", "".join(self.held)))
                    self.held, self.tail, since = [], False, token.end()
                elif self.depth == 0:
                    self.between(fragment[since : token.start()])
        if self.depth > 1:
            self.held.append(fragment[begin:])
        elif self.depth == 1:
            self.between(fragment[since:])

    def between(self, text: str) -> None:
        if not _BETWEEN.fullmatch(text):
            raise ValueError(f"an element of the array is no object: {text.strip()[:40]}")


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """file, start, place, element (its JSON) of every object of the arrays in the files of ``path``.

    ``start`` and ``place`` order a file's elements. An element may span any
    number of splits. Elements that are no objects fail the query; an empty
    array gives no rows.
    """
    ship_package(spark)
    fragments = _fragments(spark, path)
    states = materialize(split_states(fragments), "splits")
    names = ["file", "start", "place", "kind", "element"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutters: dict[tuple, list] = {}

        def rows(key: tuple, found: list[tuple[str, str]], place: int) -> pa.RecordBatch:
            n = len(found)
            arrays = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(range(place, place + n), pa.int64())]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], names)

        for key, (values, withins, depths) in _by_split(batches):
            entry = cutters.setdefault(key, [_Cutter(withins[0], depths[0]), 0])
            for value in values:
                entry[0].feed(value + "}")
            found, entry[0].out = entry[0].out, []
            yield rows(key, found, entry[1])
            entry[1] += len(found)
        for key, (cutter, place) in cutters.items():
            if cutter.held:
                yield rows(key, [("middle" if cutter.tail else "head", "".join(cutter.held))], place)

    if states.count() <= MOST_SPLITS:
        stated = fragments.join(F.broadcast(states), ["file", "start"])  # keeps the order of fragments
    else:
        numbered = fragments.withColumn("_n", F.monotonically_increasing_id()).join(states, ["file", "start"])
        stated = numbered.repartition("file", "start").sortWithinPartitions("file", "start", "_n")
    parts = materialize(stated.select("file", "start", "value", "within", "depth").mapInArrow(cut, "file string, start long, place long, kind string, element string"), "elements")
    whole = parts.filter("kind = 'whole'").drop("kind")
    # the rest are at most two rows of each split; those of one element follow its head
    rest = parts.filter("kind <> 'whole'")
    order = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.withColumn("_of", F.sum((F.col("kind") == "head").cast("int")).over(order))
    pieces = rest.groupBy("file", "_of").agg(F.sort_array(F.collect_list(F.struct("start", "place", "element"))).alias("p"), F.max((F.col("kind") == "tail").cast("int")).alias("ended"))
    ended = F.assert_true(F.col("ended") == 1, F.concat(F.lit("the array ends within an element: "), "file")).isNull()
    joined = F.array_join(F.transform("p", lambda x: x["element"]), "")
    spanning = pieces.filter(ended).select("file", F.get("p", F.lit(0))["start"].alias("start"), F.get("p", F.lit(0))["place"].alias("place"), joined.alias("element"))
    return whole.unionByName(spanning)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of ``schema`` with their file, start and place; an element that does not fit it fails the query."""
    rows = array_elements(spark, path)
    parsed = rows.withColumn("_r", F.from_json("element", schema, {"mode": "FAILFAST"}))
    return parsed.select("file", "start", "place", "_r.*")


class _Prefix:
    """Text of a file as far as it was needed."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        folder = self.jvm.org.apache.hadoop.fs.Path(path)
        self.stream = folder.getFileSystem(spark._jsc.hadoopConfiguration()).open(folder)
        self.raw, self.text, self.bytes_read, self.ended = b"", "", 0, False

    def more(self) -> bool:
        part = bytes(self.stream.readNBytes(BLOCK))
        self.bytes_read += len(part)
        self.ended = not part
        self.raw += part
        whole = self.raw.decode("utf-8", "ignore") if not self.ended else self.raw.decode("utf-8")
        self.text += whole
        self.raw = self.raw[len(whole.encode()) :]
        return not self.ended

    def close(self) -> None:
        self.stream.close()


def first_elements(spark: SparkSession, path: str, limit: int, label: str = "data") -> tuple[list[dict], int]:
    """The first ``limit`` objects of an array, bare or under ``label`` or a known key of an object, and the bytes read.

    For pilots of a few rows: the driver reads blocks from the start of the file
    until it has them. An element that cannot be read, or is no object, is an
    error with its row and line.
    """
    prefix = _Prefix(spark, path)
    decoder = json.JSONDecoder()
    out: list[dict] = []
    try:
        at = _array_start(prefix, (label, *WRAPPERS))
        while len(out) < limit:
            at = _skip(prefix, at, ",")
            if prefix.text[at : at + 1] == "]":
                break
            while True:
                try:
                    value, end = decoder.raw_decode(prefix.text, at)
                    if end < len(prefix.text) or isinstance(value, dict):
                        break
                    raise ValueError("cut off")
                except ValueError as error:
                    if not prefix.more():
                        line = prefix.text.count("\n", 0, at) + 1
                        raise ValueError(f"row {len(out)} at line {line} of {path} cannot be read: {error}") from error
            if not isinstance(value, dict):
                raise ValueError(f"row {len(out)} at line {prefix.text.count(chr(10), 0, at) + 1} of {path} must be an object")
            out.append(value)
            at = end
    finally:
        prefix.close()
    return out, prefix.bytes_read


def _skip(prefix: _Prefix, at: int, also: str = "") -> int:
    while True:
        while at < len(prefix.text) and (prefix.text[at].isspace() or prefix.text[at] in also):
            at += 1
        if at < len(prefix.text) or not prefix.more():
            return at


def _array_start(prefix: _Prefix, keys: tuple[str, ...]) -> int:
    """The place after the opening bracket of the array of rows."""
    at = _skip(prefix, 0, "\ufeff")
    first = prefix.text[at : at + 1]
    if first == "[":
        return at + 1
    decoder = json.JSONDecoder()
    at += 1
    while first == "{":
        at = _skip(prefix, at, ",")
        if prefix.text[at : at + 1] in ("}", ""):
            break
        key, at = _decoded(prefix, decoder, at)
        at = _skip(prefix, _skip(prefix, at), ":")
        if key in keys and prefix.text[at : at + 1] == "[":
            return at + 1
        _, at = _decoded(prefix, decoder, at)
    raise ValueError("the file has no list of rows")


def _decoded(prefix: _Prefix, decoder: json.JSONDecoder, at: int) -> tuple:
    while True:
        try:
            value, end = decoder.raw_decode(prefix.text, at)
            if end < len(prefix.text):
                return value, end
        except ValueError:
            if prefix.ended:
                raise
        if not prefix.more() and prefix.ended:
            return decoder.raw_decode(prefix.text, at)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line (from 1), text of the lines of a JSON-lines file that do not fit ``schema``; blank lines fit.

    Lines are numbered by split: how many a split has is a row for each.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), "value"
    )
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = splits.select("file", "start", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bad = lines.filter(F.length(F.trim("value")) > 0).withColumn("_r", parsed).filter("_r._bad IS NOT NULL")
    return bad.join(numbered, ["file", "start"]).select("file", (F.col("before") + F.col("n") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def present_target(element: Column) -> Column:
    """The value of the first of the target keys that an object has, as text: of a list its first entry, None where it is null."""
    keys = F.json_object_keys(element)
    out = F.lit(None).cast("string")
    for key in reversed(TARGET_KEYS):
        value = F.get_json_object(element, f"$.{key}")
        of_list = F.get_json_object(element, f"$.{key}[0]")
        shown = F.when(F.startswith(F.ltrim(value), F.lit("[")) & of_list.isNotNull(), of_list).otherwise(F.coalesce(value, F.lit("None")))
        out = F.when(F.array_contains(keys, key), shown).otherwise(out)
    return out


def write_arrays(rows: DataFrame, path: str) -> None:
    """Every task's rows as a file with one JSON array, an element on a line."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([(before if k == 0 else ",") + v for k, v in enumerate(values)], pa.string())], ["value"])
            before = "," if values else before
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"], pa.string())], ["value"])

    packed = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    packed.mapInArrow(lines, "value string").write.mode("overwrite").text(path)
