"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct ``width``-word shingles as 64-bit hashes,
in one global order that puts rare tokens first; a compact count over all
documents finds the frequent ones and their classes. Of two sets of similarity
t or more, each cut to its first tokens, the prefixes share a token. If a rare
one is shared, the pair meets in the list of a single rare token. If none is,
prefixes are extended, and the index keys are combinations of two frequent
tokens that follow one another in the order: of the first 2 (1 - t) n + 2
frequent tokens two such neighbours are neighbours in the other set too (see
``chain_prefix``). A set with more than a share 1 - t of rare tokens needs no
combination at all. Every candidate is verified on whole sets.

Equal sets are one node. A short list gives its pairs. Of a long list every
member is first compared with the list's chief, its least node; the lists of
one chief form a bundle, in which members are then compared where they are
not yet joined. That happens in blocks of bounded size beside the whole sets,
and a block gives only the edges that join different components, fewer than it
has members: rows grow with a group, not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import discard, materialize, ship_package, tidy

#: A-Z lowered; bytes.split() then cuts at exactly space and \x09 to \x0d.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WIDTH, SHARE, BASE = 3, 90, 100
#: Tokens in more documents than this count as frequent. Where there are more than MAX_FREQUENT of them (at 5 bytes in
#: every worker), only those of the highest classes do: lists of single tokens are then longer, but nothing is lost.
FREQUENT, MAX_FREQUENT = 16, 1 << 24
#: Longs of a sketch: the parities of how many tokens of a set fall on each of its bits.
SKETCH = 16
FLUSH, SLICE, BROADCAST_IDS, SEEN = 1_000_000, 256, 2_000_000, 100_000
#: Members and tokens of a block of a bundle, and tokens compared at a time.
BLOCK, TOKENS, COLUMNS = 1024, 1 << 20, 2048
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_WORDS: dict[bytes, int] = {}


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence of fewer words is one; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    fresh = set(words).difference(_WORDS)
    if fresh:
        if len(_WORDS) > 100_000:
            _WORDS.clear()
            fresh = set(words)
        _WORDS.update(zip(fresh, map(xxhash.xxh3_64_intdigest, fresh), strict=True))
    codes = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    x = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        x = (x ^ codes[k : k + n]) * MIX[k % 3]
        x ^= x >> np.uint64(29)
    x = (x ^ (x >> np.uint64(30))) * MIX[3]
    x = (x ^ (x >> np.uint64(27))) * MIX[4]
    x ^= x >> np.uint64(31)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def forget_words() -> None:
    """At the end of a task: the words of the next one are hashed anew in no time."""
    _WORDS.clear()
    tidy()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few texts at a time: long ones must not pile up in a worker."""
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            yield batch.slice(begin, SLICE)


def pack_counts(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys, any of them repeated, as byte planes of the differences and counts of the distinct ones, compressed."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    distinct = keys[starts]
    steps = np.concatenate((np.diff(distinct, prepend=distinct[:1] * 0), np.diff(np.append(starts, len(keys))) - 1)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    steps, less = np.split(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), 2)
    return np.cumsum(steps, dtype=np.uint64), less.astype(np.int64) + 1


def describe(docs: DataFrame, bits: int) -> DataFrame:
    """For every row doc_id, n_shingles and the set's fingerprint; and for each range of hashes its tokens with their counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = ["doc_id", "n_shingles", "node", "range", "blob"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

        def flush() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            ranges = (tokens >> np.uint64(64 - bits)).astype(np.int64)
            keys = (tokens >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)
            there, first = np.unique(ranges, return_index=True)
            blobs = [pack_counts(part) for part in np.split(keys, first[1:])]
            none = [None] * len(there)
            columns = [none, none, none, there.tolist(), blobs]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        size = 0
        for batch in slices(batches):
            sizes, nodes = [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text)
                sizes.append(len(tokens))
                nodes.append(signed(xxhash.xxh3_64_intdigest(tokens.tobytes())) if len(tokens) else None)
                if len(tokens):
                    held.append(tokens)
                    size += len(tokens)
                if size >= FLUSH:
                    yield flush()
                    held.clear()
                    size = 0
            none = pa.nulls(batch.num_rows)
            columns = [batch.column(0), pa.array(sizes, kinds[1]), pa.array(nodes, kinds[2]), none.cast(kinds[3]), none.cast(kinds[4])]
            yield pa.RecordBatch.from_arrays(columns, names)
        if held:
            yield flush()
        held.clear()
        forget_words()

    return docs.mapInArrow(scan, "doc_id long, n_shingles long, node long, range int, blob binary")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def frequent_tokens(blobs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Leading 32 bits of frequent tokens, sorted, the class (log2 of the count) of each, and whether these are all.

    A token that shares these bits with a frequent one counts as frequent too, in every task alike.
    """

    def count(table: pa.Table) -> pa.Table:
        at = table.column("range")[0].as_py()
        # a token comes once from each flush of a task, however many documents hold it
        keys, counts = (np.concatenate(x) for x in zip(*map(unpack_counts, table.column("blob").to_pylist()), strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.add.reduceat(counts[order], starts)
        often = n > FREQUENT
        leading = (np.uint64(at) << np.uint64(32 - bits)) | (keys[starts[often]] >> np.uint64(bits))
        classes = np.floor(np.log2(n[often].astype(np.float64))).astype(np.int32)
        there = np.unique(classes)
        parts = [leading[classes == c].astype("<u4") for c in there]
        columns = [pa.array(there, pa.int32()), pa.array([len(x) for x in parts], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())]
        return pa.table(columns, ["class", "n", "tokens"])

    counted = materialize(blobs.groupBy("range").applyInArrow(count, "class int, n long, tokens binary"), "frequent")
    least, total = 64, 0
    for r in sorted(counted.groupBy("class").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["class"]):
        total += r["n"]
        if total > MAX_FREQUENT:
            break
        least = r["class"]
    found = counted.filter(F.col("class") >= least).select("class", "tokens").collect()
    discard(counted)
    tokens = np.concatenate([np.empty(0, "<u4"), *(np.frombuffer(r["tokens"], "<u4") for r in found)])
    classes = np.repeat([r["class"] for r in found], [len(r["tokens"]) // 4 for r in found]).astype(np.int8)
    order = np.lexsort((-classes, tokens))
    tokens, classes = tokens[order], classes[order]
    first = np.concatenate(([True], tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, dtype=bool)
    return tokens[first], classes[first], total <= MAX_FREQUENT


def alone(n: int) -> bool:
    """Whether a set of n tokens can only be similar to an equal one."""
    return (BASE - SHARE) * n < SHARE


def single_prefix(n: int) -> int:
    """How many first tokens of a set must hold one of every similar set."""
    return (BASE - SHARE) * n // BASE + 1


def chain_prefix(n: int, rare: int) -> int:
    """How many first frequent tokens must hold two that follow one another in a similar set too, if no rare token is shared.

    Let dx tokens of the set be missing in the other, the rare ones among them,
    and dy be missing here; (BASE - SHARE) n >= BASE dx + SHARE dy. A missing
    token breaks two neighbourhoods, one in between breaks one, so at most
    2 dx + dy of them are broken. 0 if no set can be similar.
    """
    room = (BASE - SHARE) * n - BASE * rare
    return 2 * room // BASE + 2 if room >= 0 else 0


def index_keys(tokens: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys of a sorted set with the class of each token (0: rare): first the single ones (even), whose number is told, then the combinations (odd)."""
    n = len(tokens)
    tokens = tokens[np.argsort(rank, kind="stable")]
    rare = int(np.count_nonzero(rank == 0))
    singles = tokens[: min(rare, single_prefix(n))] & ~np.uint64(1)
    chain = tokens[rare : rare + chain_prefix(n, rare)]
    if len(chain) < 2:
        return singles, len(singles)
    mixed = (chain[:-1] * MIX[0]) ^ (chain[1:] * MIX[1])
    mixed = (mixed ^ (mixed >> np.uint64(31))) * MIX[2]
    return np.concatenate((singles, mixed | np.uint64(1))), len(singles)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The set's parities as longs: bits that differ in two sketches are owed to as many tokens in one set only."""
    odd = np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def keyed_sets(docs: DataFrame, shared) -> DataFrame:
    """node, n, number of single keys, keys and sketch of every set that another may be similar to; equal sets of a task once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, classes = shared.value
        seen: set[int] = set()
        for batch in slices(batches):
            nodes, sizes, singles, found, sketches = [], [], [], [], []
            for text in batch.column(0).to_pylist():
                tokens = shingle_set(text)
                n = len(tokens)
                if alone(n):
                    continue
                node = signed(xxhash.xxh3_64_intdigest(tokens.tobytes()))
                if node in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                rank = np.zeros(n, dtype=np.int8)
                if len(hot):
                    keys = (tokens >> np.uint64(32)).astype(np.uint32)
                    at = np.searchsorted(hot, keys)
                    at[at == len(hot)] = 0
                    rank = np.where(hot[at] == keys, classes[at], 0)
                keys, single = index_keys(tokens, rank)
                nodes.append(node)
                sizes.append(n)
                singles.append(single)
                found.append(keys.view(np.int64))
                sketches.append(sketch(tokens))
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(singles, pa.int32())]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in (found, sketches)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "s", "keys", "sketch"])
        forget_words()

    return docs.select("text").mapInArrow(scan, "node long, n int, s int, keys array<long>, sketch array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, once: bool) -> DataFrame:
    """Whole sets of the wanted nodes, from the texts of their first documents; ``once`` tells that no id comes twice."""
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = wanted.select(F.col("rep").alias("_rep"), F.col("node").alias("_node"))
    joined = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_rep")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, sets = [], []
            for text, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = shingle_set(text)
                if len(tokens) and signed(xxhash.xxh3_64_intdigest(tokens.tobytes())) == node:
                    nodes.append(node)
                    sets.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "tokens"])
        forget_words()

    found = joined.select("text", "_node").mapInArrow(scan, "node long, tokens array<long>")
    return found if once else found.dropDuplicates(["node"])


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches let their sets be similar: whole sets travel for no others.

    Bits that differ are at most the tokens in one set only, so common tokens
    are at most half of what both sizes exceed them by. No similar pair goes.
    """
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("_m"), F.col("sketch").alias("_x"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("_n"), F.col("sketch").alias("_y"))
    differ = sum((F.bit_count(F.get("_x", F.lit(k)).bitwiseXOR(F.get("_y", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    both = F.col("_m") + F.col("_n")
    return (
        pairs.select("a", "b")
        .join(b, "b")
        .join(a, "a")
        .filter(BASE * F.least("_m", "_n") >= SHARE * F.greatest("_m", "_n"))
        .filter((BASE + SHARE) * (both - differ) >= 2 * SHARE * both)
        .select("a", "b")
    )


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    a = sets.select(F.col("node").alias("a"), F.col("tokens").alias("_x"))
    b = sets.select(F.col("node").alias("b"), F.col("tokens").alias("_y"))
    common = F.size(F.array_intersect("_x", "_y"))
    return (
        pairs.select("a", "b")
        .join(b, "b")
        .join(a, "a")
        .filter(BASE * F.least(F.size("_x"), F.size("_y")) >= SHARE * F.greatest(F.size("_x"), F.size("_y")))
        .filter(BASE * common >= SHARE * (F.size("_x") + F.size("_y") - common))
        .select("a", "b")
    )


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node of ``edges(a, b)``, by alternating large and small stars.

    A star's least neighbour is aggregated before the shuffle and joined back, so
    that the many edges of a star's centre need not meet in one task.
    """
    edges = materialize(edges.filter("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "down")
        small = down.join(down.groupBy("a").agg(F.min("b").alias("m")), "a")
        step = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        after = materialize(step.filter("a <> b").distinct(), "edges")
        new = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(edges)
        discard(down)
        edges = after
        if new == state:
            break
        state = new
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def pairs_of_short_lists(lists: DataFrame, counted: bool) -> DataFrame:
    """Pairs (a, b) from the lists of at most FREQUENT members (node, n, s) of a key.

    Of pairs that share only single keys those stay whose prefixes have enough
    in common; ``counted`` tells that every list of a rare token is short, so
    that shared ones are counted in full.
    """
    nodes = lists.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n", "s"))).alias("ms"))
    later = F.transform("ms", lambda x, i: F.transform(F.slice("ms", i + 2, F.size("ms")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = nodes.select("key", F.explode(F.flatten(later)).alias("p")).filter(
        BASE * F.least("p.a.n", "p.b.n") >= SHARE * F.greatest("p.a.n", "p.b.n")
    )
    odd = F.col("key").bitwiseAND(F.lit(1))
    found = pairs.groupBy("p").agg(F.sum(1 - odd).alias("shared"), F.max(odd).alias("mixed"))
    if counted:
        prefix = {x: F.floor((BASE - SHARE) * F.col(f"p.{x}.n") / BASE) + 1 for x in "ab"}
        often = F.least(*(prefix[x] - F.col(f"p.{x}.s") for x in "ab"))
        beyond = F.greatest(*(F.col(f"p.{x}.n") - prefix[x] for x in "ab"))
        total = F.col("p.a.n") + F.col("p.b.n")
        found = found.filter((F.col("mixed") == 1) | ((SHARE + BASE) * (F.col("shared") + often + beyond) >= SHARE * total))
    return found.select(F.col("p.a.node").alias("a"), F.col("p.b.node").alias("b"))


def spanning_edges(node: np.ndarray, root: np.ndarray, side: np.ndarray, n: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similar pairs of nodes, just enough to join the roots that similar nodes of sides 0 and 1 with sides 0 and 2 join.

    ``flat`` has the sets one after another, of sizes ``n``.
    """
    owner = np.repeat(np.arange(len(node)), n)
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(held > 1) - 1
    kept = held[column] > 1  # what one set alone holds is common to none
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    x, y = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    common = np.zeros((len(x), len(y)), dtype=np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (begin, begin + COLUMNS))
        dense = np.zeros((len(node), COLUMNS), dtype=np.float32)
        dense[owner[a:b], column[a:b] - begin] = 1
        common += dense[x] @ dense[y].T
    _, label = np.unique(root, return_inverse=True)
    similar = BASE * common >= SHARE * (n[x][:, None] + n[y][None, :] - common)
    i, j = np.nonzero(similar & (label[x][:, None] != label[y][None, :]))
    i, j = x[i], y[j]
    chosen: list[np.ndarray] = []
    while len(i):  # every root with a lower similar one takes one edge to such a one
        high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
        hooked, first = np.unique(high, return_index=True)
        chosen.append(np.stack((i[first], j[first])))
        parent = np.arange(int(label.max()) + 1)
        parent[hooked] = low[first]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    pairs = np.concatenate(chosen, axis=1) if chosen else np.zeros((2, 0), dtype=np.int64)
    return node[pairs[0]], node[pairs[1]]


def edges_of_bundles(dealt: DataFrame) -> DataFrame:
    """Edges that join different roots within the parts of bundles: rows chief, part, side, node, root, tokens."""

    def match(table: pa.Table) -> pa.Table:
        tokens = table.column("tokens").combine_chunks()
        node, root, side = (table.column(c).to_numpy() for c in ("node", "root", "side"))
        n = np.diff(tokens.offsets.to_numpy())
        a, b = spanning_edges(node, root, side, n.astype(np.int64), tokens.flatten().to_numpy())
        tidy()
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return dealt.groupBy("chief", "part").applyInArrow(match, "a long, b long")


def deal_bundles(star: DataFrame, found: DataFrame) -> DataFrame:
    """Members of bundles with several roots, dealt to the parts that compare them: chief, part, side, node, root.

    A bundle's members with the root of its chief are not compared with one
    another, only with the rest; the rest also among itself. Both are cut into
    blocks of at most about BLOCK members and TOKENS tokens.
    """
    roots = found.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    rooted = (
        star.join(roots, F.col("node") == F.col("_node"), "left")
        .select("chief", "node", "n", F.coalesce("_root", "node").alias("root"))
        .join(roots, F.col("chief") == F.col("_node"), "left")
        .select("chief", "node", "n", "root", (F.col("root") == F.coalesce("_root", "chief")).alias("main"))
    )
    rooted = materialize(rooted, "rooted")

    def blocks(which: Column) -> Column:
        members, tokens = F.count(F.when(which, 1)), F.sum(F.when(which, F.col("n").cast("long")))
        return F.greatest(F.ceil(members / F.lit(BLOCK)), F.ceil(F.coalesce(tokens, F.lit(0)) / F.lit(TOKENS))).cast("int")

    mixed = (
        rooted.groupBy("chief")
        .agg(F.min("root").alias("r0"), F.max("root").alias("r1"), blocks(F.col("main")).alias("_mains"), blocks(~F.col("main")).alias("_rests"))
        .filter("r0 <> r1")
    )
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("_mains")).otherwise(F.col("_rests"))).cast("int")

    def part(kind: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    def numbers(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    with_rest = F.transform(numbers(F.col("_rests")), lambda j: part(0, F.col("mine"), j, F.lit(1)))
    with_main = F.transform(numbers(F.col("_mains")), lambda i: part(0, i, F.col("mine"), F.lit(2)))
    inside = F.transform(
        numbers(F.col("_rests")),
        lambda j: part(
            1,
            F.least("mine", j),
            F.greatest("mine", j),
            F.when(F.col("mine") == j, 0).when(F.col("mine") < j, 1).otherwise(2),
        ),
    )
    parts = F.when(F.col("main"), with_rest).otherwise(F.concat(with_main, inside))
    return (
        rooted.join(mixed, "chief")
        .withColumn("mine", mine)
        .withColumn("p", F.explode(parts))
        .select("chief", F.struct("p.kind", "p.i", "p.j").alias("part"), F.col("p.side").alias("side"), "node", "root")
    )


def link_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, root and component_id of every row; a row without shingles has no node and no root."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = min(24, max(4, int(np.ceil(np.log2(max(1, docs.count()) * 512 / 2**21)))))
    scanned = materialize(describe(docs, bits), "described")
    hot, classes, counted = frequent_tokens(scanned.filter(F.col("range").isNotNull()).select("range", "blob"), bits)
    rows = materialize(scanned.filter(F.col("range").isNull()).select("doc_id", "n_shingles", "node"), "rows")
    discard(scanned)
    # equal sets are one node, which its first document stands for
    reps = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"))
    doubtful = F.col("doc_id").isNull() | (F.col("count") > 1)
    once = rows.filter(F.col("node").isNotNull()).groupBy("doc_id").count().filter(doubtful).isEmpty()

    shared = spark.sparkContext.broadcast((hot, classes))
    distinct = keyed_sets(docs, shared).groupBy("node", "n", "s").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = materialize(distinct, "nodes")
    entries = nodes.select("node", "n", "s", F.explode("keys").alias("key"))
    lists = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("chief")).filter("c > 1")
    index = materialize(entries.join(lists, "key"), "index")
    short = pairs_of_short_lists(index.filter(F.col("c") <= FREQUENT), counted)
    # long lists: every member with the list's chief; the lists of one chief are one bundle
    star = materialize(
        index.filter((F.col("c") > FREQUENT) & (F.col("node") != F.col("chief"))).select("chief", "node", "n").distinct(), "star"
    )
    both = short.union(star.select(F.col("chief").alias("a"), F.col("node").alias("b"))).distinct()
    pairs = materialize(plausible(both, nodes), "pairs")
    discard(index)
    discard(nodes)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = materialize(sets_of(docs, wanted.join(reps, "node"), once), "sets")
    edges = materialize(verify(pairs, sets), "edges")
    discard(pairs)
    discard(sets)
    found = components(edges)
    if not star.isEmpty():  # then the members of a bundle with one another, where they are not joined yet
        found = materialize(found, "components")
        dealt = materialize(deal_bundles(star, found), "dealt")
        members = materialize(sets_of(docs, dealt.select("node").distinct().join(reps, "node"), once), "members")
        more = materialize(edges_of_bundles(dealt.join(members, "node")), "more")
        discard(dealt)
        discard(members)
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    discard(star)
    named = reps.join(found, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "named")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    labels = materialize(named.select("node", "root").join(smallest, "root"), "labels")
    return rows.join(labels, "node", "left").select(
        "doc_id",
        "n_shingles",
        "node",
        "root",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs(doc_id, text)``.

    Documents link when their sets' similarity is 0.9 or more; a component's id
    is the smallest doc_id in it. A null or empty text, or one of blanks, has no
    shingles, no links and itself as component. A null doc_id takes part but
    never names a component, unless all of it are null. Rows that share a
    doc_id are judged row by row, each by its own text; equal texts are ties and
    get one component; a very long text is one set, held whole by one task. An
    empty table gives an empty result. Only doc_id and text are read.
    """
    return link_rows(docs).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with all its columns.

    The row with the smallest doc_id stays (a null id only where no row of the
    component has another); of several with that id the one of the least set,
    and of equal sets the least text. Rows without shingles (null, empty or
    blank texts) are linked with nothing and all stay. An empty table gives an
    empty result; other columns ride along, whatever their names.
    """
    linked = materialize(link_rows(docs).select("doc_id", "node", "root"), "linked")
    grouped = linked.filter(F.col("root").isNotNull())
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    first = grouped.groupBy("root").agg(F.min(mine).alias("first"))
    judged = grouped.join(first, "root").select("doc_id", "node", (mine == F.col("first")).alias("stays"))
    # ids of one row each are told apart by themselves, all others by their sets
    by_id = linked.groupBy("doc_id").count().filter(F.col("doc_id").isNull() | (F.col("count") > 1))
    several = materialize(by_id.select(F.col("doc_id").alias("_id")), "several")
    none = several.isEmpty()
    gone = judged.filter("not stays")
    if not none:
        gone = gone.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    gone = materialize(gone.select(F.col("doc_id").alias("_gone")), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    id_of = F.col("doc_id").cast("long")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), id_of.alias("_doc"), F.col("text").alias("_text"))
    single = whole if none else whole.join(several, F.col("_doc").eqNullSafe(F.col("_id")), "left_anti")
    kept = single.join(F.broadcast(gone) if few else gone, F.col("_doc") == F.col("_gone"), "left_anti").select("_row.*")
    if none:
        return kept

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes = []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text)
                nodes.append(signed(xxhash.xxh3_64_intdigest(tokens.tobytes())) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], ["_row", "_text", "_doc", "_node"])
        forget_words()

    again = whole.join(several, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("_row", "_text", "_doc")
    marked = materialize(again.mapInArrow(mark, StructType([*again.schema.fields, StructField("_node", LongType())])), "marked")
    stay = judged.filter("stays").select(F.col("doc_id").alias("_d"), F.col("node").alias("_n")).distinct()
    chosen = (
        marked.join(stay, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_node") == F.col("_n")), "left_semi")
        .groupBy("_doc", "_node")
        .agg(F.min_by("_row", F.struct("_text")).alias("_row"))
        .select("_row.*")
    )
    return kept.union(marked.filter(F.col("_node").isNull()).select("_row.*")).union(chosen)
