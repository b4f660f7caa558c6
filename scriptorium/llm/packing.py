"""Best-fit packing by a configuration linear program over the length histogram.

Pieces are at most ``capacity`` long, so their histogram has at most
``capacity`` bins however many pieces there are; only it comes to the driver.
The covering program (patterns of lengths that fit a sequence; use as few as
possible so that every length is covered) is solved by multiplicative weights:
a length's price falls by a factor with its coverage, and a knapsack gives the
best pattern at these prices. A first run uses every pattern as often as it
can and prices some lengths at a time. Unless a lower bound shows the plan that
comes of it to be within ``GAP`` (and less than one sequence more), a second
run prices all lengths and uses patterns in small steps, so that weights
accumulate; its prices bound the optimum from below, and its patterns start a
simplex over all lengths, which closes the last percent, for which weights
alone would take some ln(m) / GAP^2 rounds. The solution is rounded down to
whole patterns, the rest of the histogram is packed like the first plan, and
the shorter plan holds. Best fit packs the longest first, many equal sequences
at a time. Pieces then take the plan's slots by their rank among all pieces of
their length, found by one range exchange over (length, id), so no length,
however common, meets in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, exchange_parts, materialize, ship_package, text_or_empty
from .tokens import CACHE_SIZE, public_path, tokenizer

#: A sequence's tokens, the most rounds of the program, lengths priced in one.
CAPACITY, ROUNDS, PRICED = 4096, 8192, 64
#: How far above the lower bound, as a share of it, a plan or the program's value may lie to be final.
GAP = 0.002
#: How strongly prices fall with coverage, and the share of a length that a round covers.
RATE, STEP = 0.1, 1.0
#: Prices grow a little faster than sizes, so that of equally full patterns the one with larger pieces wins; a pattern
#: must fill this share of a sequence; after so many worse ones in a row the rest is left to best fit.
POWER, FILL, MISSES = 1.2, 0.99, 20
#: The second run: how strongly prices fall with coverage, the share of a length that a step covers, and its most rounds.
WEIGHT, SHORT, SECOND = 4.0, 0.05, 1000
Pattern = tuple[dict[int, int], int]


def price_pattern(lengths: np.ndarray, counts: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable pattern: a knapsack over the lengths, each at most as often as it occurs.

    Copies of a length are taken in bundles of 1, 2, 4, ..., so each bundle is
    one vector step over all fills.
    """
    best = np.zeros(capacity + 1)
    items: list[tuple[int, int]] = []
    taken: list[np.ndarray] = []
    for size, count, value in zip(lengths.tolist(), counts.tolist(), values.tolist(), strict=True):
        left, bundle = min(count, capacity // size), 1
        while left > 0:
            copies = min(bundle, left)
            weight = copies * size
            other = best[:-weight] + copies * value
            better = other > best[weight:] + 1e-15
            taken.append(np.concatenate((np.zeros(weight, dtype=bool), better)))
            best[weight:][better] = other[better]
            items.append((size, copies))
            left -= copies
            bundle *= 2
    at = int(np.argmax(best))
    pattern: dict[int, int] = {}
    for (size, copies), took in zip(reversed(items), reversed(taken), strict=True):
        if took[at]:
            pattern[size] = pattern.get(size, 0) + copies
            at -= size * copies
    return pattern


def solve_program(
    histogram: dict[int, int],
    capacity: int = CAPACITY,
    rounds: int = ROUNDS,
    rate: float = RATE,
    step: float = STEP,
    spread: int = PRICED,
) -> list[tuple[dict[int, int], float]]:
    """The first run: full patterns and how often each is used, until few are left.

    A length's price is a power of its size times exp(-rate * covered share), so
    lengths that lag behind grow dear and steer the patterns. Every round prices
    ``spread`` of the uncovered lengths, evenly spaced over all of them from a
    shifting start, and uses the best pattern as often as covers the share
    ``step`` of its scarcest length, once at least.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], dtype=np.float64)
    used = np.zeros(len(lengths))
    place = {x: i for i, x in enumerate(lengths.tolist())}
    rng = np.random.default_rng(8)
    out: dict[tuple[tuple[int, int], ...], float] = {}
    misses = 0
    for _ in range(rounds):
        use = np.flatnonzero(used < counts - 1e-9)
        if not len(use):
            break
        if len(use) > spread:
            use = use[np.unique((rng.random() + np.arange(spread)) * len(use) / spread).astype(int) % len(use)]
        left = counts[use] - used[use]
        prices = (lengths[use] / capacity) ** POWER * np.exp(-rate * used[use] / counts[use])
        pattern = price_pattern(lengths[use], np.ceil(left - 1e-9).astype(np.int64), prices, capacity)
        if sum(x * k for x, k in pattern.items()) < FILL * capacity:
            misses += 1
            if misses > MISSES:
                break
            continue
        misses = 0
        most = min((counts[place[x]] - used[place[x]]) / k for x, k in pattern.items())
        amount = min(most, max(1.0, step * min(counts[place[x]] / k for x, k in pattern.items())))
        key = tuple(sorted(pattern.items()))
        out[key] = out.get(key, 0.0) + amount
        for x, k in pattern.items():
            used[place[x]] += amount * k
    return [(dict(key), amount) for key, amount in out.items()]


def weigh_configurations(
    histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = SECOND, rate: float = WEIGHT, step: float = SHORT
) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Multiplicative weights over all lengths: patterns with amounts that cover what each round has reached, and a lower bound.

    The weight of a length begins with its share of a sequence and is
    multiplied by exp(-rate * share) whenever that share of its demand is
    covered. The rounds' weights, each divided by its best pattern's worth, are
    averaged; their sum over the demand, divided by the worth of the best
    pattern at them, is no more than the optimum. Amounts are scaled to cover
    every length once where all have been met.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64)
    place = {x: i for i, x in enumerate(lengths.tolist())}
    covered, mean = np.zeros(len(lengths)), np.zeros(len(lengths))
    amounts: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(rounds):
        weights = lengths / capacity * np.exp(-rate * (covered - covered.min()))
        pattern = price_pattern(lengths, counts, weights, capacity)
        mean += weights / sum(k * weights[place[x]] for x, k in pattern.items())
        amount = step * min(counts[place[x]] / k for x, k in pattern.items())
        key = tuple(sorted(pattern.items()))
        amounts[key] = amounts.get(key, 0.0) + amount
        for x, k in pattern.items():
            covered[place[x]] += amount * k / counts[place[x]]
    scale = 1 / covered.min() if covered.min() > 0 else 1.0
    best = price_pattern(lengths, counts, mean, capacity)
    bound = float(mean @ counts) / sum(k * mean[place[x]] for x, k in best.items())
    return [(dict(key), amount * scale) for key, amount in amounts.items()], bound


def solve_configurations(
    histogram: dict[int, int], pool: list[dict[int, int]], capacity: int = CAPACITY, gap: float = GAP, bound: float = 0.0
) -> tuple[list[tuple[dict[int, int], float]], float]:
    """The covering program over all lengths: patterns with their amounts, and a lower bound on any plan's sequences.

    A revised simplex method starts from patterns of one length each and takes
    columns from ``pool`` and from the knapsack. It ends when no pattern is worth
    more than 1 at the dual weights, or the value is within ``gap`` of the bound.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64)
    m, place = len(lengths), {x: i for i, x in enumerate(lengths.tolist())}
    bound = max(bound, float(lengths @ counts) / capacity)

    def column(pattern: dict[int, int]) -> np.ndarray:
        out = np.zeros(m)
        for x, k in pattern.items():
            out[place[x]] = k
        return out

    single = np.minimum(capacity // lengths, counts).astype(np.float64)
    basis, cost, inverse = np.diag(single), np.ones(m), np.diag(1 / single)
    columns = np.array([column(p) for p in pool]).reshape(len(pool), m)
    # a slightly larger demand, another for each length, so that no step stands still
    demand = counts * (1 + 1e-7 * np.random.default_rng(8).random(m))
    amounts, pivots = inverse @ demand, 0
    while True:
        weights = cost @ inverse
        low = int(np.argmin(weights))
        if weights[low] < -1e-9:
            entering, price = -np.eye(1, m, low)[0], 0.0  # cover this length more than asked
        else:
            weights = np.maximum(weights, 0.0)
            worth = columns @ weights
            at = int(np.argmax(worth)) if len(worth) else -1
            if at >= 0 and worth[at] > 1 + 1e-7:
                entering, price = columns[at], 1.0
            else:
                entering, price = column(price_pattern(lengths, counts, weights, capacity)), 1.0
                value = float(entering @ weights)
                bound = max(bound, float(weights @ counts) / max(value, 1.0))
                if value <= 1 + 1e-7 or cost @ amounts <= bound * (1 + gap):
                    break
                columns = np.vstack((columns, entering))
        step = inverse @ entering
        grows = np.flatnonzero(step > 1e-9)
        leaving = int(grows[np.argmin(amounts[grows] / step[grows])])
        basis[:, leaving], cost[leaving] = entering, price
        pivots += 1
        if pivots % 200:
            row = inverse[leaving] / step[leaving]
            inverse -= np.outer(step, row)
            inverse[leaving] = row
        else:
            inverse = np.linalg.inv(basis)
        amounts = np.maximum(inverse @ demand, 0.0)
    found = np.maximum(inverse @ counts, 0.0)
    patterns = [
        ({int(lengths[i]): int(basis[i, j]) for i in np.flatnonzero(basis[:, j])}, float(found[j]))
        for j in np.flatnonzero((cost > 0) & (found > 1e-9))
    ]
    return patterns, bound


def round_down(solution: list[tuple[dict[int, int], float]], histogram: dict[int, int]) -> tuple[list[Pattern], dict[int, int]]:
    """Whole uses of the patterns that the histogram allows, and what is left of it."""
    left = dict(histogram)
    out: list[Pattern] = []
    for pattern, amount in sorted(solution, key=lambda s: -s[1]):
        times = min(int(amount + 1e-6), *(left.get(x, 0) // k for x, k in pattern.items()))
        if times > 0:
            out.append((pattern, times))
            for x, k in pattern.items():
                left[x] -= k * times
    return out, {x: n for x, n in left.items() if n}


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Pack what is left, the longest first, each sequence by the longest pieces that still fit; equal ones at once."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in histogram.items():
        count[x] = n
    present = sorted(histogram)
    out: list[Pattern] = []
    import bisect

    while present:
        room, pattern, limit = capacity, {}, len(present)
        while room and limit:
            at = bisect.bisect_right(present, room, 0, limit) - 1
            if at < 0:
                break
            x = present[at]
            k = int(min(count[x] - pattern.get(x, 0), room // x))
            if k:
                pattern[x] = pattern.get(x, 0) + k
                room -= k * x
            limit = at
        times = int(min(count[x] // k for x, k in pattern.items()))
        out.append((pattern, times))
        for x, k in pattern.items():
            count[x] -= k * times
            if not count[x]:
                del present[bisect.bisect_left(present, x)]
    return out


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[Pattern]:
    """Patterns with whole multiplicities that use every piece exactly once."""

    def fill(rest: dict[int, int]) -> list[Pattern]:
        whole, left = round_down(solve_program(rest, capacity, rounds), rest)
        return min(whole + best_fit(left, capacity), best_fit(rest, capacity), key=sequences)

    if not histogram:
        return []
    plan = fill(histogram)
    if sequences(plan) <= math.ceil(sum(x * n for x, n in histogram.items()) / capacity * (1 + GAP) - 1e-9):
        return plan
    weighed, bound = weigh_configurations(histogram, capacity)
    solution, _ = solve_configurations(histogram, [p for p, _ in [*plan, *weighed]], capacity, bound=bound)
    whole, left = round_down(solution, histogram)
    return min(plan, whole + fill(left), key=sequences)


def sequences(plan: list[Pattern]) -> int:
    return sum(times for _, times in plan)


class Slots:
    """Slots of a plan by length: from the rank of a piece among its length to sequence and offset."""

    def __init__(self, plan: list[Pattern]):
        sequence = 0
        by_length: dict[int, list[tuple[int, int, int, int]]] = {}
        for pattern, times in plan:
            offset = 0
            for size, copies in sorted(pattern.items(), reverse=True):
                by_length.setdefault(size, []).append((copies * times, sequence, copies, offset))
                offset += size * copies
            sequence += times
        self.sequences = sequence
        self.table = {}
        for size, rows in by_length.items():
            slots, first, copies, offset = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
            self.table[size] = (np.cumsum(slots), first, copies, offset)

    def place(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends, first, copies, offset = self.table[size]
        at = np.searchsorted(ends, ranks, side="right")
        inside = ranks - np.where(at > 0, ends[at - 1], 0)
        return first[at] + inside // copies[at], offset[at] + (inside % copies[at]) * size


def tokenise_pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 1, cache_size: int = CACHE_SIZE
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32; only texts over ``capacity`` are cut.

    ``cache_size`` bounds the pre-tokens that a worker remembers.
    A null or empty text has only the end id; repeated rows give pieces each.
    """
    ship_package(docs.sparkSession)
    vocabulary = vocabulary or public_path("word_bpe_49k.json")
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(vocabulary, cache_size)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows: list[tuple[int | None, int, int, int, int]] = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    raw = ids + end
                    for k in range(0, len(raw), 4 * capacity):
                        cut = raw[k : k + 4 * capacity]
                        rows.append((doc, k // (4 * capacity), k // 4, len(cut) // 4, zlib.crc32(cut)))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        encode, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to every row of ``pieces(doc_id, piece, length, ...)``.

    Lengths are 1 to ``capacity``; any other length raises an error. Equal rows
    take slots of their own, in any order; an empty table gives an empty
    result; other columns ride along.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    pieces = materialize(pieces, "pieces")
    if pieces.filter(F.col("length").isNull() | ~F.col("length").between(1, capacity)).limit(1).count():
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    rows = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = {int(r["length"]): int(r["count"]) for r in rows}
    slots = Slots(plan_sequences(histogram, capacity, rounds))
    names = [f.name for f in pieces.schema.fields]
    at = names.index("length")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ranks = np.arange(n, n + batch.num_rows, dtype=np.int64)
            n += batch.num_rows
            parts = pa.array(np.full(batch.num_rows, part, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(ranks)], [*names, "_part", "_rank"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    tasks = exchange_parts(pieces)
    order = ["length", F.col("doc_id").asc_nulls_first(), "piece"]
    ranked = materialize(
        pieces.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(number, f"{fields}, _part int, _rank long"),
        "ranked",
    )
    discard(pieces)
    sizes = ranked.groupBy("_part").count().collect()  # a row for each task
    base, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        base[r["_part"]] = total
        total += r["count"]
    before, total = {}, 0
    for size in sorted(histogram):
        before[size] = total
        total += histogram[size]
    shared = spark.sparkContext.broadcast((slots, base, before))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, bases, firsts = shared.value
        for batch in batches:
            sizes = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = batch.column(len(names)).to_numpy()
            ranks = batch.column(len(names) + 1).to_numpy()
            sequence, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
            if len(sizes):
                ranks = ranks + np.array([bases[p] for p in parts.tolist()], dtype=np.int64)
            for size in np.unique(sizes).tolist():
                mask = sizes == size
                sequence[mask], offset[mask] = plan.place(size, ranks[mask] - firsts[size])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(assign, f"{fields}, sequence_id long, offset long")
