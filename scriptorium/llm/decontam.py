"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are the runs of digits, letters a-z (after A-Z are lowered) and
non-ASCII characters. Each benchmark item gives its windows of ``width``
consecutive words; an item with fewer words, but some, is one window. The
windows are kept as arrays: sorted hashes, and for each the place of its words
in the benchmark and the items that hold it. The document scan maps words to
the benchmark's vocabulary, hashes every window of known words, looks the
hashes up, and verifies each hit word by word.

The benchmark is read in blocks of a bounded number of words, each broadcast by
itself. A worker holds a few of them at a time; however many there are, it
takes a bounded buffer of texts through one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, tidy

#: Bytes to words: A-Z lowered, ASCII other than 0-9 and a-z becomes a blank, all other bytes stay.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Benchmark words of a broadcast block (some 30 bytes each, and its vocabulary), blocks that a worker holds, and bytes of
#: texts that it takes through all of them.
BLOCK_WORDS, HELD, BUFFER = 1_000_000, 2, 32 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


@dataclass
class Windows:
    """Different windows of one length: sorted hashes, the place of the first of each, and its items (by number)."""

    hashes: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    items: np.ndarray


class WindowSet:
    """Windows of benchmark items by length."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int = 10):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        parts = [np.array([number(w, len(self.vocabulary)) for w in words], dtype=np.int32) for _, words in items]
        self.names = [item for item, _ in items]
        self.ids = np.concatenate([*parts, np.zeros(0, dtype=np.int32)])
        self.code = np.random.default_rng(20).integers(0, 2**63, size=max(1, len(self.vocabulary)), dtype=np.uint64)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        self.windows: dict[int, Windows] = {}
        for size in sorted({min(width, n) for n in sizes.tolist()} - {0}):
            mine = np.flatnonzero(np.minimum(sizes, width) == size)
            counts = sizes[mine] - size + 1
            owner = np.repeat(mine, counts)
            place = np.repeat(begins[mine] - np.cumsum(counts) + counts, counts) + np.arange(len(owner))
            self.windows[size] = self._group(self.rolling(self.ids, size)[place], place, owner, size)

    def _group(self, hashes: np.ndarray, place: np.ndarray, owner: np.ndarray, size: int) -> Windows:
        order = np.lexsort((owner, hashes))
        hashes, place, owner = hashes[order], place[order], owner[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        for k in range(size):  # windows of one hash but other words are told apart
            new[1:] |= self.ids[place[1:] + k] != self.ids[place[:-1] + k]
        more = new.copy()
        more[1:] |= owner[1:] != owner[:-1]  # each item of a window once
        begin = np.flatnonzero(new)
        return Windows(hashes[begin], place[begin], np.append(np.cumsum(more)[begin] - 1, more.sum()), owner[more].astype(np.int32))

    def rolling(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Hash of the window that begins at each position; an unknown word (-1) gives any."""
        codes = self.code[ids]
        out = np.zeros(max(0, len(ids) - size + 1), dtype=np.uint64)
        for k in range(size):
            out = out * MULTIPLIER + codes[k : k + len(out)]
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """Mask of hit words, and the items with an occurring window."""
        hit = np.zeros(len(words), dtype=bool)
        items: set[str | None] = set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
        strange = np.concatenate(([0], np.cumsum(ids < 0)))
        for size, table in self.windows.items():
            if len(ids) < size:
                continue
            known = np.flatnonzero(strange[size:] == strange[:-size])
            if not len(known):
                continue
            hashed = self.rolling(ids, size)[known]
            left = np.searchsorted(table.hashes, hashed)
            met = np.flatnonzero(table.hashes[np.minimum(left, len(table.hashes) - 1)] == hashed)
            known, left = known[met], left[met]
            step = np.arange(size)
            while len(known):
                same = (self.ids[table.first[left][:, None] + step] == ids[known[:, None] + step]).all(axis=1)
                for k in known[same].tolist():
                    hit[k : k + size] = True
                for g in np.unique(left[same]).tolist():
                    items.update(self.names[i] for i in table.items[table.ends[g] : table.ends[g + 1]].tolist())
                left = left + 1  # the next window of the same hash, if there is one
                on = left < len(table.hashes)
                on[on] = table.hashes[left[on]] == table.hashes[left[on] - 1]
                known, left = known[on], left[on]
        return hit, items


def spans_of(hit: np.ndarray) -> list[list[int]]:
    """Hit words as [start, end) ranges."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edges.reshape(-1, 2).tolist()


def benchmark_blocks(benchmark: DataFrame, width: int, block_words: int = BLOCK_WORDS) -> Iterator[WindowSet]:
    """The windows of the benchmark in blocks of a bounded number of words; a longer item is cut where windows overlap."""
    block: list[tuple[str | None, list[bytes]]] = []
    room = block_words
    for row in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        words = words_of(row["text"])
        step = max(block_words, width)
        for begin in range(0, max(1, len(words) - width + 1), step):
            part = words[begin : begin + step + width - 1]
            if len(part) > room and block:
                yield WindowSet(block, width)
                block, room = [], block_words
            block.append((row["item"], part))
            room -= len(part) + 1
    yield WindowSet(block, width)


#: Broadcast blocks that this worker holds, the one used last at the end.
_HELD: list = []


def held(block) -> WindowSet:
    """The windows of a broadcast block; more than a few are not held at a time but loaded again from the worker's machine."""
    if block in _HELD:
        _HELD.remove(block)
    _HELD.append(block)
    while len(_HELD) > HELD:
        vars(_HELD.pop(0)).pop("_value", None)
    return block.value


def probes(blocks: list, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[set]]]:
    """Each batch with the masks of hit words and the items of its texts (column ``at``)."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[set]]]:
        hits: list[list] = [[None] * batch.num_rows for batch in waiting]
        named: list[list[set]] = [[set() for _ in range(batch.num_rows)] for batch in waiting]
        for block in blocks:
            windows = held(block)
            for b, batch in enumerate(waiting):
                for i, text in enumerate(batch.column(at).to_pylist()):
                    more, found = windows.scan(words_of(text))
                    if hits[b][i] is None:
                        hits[b][i] = more
                    elif found:
                        hits[b][i] |= more
                    named[b][i] |= found
        yield from zip(waiting, hits, named, strict=True)

    for batch in batches:
        waiting.append(batch)
        size += batch.column(at).nbytes
        if size >= BUFFER or len(blocks) <= 1:  # one block needs no buffer
            yield from flush()
            waiting, size = [], 0
    yield from flush()


def find_blocks(benchmark: DataFrame, width: int, block_words: int) -> list:
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(windows) for windows in benchmark_blocks(benchmark, width, block_words)]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, spans of hit words and sorted items.

    The benchmark's windows are broadcast in blocks of ``block_words`` words, so
    what is broadcast at a time has a fixed bound, as has what a worker holds;
    several blocks mean several probes of each document inside one scan. A null
    text has no words and no hits; a very long one is scanned whole by one task;
    repeated rows are scanned row by row; a null item_id marks hits but is not
    listed or counted; empty tables give no rows or no hits. Columns other than
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    blocks = find_blocks(benchmark, width, block_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits, named in probes(blocks, batches, 1):
            n_words, n_hit, spans, items = [], [], [], []
            for hit, found in zip(hits, named, strict=True):
                n_words.append(len(hit))
                n_hit.append(int(hit.sum()))
                spans.append(spans_of(hit))
                items.append(sorted(x for x in found if x is not None))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "n_hit", "spans", "items"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, n_words long, n_hit long, spans array<array<int>>, items array<string>"
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns, whatever their names.

    Null and empty texts have no hit and stay, as do all rows where the
    benchmark is empty; repeated rows are judged row by row; a very long text is
    scanned whole by one task; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    blocks = find_blocks(benchmark, width, block_words)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits, _ in probes(blocks, batches, at):
            yield batch.filter(pa.array([not hit.any() for hit in hits], pa.bool_()))
        tidy()

    return docs.mapInArrow(keep, docs.schema)


def items_digest(items: list[str]) -> str:
    """Lower-case hex sha256 of the comma-joined items."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
