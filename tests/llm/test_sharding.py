import pathlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import queries
from scriptorium.llm import sharding as S


def plain_differencing(sizes, ways):
    """Partial partitions as lists of (sum, members), the two of largest spread joined by a search of all."""
    parts = [(k, [(size, [k])] + [(0, [])] * (ways - 1)) for k, size in enumerate(sizes)]
    born = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0][0] - p[1][-1][0]), p[0]))
        (_, a), (_, b) = parts[:2]
        joined = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)]
        joined.sort(key=lambda x: -x[0])
        parts = [*parts[2:], (born, joined)]
        born += 1
    return [members for _, members in parts[0][1]] if parts else [[] for _ in range(ways)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 60), st.integers(1, 10**12)), max_size=40), st.integers(1, 9))
def test_same_places_as_plain_differencing(sizes, ways):
    places = S.difference(sizes, ways).tolist()
    expected = plain_differencing(sizes, ways)
    assert [sorted(k for k, p in enumerate(places) if p == w) for w in range(ways)] == [sorted(m) for m in expected]


def test_differencing_is_tighter_than_the_largest_first_rule():
    sizes = np.random.default_rng(1).integers(1, 10**6, 2000).tolist()
    greedy = [0] * 16
    for size in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += size
    sums = np.bincount(S.difference(sizes, 16), weights=sizes, minlength=16)
    assert sums.max() - sums.min() < (max(greedy) - min(greedy)) / 10


def check(found, rows, shards=16, slack=0.01):
    """Every row once, its size and checksum, groups whole, slots gapless, bytes as even as the groups allow."""
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (d, s, zlib.crc32((t or "").encode())) for (d, t), s in zip(rows, sizes, strict=True)
    )
    slots, sums, group = defaultdict(list), Counter(), defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
        group[(r["size"], r["text_crc32"])].add(r["shard"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values()) and all(0 <= s < shards for s in slots)
    assert all(len(s) == 1 for s in group.values())
    bytes_of = Counter()
    for (_, t), s in zip(rows, sizes, strict=True):
        bytes_of[t or ""] += s
    largest = max(bytes_of.values(), default=0)
    mean = sum(sizes) / shards
    least = max(mean, largest)
    assert max(sums.values(), default=0) <= least * (1 + slack)
    if largest <= mean:
        assert min(sums[k] for k in range(shards)) >= mean * (1 - slack)


def test_awkward_rows(spark, rows, docs):
    found = S.shard_documents(docs).collect()
    check(found, [(r[0], r[1]) for r in rows], slack=0)
    assert S.shard_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [0, 700])
def test_rounds_of_blocks_keep_the_balance(spark, monkeypatch, hot):
    """Bundles of several rounds, with a group of a third of all rows."""
    monkeypatch.setattr(S, "FINAL", 400)
    monkeypatch.setattr(S, "BLOCK", 128)
    rng = np.random.default_rng(hot)
    rows = [(k, "x" * int(n) + str(k)) for k, n in enumerate(rng.integers(5, 3000, 1400))]
    rows += [(5000 + k, "hot " * 40) for k in range(hot)] + [(None, None), (None, ""), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for shards in (16, 3):
        check(S.shard_documents(frame, shards).collect(), rows, shards)


def test_own_groups_and_written_shards(spark, tmp_path):
    rows = [(k, f"text {k} " * (k % 7 + 1), f"site{k % 40}" if k % 9 else None) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item string")
    S.write_shards(frame, f"{tmp_path}/out", 4, group=S.F.col("item"))
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == [(d, t) for d, t, _ in rows]
    sites = defaultdict(set)
    for r in back:
        sites[rows[r["doc_id"]][2]].add(r["shard"])
    assert all(len(s) == 1 for s in sites.values())
    sums = Counter()
    for r in back:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.05 * sum(sums.values()) / 4


def test_the_query_on_the_drivers_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not pathlib.Path(folder).is_dir():
        pytest.skip("the driver's tables are not here")
    found = queries.queries()["op11_sharding"](spark, folder).collect()
    check(found, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()])
    assert {(r["law"], r["grown_shard"]) for r in found} == {("bytes", None)}
