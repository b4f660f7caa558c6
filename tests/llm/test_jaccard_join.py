import random

import numpy as np
import pytest

from scriptorium.llm import jaccard_join as J


def brute(rows):
    """n_shingles and component of every row by comparing all pairs."""
    sets = []
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    for _, text, *_ in rows:
        w = (text or "").encode().translate(table).split()
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), doc if not sets[i] else min(ids, default=None)))
    return sorted(out, key=str)


def linked(frame):
    return sorted((tuple(r) for r in J.link_documents(frame).collect()), key=str)


def test_awkward_rows(docs, rows, none):
    assert linked(docs) == brute(rows)
    assert J.link_documents(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_of_near_copies_with_common_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 4)
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "MAX_FREQUENT", 10_000 if seed < 3 else 50)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    rows = []
    for size in (40, 12, 7, 3):
        base = passage[: r.randint(0, 30)] + [word() for _ in range(r.randint(60, 150))]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(passage + [word() for _ in range(60)])) for i in range(40)]
    assert linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in J.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def near_group(seed, size, words, edits):
    """Near copies of one text, with so many edits each that their similarity lies on both sides of 0.9."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(size):
        copy = list(base)
        for _ in range(r.choice(edits)):
            copy[r.randrange(words)] = f"x{i}y{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_a_large_group_on_both_sides_of_the_threshold(spark):
    texts = near_group(5, 700, 120, [1, 2, 2, 3]) + near_group(6, 300, 40, [0, 1, 1])
    rows = list(enumerate(texts))
    want = brute(rows)
    assert 2 < len({c for _, _, c in want}) < 900
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert linked(frame) == want


@pytest.mark.parametrize("block", [8, 50])
def test_bundles_of_many_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "COLUMNS", 37)
    rows = list(enumerate(near_group(7, 150, 120, [1, 2, 2, 3]) + near_group(8, 60, 200, [3, 5, 6])))
    assert linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_edges_of_a_block_are_fewer_than_its_members():
    sets = [set(range(100)) - {i, i + 1} for i in range(0, 60, 2)] + [set(range(200, 260))]
    n = np.array([len(s) for s in sets])
    flat = np.concatenate([np.array(sorted(s)) for s in sets])
    node, side = np.arange(len(sets)), np.zeros(len(sets), dtype=int)
    a, b = J.spanning_edges(node, node, side, n, flat)
    assert len(a) == 29 and set(a) | set(b) == set(range(30))
    root = np.where(node < 10, 0, node)
    a, _ = J.spanning_edges(node, root, side, n, flat)
    assert len(a) == 20


def test_prefixes_share_a_key_of_every_similar_pair():
    r = np.random.default_rng(4)
    for _ in range(400):
        n = int(r.integers(9, 90))
        common = r.integers(0, 2**62, n, dtype=np.uint64)
        dx = int(r.integers(0, n // 10 + 2))
        dy = int(r.integers(0, n // 9 + 2))
        x = np.unique(np.concatenate((common[dx:], r.integers(0, 2**62, int(r.integers(0, n // 10 + 1)), dtype=np.uint64))))
        y = np.unique(np.concatenate((common[: len(common) - dy], r.integers(0, 2**62, int(r.integers(0, n // 10 + 1)), dtype=np.uint64))))
        both = len(set(x.tolist()) & set(y.tolist()))
        if both < len(x) and 100 * both >= 90 * (len(x) + len(y) - both):
            rare = int(r.integers(0, 3))  # a class that depends on the token alone
            ranks = [np.where(t % np.uint64(7) < rare, 0, (t % np.uint64(5) + np.uint64(1))).astype(np.int8) for t in (x, y)]
            kx, ky = J.index_keys(x, ranks[0])[0], J.index_keys(y, ranks[1])[0]
            assert set(kx.tolist()) & set(ky.tolist())


def test_one_of_each_group_stays(docs, rows):
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    components = {c for _, _, c in brute(rows)}
    assert sorted(x for x in ids if x is not None) == sorted(x for x in components if x is not None)


def test_rows_stay_by_their_own_text(spark, none):
    a, b, c = (near_group(k, 1, 30, [0])[0] for k in (1, 2, 3))
    rows = [(3, a), (5, a), (5, b), (None, b), (None, c), (None, c.upper()), (6, None), (6, None), (7, a), (8, c + " more"), (9, "z " + c + " more")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as _node", "map('k', doc_id) as _row")
    got = sorted(((r["doc_id"], r["text"]) for r in J.keep_first(frame).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (6, None), (6, None), (8, c + " more")], key=str)
    assert J.keep_first(none).count() == 0


def test_packed_tokens_come_back():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**32, 1000, dtype=np.uint64))
    distinct, counts = J.unpack_counts(J.pack_counts(np.concatenate((keys, keys[-1:]))))
    assert (np.repeat(distinct, counts) == np.concatenate((keys, keys[-1:]))).all()


def test_counts_of_tokens_that_every_document_holds_stay_small():
    """A token comes to its range once from each flush: as many bytes for a thousand holders as for a million."""
    rng = np.random.default_rng(2)
    for keys in (np.sort(rng.integers(0, 1 << 32, 5000, dtype=np.uint64)), np.sort(rng.integers(0, 50, 5000).astype(np.uint64)), np.array([7], dtype=np.uint64)):
        distinct, counts = np.unique(keys, return_counts=True)
        got = J.unpack_counts(J.pack_counts(keys))
        assert (got[0] == distinct).all() and (got[1] == counts).all()
    hot = [J.unpack_counts(J.pack_counts(np.full(n, 9, dtype=np.uint64))) for n in (1000, 1_000_000)]
    assert [len(keys) for keys, _ in hot] == [1, 1] and [int(c[0]) for _, c in hot] == [1000, 1_000_000]


def test_whole_sets_travel_for_plausible_pairs_only(spark, monkeypatch):
    # no token counts as frequent: 40 texts with one passage meet in long lists of single tokens
    monkeypatch.setattr(J, "FREQUENT", 4)
    monkeypatch.setattr(J, "MAX_FREQUENT", 0)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(120)] + passage)) for i in range(40)]
    rows.append((40, rows[7][1] + " more"))
    asked, verify = [], J.verify
    monkeypatch.setattr(J, "verify", lambda pairs, sets: asked.append(pairs.count()) or verify(pairs, sets))
    assert linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
    assert asked == [1] or asked == [0]  # the near copy meets the other or their list's chief alone


def test_sketches_drop_no_similar_pair(spark):
    r = random.Random(9)
    sets = []
    for n in (9, 30, 400, 3000):
        base = [r.getrandbits(64) for _ in range(n)]
        sets += [base, base[: -(n // 10)], base[n // 20 :] + [r.getrandbits(64) for _ in range(n // 25)], [r.getrandbits(64) for _ in range(n)]]
    arrays = [np.sort(np.array(x, dtype=np.uint64)) for x in sets]
    nodes = spark.createDataFrame([(i, len(x), J.sketch(x).tolist()) for i, x in enumerate(arrays)], "node long, n int, sketch array<long>")
    every = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    kept = {tuple(p) for p in J.plausible(spark.createDataFrame(every, "a long, b long"), nodes).collect()}
    similar = {(i, j) for i, j in every if 100 * len({*sets[i]} & {*sets[j]}) >= 90 * len({*sets[i]} | {*sets[j]})}
    assert len(similar) >= 7 and similar <= kept and not kept & {(8, 11), (4, 7), (0, 3)}
