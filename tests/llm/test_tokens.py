import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import packing as P
from scriptorium.llm import token_output as T
from scriptorium.llm.tokens import public_path, tokenizer

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
LIBRARY = {n: Tokenizer.from_file(public_path(n)) for n in NAMES}


def plain_ids(name, text):
    """The library by itself, loaded from the file and not touched."""
    return LIBRARY[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|", "|>", " ", "a<|endoftext|>b"]),
            st.text(alphabet=st.sampled_from("aBé'sSt  \n\t01,.!ñß<|endoftext|>\x01\x02\x0b日²½İ"), max_size=20),
        ),
        max_size=5,
    ).map("".join)
)
def test_same_ids_as_the_library(name, text):
    assert np.frombuffer(tokenizer(public_path(name)).encode([text])[0], dtype="<u4").tolist() == plain_ids(name, text)


@pytest.mark.parametrize("name", NAMES)
def test_every_added_token_is_read_as_the_library_reads_it(name):
    for token in json.loads(Path(public_path(name)).read_text())["added_tokens"]:
        for text in (token["content"], f"hello {token['content']} x", f"a{token['content']}b{token['content']}", token["content"].upper()):
            got = np.frombuffer(tokenizer(public_path(name)).encode([text])[0], dtype="<u4").tolist()
            assert got == plain_ids(name, text)
            assert (token["id"] in got) == (token["content"] in text)


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("size", [0, 1, 7, 8, 1000, 65537])
def test_segment_round_trip(kind, size):
    ids = np.random.default_rng(size).integers(0, 2**32, size, dtype=np.uint32)
    counts = [size // 3, size - size // 3]
    docs, n, back = T.decode_segment(T.encode_segment([None, -5], counts, ids, kind, block=1000))
    assert docs == [None, -5] and n.tolist() == counts and (back == ids).all()


def expected(rows, name, end):
    library = Tokenizer.from_file(public_path(name))
    out = []
    for doc, text, *_ in rows:
        out.append((doc, np.array([*library.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")))
    return out


def test_files_hold_all_ids_in_order(spark, docs, rows, none, tmp_path):
    T.write_tokens(docs, str(tmp_path / "t"), segment_ids=5000, block=512, kind="bit")
    got = T.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    want = sorted(expected(rows, NAMES[0], 2), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    place = 0
    for r in got:
        assert r["start"] == place and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        place += r["n_tokens"]
    assert sorted((str(d), i.tolist()) for d, i in want) == sorted((str(r["doc_id"]), r["ids"]) for r in got)
    T.write_tokens(none, str(tmp_path / "n"))
    assert T.read_tokens(spark, str(tmp_path / "n")).count() == 0


def check_packing(rows_in, got, capacity):
    assert sorted(r["length"] for r in got) == sorted(rows_in)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= capacity
    return len(by)


def test_packing_is_gapless_and_near_the_bound(spark, docs, rows, none):
    got = P.pack_pieces(P.tokenise_pieces(docs)).collect()
    sizes = []
    for _, ids in expected(rows, NAMES[1], 1):
        sizes += [min(4096, len(ids) - k) for k in range(0, len(ids), 4096)]
    assert check_packing(sizes, got, 4096) == -(-sum(sizes) // 4096)
    assert P.pack_pieces(P.tokenise_pieces(none)).count() == 0
    rng = np.random.default_rng(0)
    lengths = np.concatenate((np.clip(rng.lognormal(3, 1, 3000), 1, 100), np.full(1500, 34))).astype(int).tolist()
    frame = spark.createDataFrame([(i, 0, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, extra string")
    n = check_packing(lengths, P.pack_pieces(frame, capacity=100).collect(), 100)
    assert n <= 1.02 * -(-sum(lengths) // 100)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plans_use_every_piece_once(histogram):
    used = {}
    for pattern, times in P.plan_sequences(histogram, 50):
        assert sum(x * k for x, k in pattern.items()) <= 50
        for x, k in pattern.items():
            used[x] = used.get(x, 0) + k * times
    assert used == histogram


def test_plans_reach_the_program_where_no_pattern_is_full():
    histogram = {2080: 600, 1070: 600, 1130: 600, 890: 1200}
    plan = P.plan_sequences(histogram)
    used = {}
    for pattern, times in plan:
        assert sum(x * k for x, k in pattern.items()) <= 4096
        for x, k in pattern.items():
            used[x] = used.get(x, 0) + k * times
    assert used == histogram
    assert sum(times for _, times in plan) <= 904  # no pattern holds more than 4040, so 900 are needed


def test_knapsack_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 30, 6))
        counts, values = rng.integers(1, 4, len(sizes)), rng.random(len(sizes))
        pattern = P.price_pattern(sizes, counts, values, 40)
        best = {0: 0.0}
        for s, c, v in zip(sizes, counts, values, strict=True):
            best = step(best, s, c, v)
        assert abs(sum(values[sizes.tolist().index(x)] * k for x, k in pattern.items()) - max(best.values())) < 1e-9


def step(best, size, count, value):
    out = {}
    for w, x in best.items():
        for k in range(count + 1):
            if w + k * size <= 40:
                out[w + k * size] = max(out.get(w + k * size, -1.0), x + k * value)
    return out


def least_sequences(histogram, capacity):
    """The fewest sequences, by trying every pattern for the longest piece that is left."""
    best: dict = {}

    def patterns(left, room, top):
        yield {}
        for x in sorted(left, reverse=True):
            if x <= min(room, top) and left[x]:
                for rest in patterns({**left, x: left[x] - 1}, room - x, x):
                    yield {**rest, x: rest.get(x, 0) + 1}

    def solve(left):
        key = tuple(sorted((x, n) for x, n in left.items() if n))
        if not key:
            return 0
        if key not in best:
            x = key[-1][0]
            rest = {**left, x: left[x] - 1}
            best[key] = 1 + min(solve({y: n - p.get(y, 0) for y, n in rest.items()}) for p in patterns(rest, capacity - x, x))
        return best[key]

    return solve(histogram)


@pytest.mark.parametrize("seed", range(12))
def test_plans_of_few_pieces_against_all_plans(seed):
    rng = np.random.default_rng(seed)
    sizes, counts = np.unique(rng.integers(8, 40, 9), return_counts=True)
    histogram = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    least = least_sequences(histogram, 60)
    assert least <= sum(n for _, n in P.plan_sequences(histogram, 60)) <= least + 1


@pytest.mark.parametrize("seed", range(5))
def test_weights_and_simplex_bracket_the_program(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(x): int(n) for x, n in zip(rng.integers(600, 2100, 25), rng.integers(50, 900, 25), strict=True)}
    weighed, low = P.weigh_configurations(histogram)
    covered = dict.fromkeys(histogram, 0.0)
    for pattern, amount in weighed:
        assert sum(x * k for x, k in pattern.items()) <= 4096
        for x, k in pattern.items():
            covered[x] += amount * k
    assert all(covered[x] >= n - 1e-6 for x, n in histogram.items())
    solution, bound = P.solve_configurations(histogram, [p for p, _ in weighed], gap=0.0)
    optimum = sum(a for _, a in solution)
    assert bound == pytest.approx(optimum, rel=1e-5)
    assert 0.85 * optimum <= low <= optimum * (1 + 1e-9) <= (1 + 1e-6) * sum(a for _, a in weighed) <= 1.1 * optimum
