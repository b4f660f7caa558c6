import bisect
import hashlib
import pathlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from scriptorium.llm import alignment as A
from scriptorium.llm import queries
from scriptorium.llm.tokens import byte_alphabet, public_path

PIECES = SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
LIBRARY = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True
BYTE = {c: b for b, c in enumerate(byte_alphabet())}


def tokens_of(text):
    """(id, bytes) of both sides by the libraries alone; nothing where the bytes do not come back."""
    if not text:
        return [], []
    a = [(k, bytes(BYTE[c] for c in LIBRARY.id_to_token(k))) for k in LIBRARY.encode(f" {text}", add_special_tokens=False).ids]
    b = []
    for k in PIECES.encode(text):
        piece = PIECES.id_to_piece(k)
        b.append((k, bytes([int(piece[3:5], 16)]) if PIECES.is_byte(k) else piece.replace("▁", " ").encode()))
    plain = f" {text}".encode()
    return (a, b) if all(b"".join(x for _, x in side) == plain for side in (a, b)) else ([], [])


def spans(side):
    at, out = 0, []
    for k, raw in side:
        out.append((k, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows):
    out, held = [], []
    for doc, text in rows:
        a, b = map(spans, tokens_of(text))
        links = [(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e] if len(a) < 400 else swept(a, b)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        own = [defaultdict(list) for _ in range(2)]
        for side, tokens in zip(own, (a, b), strict=True):
            for k, _, e in tokens:
                side[bisect.bisect_left(cuts, e)].append(str(k))
        groups = ["|".join(",".join(side[g]) for side in own) for g in range(len(cuts))]
        held.append(links)
        out.append([doc, len(a), len(b), len(cuts), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    count = Counter(p for links in held for p in set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        ((*o[:5], sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), o[5]) for o, links in zip(out, held, strict=True)),
        key=str,
    )


def swept(a, b):
    links, j = [], 0
    for x, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links.append((x, b[k][0]))
            k += 1
    return links


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


TEXTS = st.lists(
    st.one_of(
        st.sampled_from(["<|endoftext|>", "</s>", "<0x41>", "▁", "  ", "\n\n", "\t", "naïve", "日本語", "²", "\x00", "é", " ́", "\xa0", "🙂"]),
        st.text(alphabet="aBé'sSt  \n01,.!ñß日²", max_size=12),
        st.text(max_size=4).filter(lambda t: not any("\ud800" <= c <= "\udfff" for c in t)),
    ),
    max_size=6,
).map("".join)


BOTH = A.BothTokenizers(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_tokens_are_the_libraries(text):
    """From the libraries, then remembered; added tokens' names are plain text."""
    assert BOTH.separable and BOTH.whole
    expected = [[k for k, _ in side] for side in tokens_of(text)]
    for _ in range(2):
        found = BOTH.encode([text])[0]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in found] == expected


ROWS = [
    (1, "Hello world, this is unbelievable tokenisation!"),
    (2, "Hello world, this is unbelievable tokenisation!"),
    (3, "<|endoftext|> and </s> are <0x41> text"),
    (4, "a▁b holds the blank's own sign"),
    (5, "naïve 日本語 text 🙂 with  double   blanks\n\nand\ttabs "),
    (6, " "),
    (7, "x"),
    (None, "of no document"),
    (7, "repeated id"),
    (8, "\x00\x01 control é"),
]


def test_equals_brute_force(spark, rows, docs):
    plain = [(r[0], r[1]) for r in rows]
    assert result(A.align_documents(docs)) == brute(plain)
    more = plain + ROWS
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in more], "doc_id long, text string, n int, pairs string").repartition(3)
    expected = brute(more)
    assert result(A.align_documents(frame)) == expected and any(r[1] > 10_000 for r in expected)


def test_counts_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_PAIRS", 3)
    monkeypatch.setattr(A, "FREQUENT", 12)
    rows = ROWS + [(100 + k, "the cat the dog" if k % 2 else "the the cat") for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(A.align_documents(frame)) == brute(rows)


def test_no_rows_and_rows_without_tokens(spark, none):
    assert A.align_documents(none).collect() == []
    rows = [(1, None), (2, ""), (3, "▁")]
    assert result(A.align_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]


def test_pairs_of_large_vocabularies(spark):
    tokens = A.tokenise_both(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"))
    a, b = tokens_of("some words here")
    got = A.align(tokens, 10**12).first()["pairs"]
    assert sorted((p // 10**12, p % 10**12) for p in got) == sorted((x, y) for x, s, e in spans(a) for y, s2, e2 in spans(b) if s < e2 and s2 < e)


def test_no_python_after_the_tokens(spark, docs):
    plan = A.align(A.tokenise_both(docs), 32000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Python" not in plan.replace("PythonUDF", "")


def test_the_query_on_the_drivers_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not pathlib.Path(folder).is_dir():
        pytest.skip("the driver's tables are not here")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert result(queries.queries()["op12_alignment"](spark, folder)) == brute(rows)


def test_segments_give_what_array_functions_give(spark, rows, monkeypatch):
    """Also where they are forgotten after every few rows, and where a vocabulary lets nothing be cut."""
    plain = [(r[0], r[1]) for r in rows] + ROWS + [(90 + k, t) for k, t in enumerate(["a \n b", "x\n y", "  lead", "trail \t ", "a\x1c b", "a\u3000 b\xa0c", "don't  'll", "日本 語  x"])]
    frame = spark.createDataFrame(plain, "doc_id long, text string").coalesce(2)
    byte_level, pieces = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
    wide = PIECES.get_piece_size()

    def held(found):
        columns = ("_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        return sorted(((*(r[c] for c in columns), sorted(r["pairs"])) for r in found.collect()), key=str)

    digest = A.F.when(A.F.col("n_a") > 0, A.F.sha2("groups", 256)).otherwise("")
    expected = held(A.align(A.tokenise_both(frame), wide).withColumn("groups_sha256", digest))
    assert held(A.align_texts(frame, byte_level, pieces, wide)) == expected
    texts = A.pa.array([t or "" for _, t in plain], A.pa.string())
    whole = [c.to_pylist() for c in A.AlignedSegments(BOTH, wide).align(texts)]
    monkeypatch.setattr(A, "CACHED", 3)
    short = A.AlignedSegments(BOTH, wide)
    parts = [[c.to_pylist() for c in short.align(texts.slice(k, 2))] for k in range(0, len(texts), 2)]
    assert [sum(cs, []) for cs in zip(*parts, strict=True)] == whole and not short.number
    monkeypatch.setattr(BOTH, "both_separable", False)
    uncut = [c.to_pylist() for c in A.AlignedSegments(BOTH, wide).align(texts)]
    assert uncut[:5] == whole[:5] and [sorted(p) for p in uncut[5]] == [sorted(p) for p in whole[5]]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.text(alphabet="a.'s1é日 \n\t\xa0\x1c", max_size=14)), min_size=1, max_size=5))
def test_groups_of_segments_are_those_of_the_libraries_tokens(texts):
    n_a, n_b, n_groups, n_links, digests, pairs = (c.to_pylist() for c in SEGMENTS.align(A.pa.array(texts, A.pa.string())))
    for k, (_, a, b, groups, links, *_, digest) in enumerate(brute([(0, t)])[0] for t in texts):
        assert (n_a[k], n_b[k], n_groups[k], n_links[k], digests[k]) == (a, b, groups, links, digest)
        sides = [spans(side) for side in tokens_of(texts[k])]
        assert sorted(divmod(p, 10**6) for p in pairs[k]) == sorted((x, y) for x, s, e in sides[0] for y, s2, e2 in sides[1] if s < e2 and s2 < e)


SEGMENTS = A.AlignedSegments(BOTH, 10**6)


def test_new_plain_segments_reach_the_byte_level_side_as_one_text(monkeypatch):
    alone, encode = [], BOTH.a.encode
    monkeypatch.setattr(BOTH.a, "encode", lambda texts: alone.extend(texts) or encode(texts))
    texts = [" ".join(f"zq{k}x{k % 7}" for k in range(n)) + tail for n, tail in ((300, ""), (1, " 日本 \n end"), (0, ""), (40, "  two \x1c"), (5, " <0x41> don't </s>"))]
    n_a, n_b, n_groups, n_links, digests, _ = (c.to_pylist() for c in A.AlignedSegments(BOTH, 10**6).align(A.pa.array(texts, A.pa.string())))
    assert len(alone) < 10 and " zq5x5" not in alone
    for k, (_, a, b, groups, links, *_, digest) in enumerate(brute([(0, t)])[0] for t in texts):
        assert (n_a[k], n_b[k], n_groups[k], n_links[k], digests[k]) == (a, b, groups, links, digest)
