import hashlib
import random
import re

import pytest

from scriptorium.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, named = set(), set()
        for item, t in items:
            b = words(t)
            n = min(width, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[k : k + n]:
                        hit |= set(range(i, i + n))
                        named.add(item)
        out.append((doc, len(w), len(hit), sorted(str(x) for x in named if x is not None)))
    return sorted(out, key=str)


ITEMS = [(10, "The quick Brown fox: jumps over the lazy dog's tail again today"), (9, "short é item"), (9, "short é item"), (3, None), (None, "nameless words here"), (2, "..."), (7, "quick brown fox jumps over the lazy dog s tail")]
DOCS = [
    (1, "so THE quick-brown fox jumps over the lazy dog s tail; again today and the quick brown fox jumps over the lazy dog s tail again"),
    (2, "a short É item, a short é item, short é"),
    (2, "a short É item, a short é item, short é"),
    (3, None),
    (4, ""),
    (None, "nameless words here"),
    (5, "nothing to see " * 500),
    (6, "short é item " * 300),
]


@pytest.mark.parametrize("block", [2_000_000, 3])
@pytest.mark.parametrize("width", [10, 3])
def test_as_brute_force(spark, width, block):
    docs = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, n_hit int, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.find_contamination(docs, items, width, block).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=str) == brute(DOCS, ITEMS, width)
    for r in got:
        assert sum(b - a for a, b in r["spans"]) == r["n_hit"]
    kept = D.remove_contaminated(docs, items, width, block)
    assert kept.columns == docs.columns
    clean = [d for d, _, n, _ in brute(DOCS, ITEMS, width) if n == 0]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(clean, key=str)
    assert D.find_contamination(docs.limit(0), items).count() == 0
    assert all(r["n_hit"] == 0 for r in D.find_contamination(docs, items.limit(0)).collect())


def test_digest():
    assert D.items_digest(["1", "10"]) == hashlib.sha256(b"1,10").hexdigest()


@pytest.mark.parametrize("seed", range(5))
def test_windows_of_a_small_vocabulary(seed, monkeypatch):
    """Repeated windows, items in several blocks, and hashes that collide."""
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    items = [(str(i), text(r.choice([0, 1, 2, 4, 9, 30]))) for i in range(8)]
    docs = [(i, text(r.choice([0, 3, 40]))) for i in range(12)]
    monkeypatch.setattr(D.WindowSet, "rolling", lambda self, ids, size: (ids[: max(0, len(ids) - size + 1)] % 2).astype("uint64"))
    one = D.WindowSet([(i, D.words_of(t)) for i, t in items], 4)
    got = []
    for doc, t in docs:
        hit, named = one.scan(D.words_of(t))
        got.append((doc, len(hit), int(hit.sum()), sorted(named)))
    assert sorted(got, key=str) == brute(docs, items, 4)


def test_many_blocks_and_buffers(spark, monkeypatch):
    monkeypatch.setattr(D, "BUFFER", 2000)
    monkeypatch.setattr(D, "HELD", 1)
    r = random.Random(9)
    text = lambda n: " ".join(r.choice(["red", "green", "blue", "cyan"]) for _ in range(n))
    items = [(i, text(r.choice([3, 12, 60]))) for i in range(15)]
    docs = [(i, text(r.choice([0, 5, 80]))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = D.find_contamination(frame, spark.createDataFrame(items, "item_id long, text string"), 6, 20).collect()
    assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], list(x["items"])) for x in got), key=str) == brute(docs, items, 6)
