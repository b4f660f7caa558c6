"""run() against a restatement of its stages in plain Python, on a small folder of tables.

Base rules, links, benchmark windows, tokens and packing are restated from
their contracts; the verdicts of the two learned models, the outlier distance
and the toxicity score, are planted so that any sound model gives them.
"""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from scriptorium.llm.tokens import public_path

from .test_decontam import words
from .test_jaccard_join import brute as linked
from .test_quality import brute as base_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, group int, kept string, node long, _row string"
LABELS, BENCHMARK = "doc_id long, quality int, toxic int", "item_id long, text string"


def make():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8)))
    leak = " ".join(word() for _ in range(14))
    texts = [" ".join(word() for _ in range(r.randint(40, 120))) for _ in range(400)]
    for i in range(0, 300, 6):  # toxic
        texts[i] += " scoundrel villain rascal" * 2
    for i in range(301, 312):  # far from all others
        texts[i] = " | ".join(w.upper() + "!!" for w in texts[i].split())
    texts[11] = texts[10]
    texts[12] = None
    texts[13] = "too few"
    texts[14] += " " + leak.upper()
    texts[15] = "the same five words again " * 8
    texts[17] = " ".join(["changed", *texts[16].split()[1:]]) + " " + word()
    texts[16] = texts[17].replace("changed", "other", 1)
    long = " ".join(word() for _ in range(1200))
    rows = [(i, t, "en", "s", 1, 2, "x", 5, None) for i, t in enumerate(texts)]
    rows += [(None, texts[20], None, None, None, None, None, None, None), (20, texts[20], "en", "s", 1, 2, "x", 5, None)]
    rows += [(21, texts[22] + " and more words here", "en", "s", None, None, None, None, ""), (500, long, "en", "s", 1, 2, "x", 5, None)]
    labels = [(i, 1, int(i % 6 == 0 and i < 300)) for i in range(400)]
    return rows, labels, [(1, leak), (2, None), (3, "")]


def restated(rows, items):
    """The documents that stay, by position, after the first four stages."""
    kept = [k for k, (i, t, *_) in enumerate(rows) if not base_rules(t)[-1]]
    kept = [k for k in kept if "!!" not in rows[k][1] and "villain" not in rows[k][1]]
    groups: dict = {}
    flat = [(p, rows[k][1]) for p, k in enumerate(kept)]
    for p, (_, _, component) in zip(range(len(flat)), sorted(linked(flat), key=lambda x: x[0]), strict=True):
        groups.setdefault(component, []).append(kept[p])
    first = [min(g, key=lambda k: (rows[k][0] is None, rows[k][0] or 0)) for g in groups.values()]
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [words(t)] for k in range(len(w) - 9)}
    return sorted(k for k in first if not any(tuple(w[j : j + 10]) in windows for w in [words(rows[k][1])] for j in range(len(w) - 9)))


def save(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, BENCHMARK).write.parquet(f"{folder}/benchmark.parquet")


def test_run(spark, tmp_path):
    folder = str(tmp_path)
    rows, labels, items = make()
    save(spark, folder, rows, labels, items)
    stay = restated(rows, items)
    assert {rows[k][0] for k in stay} & {0, 11, 12, 13, 14, 15, 17, 303, None} == set() and {10, 16, 20, 500} <= {rows[k][0] for k in stay}
    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    want = []
    for k in stay:
        ids = np.array([*library.encode(rows[k][1], add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, begin in enumerate(range(0, len(ids), 4096)):
            part = ids[begin : begin + 4096]
            want.append((rows[k][0], piece, begin, len(part), zlib.crc32(part.tobytes())))
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(r[:5] for r in got) == sorted(want)
    places: dict = {}
    for *_, length, _, sequence, offset in got:
        places.setdefault(sequence, []).append((offset, length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(x[3] for x in want)
    assert len(places) <= -(-total // 4096) + 1


def test_stages_keep_the_columns_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    save(spark, folder, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.createDataFrame(make()[0][:40], SCHEMA)
    assert [name for name, _ in corpus_pipeline.STAGES][:3] == ["quality rules", "toxicity", "n-gram Jaccard join"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
