"""Language identification as multilingual mixture inference.

Each training language gets a character trigram model. A document is a mixture
of languages: expectation-maximisation over its words finds the proportions,
and the language set is chosen by penalised likelihood, growing it in the
order of the proportions for as long as another language pays for itself, up
to all learned ones.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import crc_of_id, discard, materialize, ship_package


def _numbers_in_words() -> str:
    """The numbers that regular expressions take for word characters beside digits, such as fractions, as ranges of a class."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl")]
    ranges: list[list[int]] = []
    for c in found:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


#: Runs of letters (Unicode's letter categories).
WORD = re.compile(rf"[^\W\d_{_numbers_in_words()}]+")
PARTS, HELD_OUT = 5, 0
#: Bounds of the fit: training rows (by the hash of their id), trigrams kept for each language, and for all together
#: (many languages keep fewer each). No language is left out.
MAX_ROWS, MAX_GRAMS, ALL_GRAMS = 60_000, 50_000, 5_000_000
SALTS = 16
ROUNDS = 8


def trigrams(word: str) -> list[str]:
    padded = f"\x02{word}\x03"
    return [padded[k : k + 3] for k in range(len(padded) - 2)]


@dataclass
class LanguageModel:
    """Log-probabilities of trigrams by language, as differences from those of an unseen trigram, for the languages that have one.

    ``grams`` gives a trigram's number g; its languages and differences lie at
    ``ends[g]`` to ``ends[g + 1]`` of ``where`` and ``gain``.
    """

    languages: list[str]
    grams: dict[str, int]
    ends: np.ndarray
    where: np.ndarray
    gain: np.ndarray
    unseen: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Likelihoods of words by language, each scaled to 1 for its best one."""
        parts = [trigrams(w) for w in words]
        sizes = np.array([len(p) for p in parts])
        get = self.grams.get
        found = np.array([get(g, -1) for p in parts for g in p], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)[found >= 0]
        found = found[found >= 0]
        each = self.ends[found + 1] - self.ends[found]
        begin = np.repeat(self.ends[found] - np.cumsum(each) + each, each)
        at = begin + np.arange(len(begin))
        n = len(self.languages)
        cell = np.repeat(owner, each) * n + self.where[at]
        score = np.bincount(cell, self.gain[at], minlength=len(words) * n).reshape(len(words), n)
        score += sizes[:, None] * self.unseen
        return np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -30))

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Row numbers of words in the table of likelihoods."""
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            if self.table is None or (len(known) + len(fresh)) * len(self.languages) > 1_200_000:
                known.clear()
                self.table = np.empty((0, len(self.languages)))
                fresh = list(dict.fromkeys(words))
            start = len(known)
            known.update(zip(fresh, range(start, start + len(fresh)), strict=True))
            self.table = np.concatenate((self.table, self.likelihoods(fresh)))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def infer(self, texts: list[str | None], penalty: float = 2.0) -> list[tuple[str, float, dict[str, float]]]:
        """For each text its main language, that language's share, and the shares of the chosen set."""
        words: list[str] = []
        counts: list[int] = []
        docs: list[int] = []
        for i, text in enumerate(texts):
            found = Counter(WORD.findall(text.lower())) if text else ()
            if found:
                words += found.keys()
                counts += found.values()
                docs += [i] * len(found)
        out: list[tuple[str, float, dict[str, float]]] = [("und", 0.0, {})] * len(texts)
        if not words or not self.languages:
            return out
        row = self.rows_of(words)
        like = self.table[row]
        n = np.array(counts, dtype=float)
        ids, first = np.unique(np.array(docs), return_index=True)
        doc = np.repeat(np.arange(len(ids)), np.diff(np.append(first, len(docs))))
        total = np.add.reduceat(n, first)
        k = len(self.languages)

        def em(some: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            """Proportions and log-likelihood of the documents ``some``, with the languages ``allowed`` to each."""
            mine = np.isin(doc, some)
            x, c, owner = like[mine], n[mine], np.searchsorted(some, doc[mine])
            begin = np.searchsorted(owner, np.arange(len(some)))
            share = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(rounds):
                joint = x * share[owner]
                joint *= (c / joint.sum(axis=1))[:, None]
                share = np.add.reduceat(joint, begin, axis=0) / total[some][:, None]
                share = np.where(allowed > 0, np.maximum(share, 1e-9), 0.0)
                share /= share.sum(axis=1, keepdims=True)
            return share, np.add.reduceat(c * np.log((x * share[owner]).sum(axis=1)), begin)

        every = np.arange(len(ids))
        share, _ = em(every, np.ones((len(ids), k)), ROUNDS)
        order = np.argsort(-share, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        best, fit = em(every, (rank < 1).astype(float), 0)
        worth = fit - penalty * np.log(total + 1)
        growing, size = every, 2
        while len(growing) and size <= k:  # those for which the last language paid
            chosen, fit = em(growing, (rank[growing] < size).astype(float), ROUNDS // 2)
            value = fit - penalty * size * np.log(total[growing] + 1)
            better = value > worth[growing]
            growing, chosen, value = growing[better], chosen[better], value[better]
            best[growing], worth[growing] = chosen, value
            size += 1
        main = best.argmax(axis=1)
        for j, i in enumerate(ids):
            shares = {self.languages[x]: float(best[j, x]) for x in np.flatnonzero(best[j] > 1e-6)}
            out[i] = (self.languages[main[j]], float(min(1.0, best[j, main[j]])), shares)
        return out


def training_rows(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Text and language of the documents outside the held-out part, about ``max_rows`` of them by the hash of their id."""
    fit = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_of_id() % PARTS != HELD_OUT)
    )
    n = docs.select("lang").filter(F.col("lang").isNotNull()).count()
    if n > max_rows:
        fit = fit.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    return fit.select("text", "lang")


def learn_languages(
    docs: DataFrame, max_rows: int = MAX_ROWS, max_grams: int = MAX_GRAMS, all_grams: int = ALL_GRAMS
) -> LanguageModel:
    """Count the trigrams of words by language; with no labelled text the model knows no language.

    Learns from about ``max_rows`` rows and keeps the ``max_grams`` most frequent
    trigrams of each language, fewer where all would be more than ``all_grams``.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        langs, grams, counts = [], [], []
        for lang, found in words.items():
            seen: Counter = Counter()
            for word, n in found.items():
                for g in trigrams(word):
                    seen[g] += n
            langs += [lang] * len(seen)
            grams += seen.keys()
            counts += seen.values()
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["lang", "gram", "n"]
        )

    counted = training_rows(docs, max_rows).mapInArrow(count, "lang string, gram string, n long")
    summed = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sizes = summed.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row for each language
    languages = sorted(r["lang"] for r in sizes)
    most = min(max_grams, max(1, all_grams // max(1, len(languages))))
    # the most frequent trigrams of each language: first those of each part of its trigrams, so that no task sorts all
    part = F.pmod(F.xxhash64("gram"), F.lit(SALTS))
    first = F.row_number().over(W.partitionBy("lang", part).orderBy(F.desc("n"), "gram"))
    top = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    few = summed.withColumn("at", first).filter(F.col("at") <= most).withColumn("at", top).filter(F.col("at") <= most)
    rows = few.select("lang", "gram", "n").toPandas()  # at most all_grams, or one for each language
    discard(summed)
    place = {x: i for i, x in enumerate(languages)}
    grams = {g: i for i, g in enumerate(rows["gram"].unique())}
    gram, where = rows["gram"].map(grams).to_numpy(dtype=np.int64), rows["lang"].map(place).to_numpy(dtype=np.int64)
    order = np.lexsort((where, gram))
    gram, where, seen = gram[order], where[order], rows["n"].to_numpy(dtype=float)[order]
    mass = 0.2 * (len(grams) + 1) + np.bincount(where, seen, minlength=len(languages))
    ends = np.searchsorted(gram, np.arange(len(grams) + 1))
    return LanguageModel(languages, grams, ends, where, np.log((seen + 0.2) / 0.2), np.log(0.2 / mass))


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` with doc_id, lang_pred, score (the share of that language) and all shares.

    ``und`` with score 0 where the text is null, has no letter, or nothing was
    learned. Equal shares go to the language that sorts first. A very long text
    is read whole, as its different words with their counts. Repeated rows are
    judged row by row; an empty table gives an empty result; only doc_id and
    text are read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, float, dict[str, float]]] = []
            texts = batch.column(1).to_pylist()
            for begin in range(0, len(texts), 500):
                found += shared.value.infer(texts[begin : begin + 500])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                    pa.array([list(x[2].items()) for x in found], pa.map_(pa.string(), pa.float64())),
                ],
                ["doc_id", "lang_pred", "score", "shares"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        judge, f"doc_id {kind}, lang_pred string, score double, shares map<string,double>"
    )
