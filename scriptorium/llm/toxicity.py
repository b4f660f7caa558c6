"""Toxicity by maximum-scoring segments with extreme-value calibration.

Log-odds of a token's occurrence in toxic and in clean training texts, with a
Dirichlet prior, give its score. A token is read as its whole word and as its
beginnings of 3 to 8 letters, so that families of inflected words are told by
their stem; the most specific reading that is either significant or well known
to be harmless counts. All other tokens score slightly below 0. One linear scan finds
every maximal-scoring segment; the scores of the best segments, by the law of
extremes fitted on clean texts, become a significance, and a logistic curve
fitted on the training texts turns that into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, discard, materialize, ship_package, tidy

WORD = re.compile(r"[^\W\d_]+")
PARTS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Bounds of the fit: labelled rows used (those with the lowest hash of their id), and telling tokens kept.
MAX_ROWS, MAX_TOKENS = 200_000, 50_000


def tokens_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Segment:
    """Tokens [start, end) with their total score."""

    start: int
    end: int
    score: float


def maximal_segments(scores: list[tuple[int, float]], drift: float) -> list[Segment]:
    """All maximal-scoring segments of a sequence, left to right, in linear time.

    ``scores`` has place and score of the positive tokens; every other token
    scores ``drift`` (below 0). For each candidate the sums before its left end
    and up to its right end are kept, and a new candidate is joined to the last
    one that starts lower for as long as that one ends lower. Each candidate
    links to the last one before it that starts lower, so a search goes from
    link to link, and what it passes is not passed again.
    """
    kept: list[tuple[float, float, int, int, int]] = []  # sum before, sum at end, start, end, link
    total, at = 0.0, 0
    for place, score in scores:
        total += drift * (place - at)
        low, high, start = total, total + score, place
        total, at = high, place + 1
        k = len(kept) - 1
        while True:
            while k >= 0 and kept[k][0] >= low:
                k = kept[k][4]
            if k < 0 or kept[k][1] >= high:
                break
            low, start, link = kept[k][0], kept[k][2], kept[k][4]
            del kept[k:]
            k = link
        kept.append((low, high, start, at, k))
    return [Segment(start, end, high - low) for low, high, start, end, _ in kept]


STEMS = range(3, 9)
#: Clean texts that show a reading to be harmless although a shorter beginning is telling.
HARMLESS = 15


def features_of(word: str) -> list[str]:
    """The whole word, marked by its end, and its beginnings, the longest first."""
    return [word + "$", *(word[:k] for k in reversed(STEMS) if k <= len(word))]


@dataclass
class ToxicityModel:
    """Log-odds of telling features (0 for harmless ones), the drift of other tokens, the law of extremes and the curve."""

    odds: dict[str, float]
    drift: float
    rate: float  # decay of the segment scores' tail
    room: float  # log of the search-space factor K
    curve: tuple[float, ...]

    def __post_init__(self) -> None:
        self.heads = {f[:3] for f in self.odds if not f.endswith("$")} | {f[:-1][:3] for f in self.odds if f.endswith("$")}
        self.known: dict[str, float] = {}

    def score(self, word: str) -> float:
        """Score of a word, 0 if nothing about it is telling."""
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = next((self.odds[f] for f in features_of(word) if f in self.odds), 0.0)
        return self.known[word]

    def segments(self, text: str | None) -> tuple[int, int, list[Segment]]:
        """Number of tokens, of different telling words, and the maximal segments."""
        tokens = tokens_of(text)
        heads = self.heads
        near = [(i, w) for i, w in enumerate(tokens) if w[:3] in heads]
        found = [(i, s, w) for i, w in near if (s := self.score(w)) > 0]
        return len(tokens), len({w for _, _, w in found}), maximal_segments([x[:2] for x in found], self.drift)

    def evidence(self, length: int, words: int, scores: Sequence[float]) -> tuple[float, ...]:
        """Features: -log10 of the least E-value over sums of the r best segments for every r, best score, segments, words, length."""
        if not len(scores):
            return 0.0, 0.0, 0.0, 0.0, math.log1p(length)
        space = self.room + math.log(length + 1)
        best = np.sort(np.asarray(scores, dtype=float))[::-1]
        ways = np.cumsum(np.log(np.arange(1, len(best) + 1)))  # log of r!
        top = float((np.cumsum(self.rate * best - space) + ways).max())
        return top / math.log(10), float(best[0]), float(len(best)), float(words), math.log1p(length)

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = shape(features) @ np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def shape(features: np.ndarray) -> np.ndarray:
    e, s, n, w, length = features.reshape(-1, 5).T
    e = np.clip(e, -6, 20)
    some = (s > 0).astype(float)
    return np.column_stack(
        [np.ones(len(e)), e, np.clip(e, 0, None), s, np.log1p(n), np.log1p(w), some, some * length]
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Text and label of the labelled documents outside the held-out part, at most ``max_rows`` labels.

    Labels of one id that disagree are left out, as are null ids and labels.
    Near copies would make the chance words of one text look telling, so of
    the texts of one label that share the least hashes of their three-word
    shingles, by two hash functions, only one is used.
    """
    wanted = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
        .filter(F.col("_id").isNotNull() & F.col("_toxic").isNotNull() & (crc_of_id("_id") % PARTS != HELD_OUT))
        .groupBy("_id")
        .agg(F.min("_toxic").alias("_toxic"), F.max("_toxic").alias("_other"))
        .filter(F.col("_toxic") == F.col("_other"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
        .select("_id", "_toxic")
    )
    labelled = docs.select("doc_id", "text").join(F.broadcast(wanted), F.col("doc_id") == F.col("_id"))
    shingle = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    hashed = labelled.select("_id", "_toxic", F.split("text", r"\s+").alias("_words")).select("_id", "_toxic", shingle.alias("_hashes"))
    other = F.transform("_hashes", lambda h: F.xxhash64(h))
    signed = hashed.select("_id", "_toxic", F.struct(F.array_min("_hashes").alias("a"), F.array_min(other).alias("b")).alias("_sign"))
    firsts = materialize(signed.groupBy("_sign", "_toxic").agg(F.min("_id").alias("_id")).select("_id", "_toxic"), "labels")
    return docs.select("doc_id", "text").join(F.broadcast(firsts), F.col("doc_id") == F.col("_id")).select("text", "_toxic")


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    prior: float = 2.0,
    least_z: float = 5.0,
    least_odds: float = 1.5,
    drift: float = -0.2,
    max_rows: int = MAX_ROWS,
    max_tokens: int = MAX_TOKENS,
) -> ToxicityModel:
    """Fit the model; without toxic or without clean training texts it gives every text the labels' plain rate.

    Learns from at most ``max_rows`` labels; keeps at most ``max_tokens``
    features, the most significant first.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = training_rows(docs, labels, max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        texts = [0, 0]

        def flush() -> pa.RecordBatch:
            found = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array([*found, ""], pa.string())]
            for k in (0, 1):
                columns.append(pa.array([*map(seen[k].__getitem__, found), texts[k]], pa.int64()))
                seen[k].clear()
                texts[k] = 0
            return pa.RecordBatch.from_arrays(columns, ["feature", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = int(toxic > 0)
                words = set(tokens_of(text))
                seen[k].update({w + "$" for w in words})
                for size in STEMS:
                    seen[k].update({w[:size] for w in words if len(w) >= size})
                texts[k] += 1
                if len(seen[0]) + len(seen[1]) > 600_000:
                    yield flush()
        yield flush()
        tidy()

    counts = (
        rows.mapInArrow(count, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        # at the least_z wanted, nothing seen in fewer toxic texts can be significant
        .filter((F.col("feature") == "") | (F.col("toxic") >= 3) | (F.col("clean") >= HARMLESS))
    )
    counts = materialize(counts, "features")
    whole = counts.filter(F.col("feature") == "").collect()
    m_clean, m_toxic = (whole[0]["clean"], whole[0]["toxic"]) if whole else (0, 0)
    flat = (math.log((m_toxic + 0.5) / (m_clean + 0.5)), *[0.0] * 7)
    model = ToxicityModel({}, drift, 1.0, -7.0, flat)
    if not m_clean or not m_toxic:
        return model
    share = F.lit(0.5) + F.lit(prior) * (F.col("clean") + F.col("toxic")) / F.lit(float(m_clean + m_toxic))

    def odds(y: Column, total: int) -> Column:
        return F.log((y + share) / (F.lit(float(total + prior + 1)) - y - share))

    delta = odds(F.col("toxic"), m_toxic) - odds(F.col("clean"), m_clean)
    error = F.sqrt(1 / (F.col("toxic") + share) + 1 / (F.col("clean") + share))
    scored = counts.filter(F.col("feature") != "").select(
        "feature", "clean", "toxic", delta.alias("delta"), (delta / error).alias("z")
    )
    significant = (F.col("z") >= least_z) & (F.col("delta") >= least_odds)
    telling = scored.filter(significant).orderBy(F.desc("z"), "feature").limit(max_tokens).collect()
    stems = [(r["feature"],) for r in telling if not r["feature"].endswith("$")]  # at most max_tokens
    known = F.broadcast(spark.createDataFrame(stems, "stem string"))
    clean = scored.filter(~significant & (F.col("clean") >= HARMLESS) & (F.col("delta") < least_odds))
    beginnings = F.array_distinct(F.transform(F.array(*map(F.lit, STEMS)), lambda k: F.substring("feature", F.lit(1), k)))
    within = clean.withColumn("stem", F.explode(beginnings)).join(known, "stem", "left_semi").select("feature", "clean").distinct()
    harmless = within.orderBy(F.desc("clean"), "feature").limit(max_tokens).collect()
    discard(counts)
    if not telling:
        return model
    odds_of = {r["feature"]: 0.0 for r in harmless} | {r["feature"]: r["delta"] for r in telling}
    model = ToxicityModel(odds_of, drift, 1.0, -7.0, flat)
    shared = spark.sparkContext.broadcast(model)

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.segments(t) for t in batch.column(0).to_pylist()]
            columns = [
                batch.column(1),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([w for _, w, _ in found], pa.int64()),
                pa.array([[s.score for s in x] for _, _, x in found], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "length", "words", "scores"])

    seen = materialize(rows.mapInArrow(extremes, "toxic int, length long, words long, scores array<double>"), "segments")
    # what reaches the driver is a few numbers for each of at most max_rows labels
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    tops = seen.filter("toxic = 0").select(best.alias("best"), "length").toPandas()
    model.rate, model.room = fit_extremes(tops["best"].to_numpy(), tops["length"].to_numpy())
    fitted = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, words, scores = (batch.column(k).to_pylist() for k in (1, 2, 3))
            found = np.array([fitted.value.evidence(*x) for x in zip(lengths, words, scores, strict=True)]).reshape(-1, 5)
            columns = [batch.column(0), *(pa.array(found[:, k]) for k in range(5))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", *"abcde"])

    weighed = seen.mapInArrow(weigh, "toxic int, a double, b double, c double, d double, e double").toPandas()
    discard(seen)
    y = (weighed["toxic"].to_numpy() > 0).astype(float)
    model.curve = tuple(fit_logistic(shape(weighed[list("abcde")].to_numpy()), y).tolist())
    model.known = {}
    return model


def fit_extremes(best: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Decay and log K of P(best >= x) = 1 - exp(-K n exp(-decay x)): matches the mean excess and the count of those above the median positive score."""
    positive = best[best > 0]
    if len(positive) < 20:
        return 1.0, -7.0
    edge = float(np.median(positive))
    over = positive[positive >= edge] - edge
    rate = float(np.clip(1 / max(over.mean(), 1e-3), 0.2, 2.0))
    share = (best >= edge).sum() / max(lengths.sum(), 1)
    return rate, math.log(max(share, 1e-12)) + rate * edge


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with ``doc_id``, score, predicted and the significant passages as token ranges.

    A null or empty text has no passage and the score that stands for none;
    a very long text is scored whole in one task, in time that grows with its
    length; repeated rows are scored row by row; an empty table gives an empty
    result.
    Only doc_id and text are read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            features, passages = [], []
            for text in batch.column(1).to_pylist():
                n, words, found = m.segments(text)
                features.append(m.evidence(n, words, [s.score for s in found]))
                # an E-value below 0.05 makes a passage significant by itself
                edge = (m.room + math.log(n + 1) - math.log(0.05)) / m.rate
                passages.append([[s.start, s.end] for s in found if s.score >= edge])
            p = m.probability(np.array(features))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(p, pa.float64()),
                    pa.array((p >= threshold).astype(np.int32), pa.int32()),
                    pa.array(passages, pa.list_(pa.list_(pa.int32()))),
                ],
                ["doc_id", "score", "predicted", "passages"],
            )
        m.known = {}
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, score double, predicted int, passages array<array<int>>"
    )


def remove_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, whatever their names.

    A null or empty text has no passage and stays wherever that scores below
    the threshold, as it does unless most labels are toxic; a very long text is
    scored whole in one task; repeated rows are judged row by row; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.segments(t) for t in batch.column(at).to_pylist()]
            features = [m.evidence(n, w, [s.score for s in x]) for n, w, x in found]
            p = m.probability(np.array(features))
            yield batch.filter(pa.array(p < threshold))
        m.known = {}
        tidy()

    return docs.mapInArrow(keep, docs.schema)
