"""Text-overlap metrics as Column expressions over token arrays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_measure(overlap: Column, predicted: Column, reference: Column) -> Column:
    """2pr/(p+r), 0 when nothing overlaps."""
    return F.when(overlap == 0, F.lit(0.0)).otherwise(
        F.lit(2.0) * overlap / (F.size(predicted) + F.size(reference)).cast("double")
    )


def unigram_overlap(a: Column, b: Column) -> Column:
    """Clipped number of common tokens."""
    def least(t: Column) -> Column:
        return F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t)))

    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, t: s + least(t))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two token arrays, over Arrow batches: Spark's functions would copy a table row for each cell.

    A bit vector as wide as ``b`` takes one step for each token of ``a``.
    """

    def lengths(left: pd.Series, right: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(left, right, strict=True):
            places: dict[str, int] = {}
            for j, t in enumerate(y):
                places[t] = places.get(t, 0) | 1 << j
            whole = row = (1 << len(y)) - 1
            for t in x:
                met = row & places.get(t, 0)
                row = (row + met | row - met) & whole
            found.append(len(y) - row.bit_count())
        return pd.Series(found, dtype="int64")

    none = F.array().cast("array<string>")
    return F.pandas_udf(lengths, "long")(F.coalesce(a, none), F.coalesce(b, none))


def rouge_1(prediction: Column, reference: Column) -> Column:
    return f_measure(unigram_overlap(prediction, reference), prediction, reference)


def rouge_l(prediction: Column, reference: Column) -> Column:
    return f_measure(lcs_length(prediction, reference), prediction, reference)


def ngrams(array: Column, n: int) -> Column:
    return F.when(F.size(array) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(array) - (n - 1)), lambda i: F.array_join(F.slice(array, i, n), " "))
    )


def tokens_13a(text: Column) -> Column:
    """Tokens of the mteval-v13a scheme: punctuation apart, but periods, commas and hyphens within numbers."""
    t = F.coalesce(text, F.lit(""))
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, new in (
        (r"([{-~\[-` -&(-+:-@/])", " $1 "),
        (r"([^0-9])([.,])", "$1 $2 "),
        (r"([.,])([^0-9])", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ):
        t = F.regexp_replace(t, pattern, new)
    return F.filter(F.split(t, r"[ \t\r\x0b\x0c]+"), lambda x: x != "")


def corpus_bleu(rows: DataFrame, order: int = 4) -> DataFrame:
    """Corpus BLEU of ``rows(id, prediction, reference)``: hits, totals and precisions by n, brevity penalty, lengths and score.

    Precisions are percentages; one without hits counts as 100 / (2^k total),
    where k numbers such orders so far; the score is 0 where no order has hits.
    """
    texts = rows.select("id", tokens_13a(F.trim("prediction")).alias("p"), tokens_13a(F.trim("reference")).alias("t"))
    none = F.array().cast("array<struct<n:int,g:string>>")

    def grams(x: str) -> Column:
        def named(n: int) -> Column:
            return F.transform(ngrams(F.col(x), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))

        return F.explode(F.coalesce(F.concat(*map(named, range(1, order + 1))), none)).alias("k")

    ours = texts.select("id", grams("p")).groupBy("id", "k").agg(F.count("*").alias("c"))
    theirs = texts.select("id", grams("t")).groupBy("id", "k").agg(F.count("*").alias("r"))
    hits = ours.join(theirs, ["id", "k"]).agg(
        *(F.coalesce(F.sum(F.when(F.col("k.n") == n, F.least("c", "r"))), F.lit(0)).cast("long").alias(f"hit_{n}") for n in range(1, order + 1))
    )
    sizes = texts.agg(
        *(F.coalesce(F.sum(F.greatest(F.size("p") - (n - 1), F.lit(0))), F.lit(0)).cast("long").alias(f"all_{n}") for n in range(1, order + 1)),
        F.coalesce(F.sum(F.size("p")), F.lit(0)).cast("long").alias("sys_len"),
        F.coalesce(F.sum(F.size("t")), F.lit(0)).cast("long").alias("ref_len"),
    )
    both = hits.crossJoin(sizes)  # one row each
    empty = [F.when((F.col(f"hit_{n}") == 0) & (F.col(f"all_{n}") > 0), 1).otherwise(0) for n in range(1, order + 1)]
    precision = []
    for n in range(1, order + 1):
        top = F.when(F.col(f"hit_{n}") > 0, F.col(f"hit_{n}").cast("double")).otherwise(1 / F.pow(F.lit(2.0), sum(empty[:n], F.lit(0))))
        precision.append(F.when(F.col(f"all_{n}") > 0, 100 * top / F.col(f"all_{n}")).otherwise(0.0))
    brevity = (
        F.when(F.col("sys_len") == 0, 0.0).when(F.col("sys_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.col("ref_len") / F.greatest("sys_len", F.lit(1))))
    )
    least = F.least(*precision)
    mean = F.exp(sum((F.log(F.greatest(p, F.lit(1e-300))) for p in precision), F.lit(0.0)) / order)
    score = F.when((sum((F.col(f"hit_{n}") for n in range(1, order + 1)), F.lit(0)) == 0) | (least == 0), 0.0).otherwise(brevity * mean)
    return both.select(
        *(f"hit_{n}" for n in range(1, order + 1)),
        *(f"all_{n}" for n in range(1, order + 1)),
        *(F.round(p, 6).alias(f"precision_{n}") for n, p in enumerate(precision, 1)),
        F.round(brevity, 6).alias("brevity"),
        "sys_len",
        "ref_len",
        F.round(score, 6).alias("score"),
    )
