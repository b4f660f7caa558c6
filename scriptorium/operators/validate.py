"""Row validators: each gives an array of error names, empty for a valid row; strict mode fails the query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import FORBIDDEN_TERMS, compact_key, tokens


def errors(**tests: Column) -> Column:
    """Names of the tests that hold, in order; a null test does not hold."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))


def strict(rows: DataFrame, found: Column) -> DataFrame:
    """The rows, failing at the first that has an error."""
    return rows.filter(F.assert_true(F.size(found) == 0, F.concat(F.lit("invalid row: "), F.array_join(found, ","))).isNull())


def output_errors(output: Column) -> dict[str, Column]:
    o = F.coalesce(output, F.lit(""))
    return {
        "empty": F.length(F.trim(o)) == 0,
        "placeholder": F.lower(F.trim(o)).isin("none", "null", "n/a"),
        "lines": F.contains(F.trim(o), F.lit("\n")),
        "long": F.length(o) > 300,
    }


def unknown_evidence(cited: Column, visible: Column) -> Column:
    return F.size(F.array_except(cited, visible)) > 0


def mutation_errors(operation: Column, output: Column, cited: Column, visible: Column) -> Column:
    """Operation, output and evidence of a mutation payload."""
    return errors(operation=operation != "mutation", **output_errors(output), evidence=unknown_evidence(cited, visible))


def crossover_errors(operation: Column, output: Column, parents: Column, expected: Column, cited: Column, visible: Column) -> Column:
    return errors(
        operation=operation != "crossover", **output_errors(output), parents=F.array_sort(parents) != F.array_sort(expected), evidence=unknown_evidence(cited, visible)
    )


def trace_errors(reason: Column, action: Column, cited: Column, visible: Column, gold: Column) -> Column:
    """A trace cites one or two visible items, has bounded texts without forbidden terms, and does not give the target away."""
    both = F.concat_ws(" ", reason, action)
    key = compact_key(gold)
    return errors(
        reason=~F.length(F.trim(reason)).between(1, 500),
        action=~F.length(F.trim(action)).between(1, 500),
        count=~F.size(cited).between(1, 2),
        evidence=unknown_evidence(cited, visible),
        forbidden=both.rlike(FORBIDDEN_TERMS),
        leak=(F.length(key) > 0) & F.contains(compact_key(both), key),
    )


def operation_errors(span: Column, parent: Column, gold: Column, cited: Column, visible: Column, personalized: Column) -> Column:
    """An atomic operation edits a part, not a whole title, and not most of one; a personalised one cites two items."""
    words, whole = tokens(span), tokens(gold)
    covered = F.size(F.array_intersect(words, whole)) / F.greatest(F.size(F.array_distinct(whole)), F.lit(1))
    return errors(
        empty=F.size(words) == 0,
        whole=(compact_key(span) == compact_key(parent)) | (compact_key(span) == compact_key(gold)),
        most=(F.size(words) >= 8) & (covered >= 0.75),
        evidence=unknown_evidence(cited, visible),
        support=personalized & (F.size(F.array_distinct(cited)) < 2),
    )


def judge_errors(verdict: Column, confidence: Column, least: float = 0.65) -> Column:
    return errors(
        verdict=~F.coalesce(verdict, F.lit("")).isin("prefer_a", "prefer_b", "tie"),
        confidence=~F.coalesce(confidence, F.lit(-1.0)).between(0, 1),
        unsure=(verdict != "tie") & (confidence < least),
    )


def ranking_errors(ranked: Column, candidates: Column) -> Column:
    """A ranking is a permutation of the candidates."""
    return errors(
        repeated=F.size(F.array_distinct(ranked)) < F.size(ranked),
        unknown=F.size(F.array_except(ranked, candidates)) > 0,
        missing=F.size(F.array_except(candidates, ranked)) > 0,
    )


def complete_ranking(ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Valid ranked ids in their first order, then the missing ones as given; scores n down to 1.

    ``ranked(id, place, candidate_id)``, ``candidates(id, pos, candidate_id)``.
    """
    first = ranked.groupBy("id", "candidate_id").agg(F.min("place").alias("place"))
    joined = candidates.join(first, ["id", "candidate_id"], "left")
    order = W.partitionBy("id").orderBy(F.col("place").asc_nulls_last(), "pos")
    n = F.count("*").over(W.partitionBy("id"))
    return joined.withColumn("rank", F.row_number().over(order)).withColumn("ranker_score", (n - F.col("rank") + 1).cast("double")).drop("place")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys only one side has: both 0 where the sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = a.join(b, key, "left_anti").agg(F.count("*").alias("only_left"))
    return only.crossJoin(b.join(a, key, "left_anti").agg(F.count("*").alias("only_right")))
