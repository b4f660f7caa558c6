"""The few text functions that Spark's own cannot express, as Arrow-batched UDFs."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import compact_key, tokens


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two token arrays."""
    return pd.Series([difflib.SequenceMatcher(None, list(a), list(b)).ratio() for a, b in zip(left, right, strict=True)])


@F.pandas_udf(T.DoubleType())
def word_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two words."""
    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right, strict=True)])


def rewrite_category(parent: Column, gold: Column) -> Column:
    """empty, exact, near (.70), moderate (.45) or large rewrite."""
    ratio = sequence_ratio(tokens(parent), tokens(gold))
    return (
        F.when(F.length(compact_key(parent)) == 0, "empty")
        .when(compact_key(parent) == compact_key(gold), "exact")
        .when(ratio >= 0.70, "near")
        .when(ratio >= 0.45, "moderate")
        .otherwise("large")
    )


def same_family(left: Column, right: Column) -> Column:
    """Equal words, or ones of five letters that share six leading letters or are .72 alike."""
    long = F.least(F.length(left), F.length(right)) >= 5
    prefix = (F.length(left) >= 6) & (F.left(left, F.lit(6)) == F.left(right, F.lit(6)))
    return (left == right) | (long & (prefix | (word_ratio(left, right) >= 0.72)))


QUOTES = str.maketrans("‘’“”–—", "''\"\"--")


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_tokens(text: pd.Series) -> pd.Series:
    """Tokens after compatibility normalisation and plain quotes and dashes."""
    return pd.Series([re.findall(r"[a-z0-9]+", unicodedata.normalize("NFKC", t or "").translate(QUOTES).lower()) for t in text])


@F.pandas_udf(T.BooleanType())
def grounded(span: pd.Series, text: pd.Series, threshold: pd.Series) -> pd.Series:
    """Whether a token span occurs, or a window of nearly its width is similar enough."""

    def found(q: list[str], s: list[str], least: float) -> bool:
        n = len(q)
        if not n:
            return False
        if any(s[i : i + n] == q for i in range(len(s) - n + 1)):
            return True
        return any(
            difflib.SequenceMatcher(None, q, s[i : i + w]).ratio() >= least
            for w in range(max(1, n - 2), n + 3)
            for i in range(max(0, len(s) - w + 1))
        )

    return pd.Series([found(list(q), list(s), t) for q, s, t in zip(span, text, threshold, strict=True)])


TITLE_FIELDS = ("title", "output", "text", "data", "result", "response")


def title_list(payload: Column) -> Column:
    """Titles from a JSON array of strings, or from the usual fields of an object, as an array."""
    as_array = F.from_json(payload, "array<string>")
    fields = [F.from_json(F.get_json_object(payload, f"$.{k}"), "array<string>") for k in ("candidates", "titles", "outputs")]
    single = [F.get_json_object(payload, f"$.{k}") for k in TITLE_FIELDS]
    one = F.array_compact(F.array(F.coalesce(*single)))
    return F.coalesce(*fields, F.when(F.startswith(F.trim(payload), F.lit("[")), as_array), one)
