"""Text scalars as Column expressions: tokens, keys, cleaning, similarity, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the title tokens, placeholder abstracts, patterns of echoed prompts and leaks.
TITLE_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in",
    "is", "of", "on", "or", "the", "to", "using", "via", "we", "with",
)
MISSING_ABSTRACTS = ("", "without abstract", "no abstract available", "no abstract available.")
INSTRUCTION_PREFIX = (
    r"(?i)^\s*Generate\s+(?:a|the)\s+title\s+for\s+the\s+following\s+abstract\s+of\s+a\s+paper\s*:\s*"
)
INVALID_EXACT = (
    r"(?i)^(?:\[?paper title\]?|user title example|example input|abstract|title|output)\s*:?$"
)
INVALID_LEAK = (
    r"(?i)(?:write one concise|example input\s*:|example output|user title example|"
    r"parent title\s*:|abstract\s*:|output only|```)"
)
FORBIDDEN_TERMS = r"(?i)\b(?:gold|ground[ -]?truth|rouge|reference answer|target title)\b"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters a-z and digits, repeats kept; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("[a-z0-9]+"), 0)


def join_tokens(array: Column) -> Column:
    return F.array_join(array, " ")


def compact_key(text: Column | str) -> Column:
    """Everything but a-z and digits deleted."""
    return F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]", "")


def spaced_key(text: Column | str) -> Column:
    return join_tokens(tokens(text))


def title_tokens(text: Column | str) -> Column:
    """Set of hyphen-aware tokens of two letters or more without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("[a-z0-9]+(?:-[a-z0-9]+)?"), 0)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*TITLE_STOP_WORDS)))


def strip_instruction(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), INSTRUCTION_PREFIX, ""))


def clean_title(text: Column | str, most: int = 300) -> Column:
    """Code fences and a leading label removed, then the first line with more than quotes and blanks."""
    t = F.trim(F.coalesce(col(text), F.lit("")))
    t = F.trim(F.regexp_replace(t, r"(?i)^```(?:text|title)?\s*|\s*```$", ""))
    t = F.trim(F.regexp_replace(t, r"(?i)^(?:title|output)\s*:\s*", ""))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"+|"+$', "")))
    first = F.get(F.filter(lines, lambda x: F.length(x) > 0), F.lit(0))
    return F.coalesce(F.left(first, F.lit(most)), F.lit(""))


def collapse(text: Column | str, most: int) -> Column:
    return F.left(F.regexp_replace(F.trim(F.coalesce(col(text), F.lit(""))), r"\s+", " "), F.lit(most))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Jaccard similarity of two token arrays as sets; ``empty`` when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union.cast("double"))


def head_tail(array: Column | str, most: int) -> Column:
    """The first max(1, most // 2) elements and the last of the rest, ``most`` in all."""
    a, head = col(array), max(1, most // 2)
    cut = F.concat(F.slice(a, 1, head), F.slice(a, -(most - head), most - head)) if most > head else F.slice(a, 1, head)
    return F.when(F.size(a) <= most, a).otherwise(cut)


def split_ratio(identifier: Column | str) -> Column:
    """First 32 bits of the id's sha256 as a share of the largest."""
    return F.conv(F.substring(F.sha2(col(identifier), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def hash_split(identifier: Column | str, share: float) -> Column:
    return F.when(split_ratio(identifier) < share, "validation").otherwise("train")


def hash_index(n: Column, *parts: Column) -> Column:
    """A draw from 0 to n - 1 by the md5 of the joined parts."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long"), n)


def mock_title(words: Column, salt: str, most: int = 8) -> Column:
    return F.initcap(F.concat_ws(" ", join_tokens(F.slice(words, 1, most)), F.lit(salt)))


def strict_boolean(text: Column | str) -> Column:
    """Only "true" and "false", in any case, are booleans."""
    t = F.lower(F.trim(col(text)))
    return F.when(t == "true", True).when(t == "false", False)


def span_weights(trace: Column | str, output: Column | str, prompt: Column | str, trace_weight: float, output_weight: float) -> Column:
    """Per-token loss weights: none on the prompt, an equal share of its weight on each trace and output token."""

    def share(n: Column, weight: float) -> Column:
        return F.array_repeat(F.when(n > 0, F.lit(weight) / n).otherwise(F.lit(0.0)), n)

    return F.concat(F.array_repeat(F.lit(0.0), col(prompt)), share(col(trace), trace_weight), share(col(output), output_weight))
