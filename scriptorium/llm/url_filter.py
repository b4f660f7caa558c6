"""URL filter: pattern rules indexed by their rarest literal token.

A rule is compiled to one regular expression over ``host + path``. Its literal
tokens are the maximal runs of ``[0-9A-Za-z]`` that the pattern fixes on both
sides, so any URL it fits must hold them as whole tokens. Each rule is filed
under the one of its tokens that is rarest in the URLs at hand; a URL looks up
its own tokens, gets the few candidate rules, and only those run their regular
expression. A rule without such a token is a candidate for every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship_package

TOKEN = "[0-9A-Za-z]+"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; ``regex`` replaces both for free patterns."""

    host: str
    path: str
    allow: bool
    regex: str = ""

    @property
    def text(self) -> str:
        return self.regex or self.host + self.path

    @property
    def pattern(self) -> str:
        return self.regex or rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    def tokens(self) -> list[str]:
        """Tokens that stand whole in every URL the rule fits; the end of a path prefix may go on, so it does not count."""
        if self.regex:
            return literal_tokens(self.regex)
        # an empty path leaves the end of the host open to more host characters only through the regex, so keep it out
        whole = f".{self.host}{self.path}"
        return [m.group() for m in re.finditer(TOKEN, whole) if m.end() < len(whole)]


def literal_tokens(regex: str) -> list[str]:
    """Tokens of a free pattern that are delimited on both sides by an escaped or plain separator; none if it has alternatives."""
    if re.search(r"[|(\[{?*+]", re.sub(r"\\.", "", regex)):
        return []
    plain = re.sub(r"\\([^0-9A-Za-z])", r"\1", regex)
    if "\\" in plain:
        return []
    return [m.group() for m in re.finditer(rf"(?<=[/\-=&.]){TOKEN}(?=[/\-=&])", plain) if "." not in (plain[m.start() - 1], plain[m.end()])]


#: The rule set of the query; the longest fitting rule wins.
RULES = (
    Rule("com", "/en/", False),
    Rule("example.com", "/en/7", True),
    Rule("net", "/de/", True),
    Rule("example.net", "/de/8", False),
    Rule("org", "/es/", False),
)


def split_host(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = url.substr(F.length(rest) + 4, F.length(url))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.when(url.isNull() | ~url.contains("://"), "").otherwise(
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def split_path(url: Column) -> Column:
    after = url.substr(F.length(F.substring_index(url, "://", 1)) + 4, F.length(url))
    return F.when(url.isNull() | ~url.contains("://"), "").otherwise(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs hold each rule token; as many rows as the rules have tokens at most."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(TOKEN), 0))
    rows = (
        urls.select(F.explode(tokens).alias("token"))
        .filter(F.col("token").isin(wanted))
        .groupBy("token")
        .count()
        .collect()
    )
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in rows}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by their rarest token (ties: the longer, then the first in order), and those without one."""
    index: dict[str, list[int]] = {}
    free: list[int] = []
    for k, rule in enumerate(rules):
        tokens = rule.tokens()
        if tokens:
            rarest = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            index.setdefault(rarest, []).append(k)
        else:
            free.append(k)
    return index, free


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default_allow: bool = True) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages(page_id, url, ...)``.

    A null url, or one without ``://``, has an empty host and path, no rule and
    the default verdict. Repeated rows and ids are judged row by row; an empty
    table gives an empty result; only page_id and url are read, so extra
    columns, whatever their names, play no part. Of several fitting rules the
    one with the longest text wins; ties go to the longer host, then to the
    text that sorts first.
    """
    ship_package(pages.sparkSession)
    urls = pages.select(
        F.col("page_id"), split_host(F.col("url")).alias("host"), split_path(F.col("url")).alias("path")
    )
    index, free = build_index(rules, token_counts(urls, rules))
    default = "allow" if default_allow else "block"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        token = re.compile(TOKEN)
        for batch in batches:
            found, verdicts, tried = [], [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                where = host + path
                candidates = dict.fromkeys(k for t in token.findall(where) for k in index.get(t, ()))
                fits = [k for k in [*candidates, *free] if host and compiled[k].search(where)]
                best = min(fits, key=lambda k: (-len(rules[k].text), -len(rules[k].host), rules[k].text), default=None)
                found.append(None if best is None else rules[best].text)
                verdicts.append(default if best is None else "allow" if rules[best].allow else "block")
                tried.append(len(candidates) + len(free))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string()), pa.array(tried, pa.int32())],
                ["page_id", "host", "path", "rule", "verdict", "n_candidates"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(
        judge, f"page_id {kind}, host string, path string, rule string, verdict string, n_candidates int"
    )
