"""JSON out of model answers that hold it damaged: a strict reading first, known slips next, then a lenient reader.

The lenient reader goes once over the text with a stack of open containers. It
supplies ends that are missing, lets a closer of the wrong kind close what is
open, takes single quotes and bare words, does without commas and colons, and
keeps backslashes that JSON does not know. Columns of answers are read in Arrow
batches; an answer is held whole, however long, and read in time linear in it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A fenced answer, slips of known endpoints, prefixes of a title, the longest title.
FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL | re.IGNORECASE)
TRAILING_COMMA = re.compile(r",\s*([}\]])")
DOUBLED_BRACE = re.compile(r'([\[,]\s*)\{\s*\{(?=\s*")')
LONE_BACKSLASH = re.compile(r'\\(?!["\\/bfnrtu])')
TITLE_PREFIX = re.compile(r"^(?:title|output)\s*:\s*", re.IGNORECASE)
MOST_CHARACTERS = 300

ESCAPES = {'"': '"', "'": "'", "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
WORDS = {"true": True, "false": False, "null": None, "none": None}
CLOSERS = {"}": dict, "]": list}
_SPACE = re.compile(r"\s*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_PLAIN = {'"': re.compile(r'[^"\\]+'), "'": re.compile(r"[^'\\]+")}
_BARE_KEY, _BARE_VALUE = re.compile(r"[^\s:,{}\[\]\"']+"), re.compile(r"[^,}\]\n]+")


class _Open:
    """A container that is not closed yet; an object may have a key that waits for its value."""

    def __init__(self, value: dict | list):
        self.value, self.key, self.colon = value, None, False
        self.last: str | None = None  # the key of a pair that had no colon


def joined(text: str) -> str:
    """Escaped halves of a character as one, a half by itself as the replacement character."""
    if text.isascii() or not re.search("[\ud800-\udfff]", text):
        return text
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def read_string(text: str, at: int, key: bool = False) -> tuple[str, int]:
    """A quoted string from its opening quote on: a quote closes it where something follows that may stand after a string (or a key)."""
    after_it = ",:}]\"'" + "{[-0123456789" * key
    quote, out, at, n = text[at], [], at + 1, len(text)
    while at < n:
        plain = _PLAIN[quote].match(text, at)
        if plain:
            out.append(plain.group())
            at = plain.end()
        elif text[at] == "\\":
            code = text[at + 1 : at + 2]
            point = text[at + 2 : at + 6]
            if code == "u" and re.fullmatch("[0-9a-fA-F]{4}", point):
                out.append(chr(int(point, 16)))
                at += 6
            else:
                out.append(ESCAPES.get(code, "\\" + code))
                at += 2
        else:
            after = _SPACE.match(text, at + 1).end()
            if after >= n or text[after] in after_it or "\n" in text[at + 1 : after]:
                return joined("".join(out)), at + 1
            out.append(quote)
            at += 1
    return joined("".join(out)), n


def read_leniently(text: str) -> Any:
    """The first object or array of a text with all that can be read of it; a string where there is neither."""
    at, n = 0, len(text)
    stack: list[_Open] = []
    root: Any = ""

    def attach(value: Any) -> None:
        top = stack[-1]
        if isinstance(top.value, list):
            top.value.append(value)
        elif top.key is None:
            top.key, top.colon, top.last = value if isinstance(value, str) else json.dumps(value), False, None
        else:
            top.value[top.key] = value
            top.last = None if top.colon else top.key
            top.key = None

    def close() -> None:
        top = stack.pop()
        if top.key is not None:
            top.value[top.key] = None

    starts = [p for p in (text.find("{"), text.find("[")) if p >= 0]
    if not starts:
        return root
    at = min(starts)
    while at < n:
        c = text[at]
        if c in "{[":
            value: dict | list = {} if c == "{" else []
            if not stack:
                root = value
            elif isinstance(stack[-1].value, dict) and stack[-1].key is None:
                at += 1  # an object cannot be a key: a doubled brace
                continue
            else:
                attach(value)
            stack.append(_Open(value))
            at += 1
        elif c in "}]":
            kinds = [type(o.value) for o in stack]
            if CLOSERS[c] in kinds:
                while not isinstance(stack[-1].value, CLOSERS[c]):
                    close()
            close()  # a closer of a kind that is not open closes what is
            at += 1
            if not stack:
                return root
        elif c == ":" and isinstance(stack[-1].value, dict):
            top = stack[-1]
            if top.key is not None:
                top.colon = True
            elif top.last is not None and isinstance(top.value[top.last], str):  # the value before was a key, its own key bare of one
                top.key, top.colon, top.value[top.last] = top.value[top.last], True, None
            at += 1
        elif c in "\"'":
            value, at = read_string(text, at, isinstance(stack[-1].value, dict) and stack[-1].key is None)
            attach(value)
        elif c.isspace() or c in ",:":
            at += 1
        else:
            top = stack[-1]
            keyed = isinstance(top.value, dict) and top.key is None
            bare = (_BARE_KEY if keyed else _BARE_VALUE).match(text, at)
            word = bare.group().strip()
            at = bare.end()
            if keyed:
                attach(word)
            elif _NUMBER.fullmatch(word):
                attach(json.loads(word))
            else:
                attach(WORDS.get(word.lower(), word) if word.lower() in WORDS else word)
    while stack:
        close()
    return root


def unfenced(text: str) -> str:
    value = text.strip()
    fenced = FENCE.fullmatch(value)
    return fenced.group(1).strip() if fenced else value


def outermost(text: str, openers: str, closers: str) -> str | None:
    """From the first opener to the last closer, if they stand in this order."""
    starts = [p for p in map(text.find, openers) if p >= 0]
    end = max(map(text.rfind, closers))
    return text[min(starts) : end + 1] if starts and end >= min(starts) else None


def extract(text: str, scalar: bool = False) -> Any:
    """The object or array (strictly read, any value) of an answer; with ``scalar`` one line of words too. ValueError if there is none."""
    value = unfenced(text)
    candidates = [value, *filter(None, [outermost(value, "{[", "}]")])]
    for candidate in candidates:
        commas = DOUBLED_BRACE.sub(r"\1{", TRAILING_COMMA.sub(r"\1", candidate))
        for attempt in (candidate, commas, LONE_BACKSLASH.sub(r"\\\\", commas)):
            for strict in (True, False):
                try:
                    return json.loads(attempt, strict=strict)
                except (ValueError, RecursionError):
                    continue
    for candidate in candidates:
        found = read_leniently(candidate)
        if isinstance(found, dict | list):
            return found
        line = candidate.strip().strip('"').strip()
        if scalar and line and not re.search(r"[\r\n]", line):
            return line
    raise ValueError("no object or array")


def base_text(value: str) -> dict:
    """The first line that is not empty, without prefix and quotes; no object or array."""
    lines = TITLE_PREFIX.sub("", value).strip().splitlines()
    title = next((line.strip().strip('"') for line in lines if line.strip()), "")
    if not title or title[0] in "{[":
        raise ValueError("no title")
    return {"output": title}


def plain_output(value: str) -> dict:
    """The whole answer, if it is one short line and no object or array."""
    if not value or value[0] in "{[" or "\n" in value or len(value) > MOST_CHARACTERS:
        raise ValueError("not one plain line")
    return {"output": value}


def whole_object(value: str, output: bool = False) -> dict:
    """The object of an answer, at most with commas too many; with ``output`` it must have an output that is a string."""
    for candidate in [value, *filter(None, [outermost(value, "{", "}")])]:
        try:
            found = json.loads(TRAILING_COMMA.sub(r"\1", candidate))
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict) and (not output or isinstance(found.get("output"), str)):
            return found
    raise ValueError("no object" + " with an output" * output)


def output_only(value: str) -> dict:
    """The object with an output, or the output's own string out of a damaged object, or one line without any wrapping."""
    try:
        return whole_object(value, output=True)
    except ValueError:
        pass
    field = re.search(r"[\"']output[\"']\s*:\s*", value, re.IGNORECASE)
    if not field:
        title = value.strip().strip('"').strip()
    else:
        rest = value[field.end() :].lstrip()
        if rest[:1] in ('"', "'"):
            title = quoted_field(rest)
        else:
            title = re.split(r"[}\]]", rest, maxsplit=1)[0].strip().strip(",")
    if title.startswith("```") and title.endswith("```"):
        title = title[3:-3].strip().removeprefix("json").strip()
    if not title or "\n" in title or len(title) > MOST_CHARACTERS:
        raise ValueError("no output in the damaged object" if field else "not one plain line")
    return {"output": title}


def quoted_field(rest: str) -> str:
    """The string that ``rest`` begins with, up to its quote or the end; escapes are read within double quotes only."""
    body = re.match(r'"((?:[^"\\]|\\.)*)' if rest[0] == '"' else r"'((?:[^'\\]|\\.)*)", rest, re.DOTALL).group(1)
    if rest[0] == '"':
        try:
            return str(json.loads(f'"{body}"'))
        except ValueError:
            pass
    return body


EDITOR_MODES: dict[str, Callable[[str], dict]] = {
    "object": whole_object,
    "output_only": output_only,
    "plain": plain_output,
    "base_text": base_text,
}


def _compact(value: Any) -> str:
    return joined(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def repaired_json(text: Column, scalar: bool = False) -> Column:
    """Compact JSON of what extract() reads in each answer; null for a null answer and where there is nothing."""

    @F.pandas_udf(T.StringType())
    def read(answers: pd.Series) -> pd.Series:
        def one(answer: str | None) -> str | None:
            try:
                return None if answer is None else _compact(extract(answer, scalar))
            except (ValueError, RecursionError):  # nothing there, or nested deeper than can be written
                return None

        return answers.map(one)

    return read(text)


def editor_answer(text: Column, mode: str) -> Column:
    """A struct of ``value``, the answer's object as compact JSON, and ``error``, why there is none; a null answer counts as empty."""
    parse = EDITOR_MODES[mode]

    @F.pandas_udf("value string, error string")
    def read(answers: pd.Series) -> pd.DataFrame:
        rows = []
        for answer in answers:
            try:
                rows.append((_compact(parse(unfenced(answer or ""))), None))
            except (ValueError, RecursionError) as problem:
                rows.append((None, str(problem)))
        return pd.DataFrame(rows, columns=["value", "error"])

    return read(text)
