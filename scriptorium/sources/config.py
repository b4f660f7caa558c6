"""Run configuration: inheritance by deep merge, stage paths, run names, and Markdown tables of reports."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable, Iterable, Mapping
from datetime import datetime
from typing import Any

STAGES = ("01_prepared", "02_retrieved", "03_seeds", "07_editor_scored")
RANKER_KEYS = ("model", "maximum_length", "pair_margin", "pairs_per_sample", "temperature")


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``over`` laid on ``base``: mappings are merged key by key, anything else is replaced."""
    out = dict(copy.deepcopy(base))
    for key, value in over.items():
        old = out.get(key)
        out[key] = merged(old, value) if isinstance(old, Mapping) and isinstance(value, Mapping) else copy.deepcopy(value)
    return out


def load(name: str, read: Callable[[str], Mapping[str, Any]], seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """A configuration with all it inherits through ``base``; a circle is an error."""
    if name in seen:
        raise ValueError("configurations inherit in a circle: " + " -> ".join([*seen, name]))
    own = dict(read(name))
    base = own.pop("base", None)
    return merged(load(base, read, (*seen, name)), own) if base else merged({}, own)


def stage_path(root: str, split: str, stage: str) -> str:
    """Where a stage's rows of a split are kept."""
    if stage not in STAGES:
        raise ValueError(f"no such stage: {stage}")
    return f"{root.rstrip('/')}/{split}/{stage}"


def round_path(root: str, number: int, name: str) -> str:
    """Where a preference round keeps its tables."""
    return f"{root.rstrip('/')}/round_{number}/{name}"


def safe_name(text: str) -> str:
    """Lower-case letters and digits, joined by underscores."""
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


def run_name(label: str, now: datetime) -> str:
    return f"{safe_name(label)}_{now:%Y%m%d_%H%M%S}"


def ranker_view(config: Mapping[str, Any], split: str) -> dict[str, Any]:
    """What a ranker may see of a configuration: its own settings and its inputs."""
    ranker = config.get("ranker", {})
    return {"ranker": {k: ranker[k] for k in RANKER_KEYS if k in ranker}, "split": split, "data": config.get("data", "")}


def markdown_table(rows: Iterable[Mapping[str, Any]], columns: Iterable[str]) -> str:
    """Report rows as a Markdown table; floats with four places, missing values as a dash."""

    def shown(value: Any) -> str:
        if value is None:
            return "-"
        return f"{value:.4f}" if isinstance(value, float) else str(value).replace("|", "\\|")

    columns = list(columns)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(shown(r.get(c)) for c in columns) + " |" for r in rows)])
