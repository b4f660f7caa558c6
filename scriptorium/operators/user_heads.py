"""Heads of users on frozen features, trained from preference pairs with gradients that Spark adds up.

All users take the same step at once: every task adds the gradients of the pairs
that it reads by user, these few sums meet by user, and a step of Adam with
decayed weights follows. So no user's pairs meet in one task, however many they
are. A head starts at given weights, is pulled back to them, and keeps the state
that did best on its validation pairs; a user is done when that has not got
better for some steps.

``linear``: w f + b. ``residual``: that, frozen, plus a correction of the same
shape from zero. ``adapter``: the head on f + U tanh(D f + d) + u, with U and u
from zero, so that it starts as the given head exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.sources.tables import discard, materialize, ship_package

KINDS = ("linear", "residual", "adapter")
SUMS = "user_id string, part string, pairs long, weight double, loss double, right double, gradient array<double>"
STATE = (
    "user_id string, theta array<double>, mean array<double>, square array<double>, best array<double>, best_loss double, best_step int,"
    " first_loss double, first_accuracy double, loss double, accuracy double, pairs long, validation long, done boolean"
)
#: Users whose sums a task holds before it hands them on, and pairs that it unpacks at a time.
HELD, ROWS = 4096, 1024


@dataclass(frozen=True)
class Training:
    """Kind of head, rank of an adapter, steps at most, steps without a better state, step size, decay, pull to the start,
    longest gradient, seed of the adapter's first weights, and smallest gain of validation loss that counts."""

    kind: str = "linear"
    rank: int = 4
    steps: int = 20
    patience: int = 5
    rate: float = 0.05
    decay: float = 0.0
    anchor: float = 0.01
    longest: float = 1.0
    seed: int = 42
    least_gain: float = 1e-6


def first_weights(initial: np.ndarray, t: Training) -> np.ndarray:
    """All weights of a head at its start; ``initial`` is the given head's, its bias last."""
    d = len(initial) - 1
    if t.kind == "linear":
        return initial.copy()
    if t.kind == "residual":
        return np.zeros(d + 1)
    bound = 1 / np.sqrt(d)
    down = np.random.default_rng(t.seed).uniform(-bound, bound, (t.rank * d) + t.rank)
    return np.concatenate((initial, down, np.zeros(d * t.rank + d)))


def scores(theta: np.ndarray, initial: np.ndarray, x: np.ndarray, t: Training) -> np.ndarray:
    d = x.shape[1]
    if t.kind == "linear":
        return x @ theta[:d] + theta[d]
    if t.kind == "residual":
        return x @ (initial[:d] + theta[:d]) + initial[d] + theta[d]
    w, down, bias, up, shift = _parts(theta, d, t.rank)
    return (x + np.tanh(x @ down.T + bias) @ up.T + shift) @ w[:d] + w[d]


def _parts(theta: np.ndarray, d: int, rank: int) -> tuple[np.ndarray, ...]:
    cuts = np.cumsum([d + 1, rank * d, rank, d * rank])
    w, down, bias, up, shift = np.split(theta, cuts)
    return w, down.reshape(rank, d), bias, up.reshape(d, rank), shift


def gradient(theta: np.ndarray, x: np.ndarray, slope: np.ndarray, t: Training) -> np.ndarray:
    """Sum over rows of ``slope`` times the derivative of the score by all weights."""
    d = x.shape[1]
    plain = np.append(slope @ x, slope.sum())
    if t.kind != "adapter":
        return plain
    w, down, bias, up, _ = _parts(theta, d, t.rank)
    hidden = np.tanh(x @ down.T + bias)
    back = (1 - hidden**2) * (up.T @ w[:d])
    moved = hidden @ up.T + theta[-d:]
    by_w = plain + np.append(slope @ moved, 0.0)
    by_up = np.outer(w[:d], slope @ hidden)
    return np.concatenate((by_w, ((back * slope[:, None]).T @ x).ravel(), slope @ back, by_up.ravel(), slope.sum() * w[:d]))


def groups_of(theta: np.ndarray, d: int, t: Training) -> list[slice]:
    """The weights that the pull to the start averages over by themselves: each matrix, each bias."""
    sizes = [d, 1] if t.kind != "adapter" else [d, 1, t.rank * d, t.rank, d * t.rank, d]
    ends = np.cumsum(sizes)
    return [slice(int(e - n), int(e)) for e, n in zip(ends, sizes, strict=True)]


def next_weights(state: dict, total: np.ndarray, pairs: int, start: np.ndarray, d: int, step: int, t: Training) -> dict:
    """A step of Adam with decoupled decay on the mean gradient and the pull, cut to the longest."""
    theta = np.array(state["theta"])
    slope = total / pairs
    for part in groups_of(theta, d, t):
        slope[part] += t.anchor * 2 * (theta[part] - start[part]) / (part.stop - part.start)
    length = np.sqrt((slope**2).sum())
    slope *= min(1.0, t.longest / (length + 1e-6))
    mean, square = 0.9 * np.array(state["mean"]) + 0.1 * slope, 0.999 * np.array(state["square"]) + 0.001 * slope**2
    moved = (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    theta = theta * (1 - t.rate * t.decay) - t.rate * moved
    return {"theta": theta.tolist(), "mean": mean.tolist(), "square": square.tolist()}


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Equally long vectors as rows, without an object for each number; nulls become no number."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1)


def _sums(pairs: DataFrame, states: DataFrame, initial: np.ndarray, t: Training) -> DataFrame:
    """Sums of each task over the pairs of users that are not done, by user and part."""
    names = [f.split()[0] for f in SUMS.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*key, *values[:4], values[4].tolist()) for key, values in held.items()]
            held.clear()
            kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            users, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            chosen, rejected = (_matrix(batch.column(k)) for k in (2, 3))
            weights = np.array(batch.column(4).to_pylist(), dtype=float)
            places: dict[tuple[str, str], list[int]] = {}
            for k, key in enumerate(zip(users, parts, strict=True)):
                places.setdefault(key, []).append(k)
            for key, own in places.items():
                theta = np.array(batch.column(5)[own[0]].as_py())  # a user's rows carry the same
                a, b, w = chosen[own], rejected[own], weights[own]
                gap = scores(theta, initial, a, t) - scores(theta, initial, b, t)
                slope = -w / (1 + np.exp(np.clip(gap, -500, 500)))
                made = [len(own), w.sum(), float((np.logaddexp(0, -gap) * w).sum()), float((gap > 0).sum())]
                grad = gradient(theta, a, slope, t) - gradient(theta, b, slope, t) if key[1] == "train" else np.zeros(len(theta))
                if key in held:
                    held[key] = [x + y for x, y in zip(held[key], [*made, grad], strict=True)]
                else:
                    held[key] = [*made, grad]
            if len(held) >= HELD:
                yield flush()
        if held:
            yield flush()

    open_users = states.filter("NOT done").select("user_id", "theta")
    return pairs.join(open_users, "user_id").select("user_id", "part", "chosen", "rejected", "weight", "theta").mapInArrow(add, SUMS)


def fit_user_heads(pairs: DataFrame, initial: list[float], training: Training = Training()) -> DataFrame:
    """user_id, pairs, validation, best_step, first_loss, first_accuracy, loss, accuracy, weights of every user with training pairs.

    ``pairs(user_id, part, chosen, rejected, weight)``: part is train or
    validation, chosen and rejected are feature vectors as long as ``initial``
    less its bias. Losses are means of weighted softplus over validation pairs
    (training pairs where a user has none), accuracies the share of pairs whose
    chosen one scores higher; ``first_`` is before any step, the others at the
    best state, whose weights are returned (a residual's as the sum of both).
    """
    if training.kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    ship_package(pairs.sparkSession)
    base = np.array(initial, dtype=float)
    d = len(base) - 1
    start = first_weights(base, training)
    table = materialize(pairs.filter("part IN ('train', 'validation')").select("user_id", "part", "chosen", "rejected", F.coalesce("weight", F.lit(1.0)).alias("weight")), "pairs")
    zeros = F.array_repeat(F.lit(0.0), len(start))
    theta = F.lit(start.tolist()) if len(start) else F.array().cast("array<double>")
    counts = table.groupBy("user_id").agg(F.count(F.when(F.col("part") == "train", 1)).alias("pairs"), F.count(F.when(F.col("part") == "validation", 1)).alias("validation"))
    none = F.lit(None).cast("double")
    begin = counts.filter("pairs > 0").select(
        "user_id", theta.alias("theta"), zeros.alias("mean"), zeros.alias("square"), theta.alias("best"), none.alias("best_loss"), F.lit(0).alias("best_step"),
        none.alias("first_loss"), none.alias("first_accuracy"), none.alias("loss"), none.alias("accuracy"), "pairs", "validation", F.lit(False).alias("done"),
    )
    states = materialize(begin, "heads")
    fields = [f.strip().split()[0] for f in STATE.split(",")]

    for step in range(training.steps + 1):
        if states.filter("NOT done").isEmpty():
            break
        sums = _sums(table, states, base, training)
        # as many rows of a user as tasks that read its pairs
        gathered = sums.groupBy("user_id").agg(F.collect_list(F.struct("part", "pairs", "loss", "right", "gradient")).alias("sums"))
        moved = _moved(states.filter("NOT done").join(gathered, "user_id"), start, d, step, training)
        after = materialize(moved.unionByName(states.filter("done")).select(*fields), "heads")
        discard(states)
        states = after
    discard(table)
    whole = F.zip_with("best", F.lit(base.tolist()), lambda x, y: x + y) if training.kind == "residual" else F.col("best")
    return states.select("user_id", "pairs", "validation", "best_step", "first_loss", "first_accuracy", F.col("best_loss").alias("loss"), "accuracy", whole.alias("weights"))


def _moved(rows: DataFrame, start: np.ndarray, d: int, step: int, t: Training) -> DataFrame:
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for state in batch.to_pylist():
                sums = state.pop("sums")
                sums.sort(key=lambda s: (s["part"], s["pairs"], s["loss"], s["right"]))  # the order of tasks must not show
                own = [s for s in sums if s["part"] == ("validation" if state["validation"] else "train")]
                n = sum(s["pairs"] for s in own)
                loss, accuracy = sum(s["loss"] for s in own) / n, sum(s["right"] for s in own) / n
                if step == 0:
                    state |= {"first_loss": loss, "first_accuracy": accuracy}
                if state["best_loss"] is None or loss < state["best_loss"] - t.least_gain:
                    state |= {"best_loss": loss, "accuracy": accuracy, "best_step": step, "best": state["theta"]}
                state["loss"] = loss
                state["done"] = step == t.steps or step - state["best_step"] >= t.patience
                if not state["done"]:
                    train = [s for s in sums if s["part"] == "train"]
                    total = np.sum([s["gradient"] for s in train], axis=0)
                    state |= next_weights(state, total, sum(s["pairs"] for s in train), start, d, step + 1, t)
                out.append(state)
            yield pa.RecordBatch.from_pylist(out, ARROW_STATE)

    return rows.mapInArrow(move, STATE)


_KINDS = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
ARROW_STATE = pa.schema([(f.strip().split()[0], _KINDS[f.strip().split()[1]]) for f in STATE.split(",")])
