"""Many linear models fitted together: one pass over the rows advances all of them.

Candidates of a search, folds, repeated splits, nested shares of the rows and feature subsets differ only in constants, in
which rows they see and in which columns they may use. Their weighted normal equations are stacked in one array, so a
search of 75 draws over 5 folds takes about as many passes as a single fit. Every fit stops on its own objective. Fits that
differ only in their stopping rule take the same steps, so these are made once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pandwerk.learning.prep import FEATURES

#: Keeps weights finite where the error is zero.
ERROR_FLOOR = 1e-3
#: Iterations without a better objective after which a fit ends as stalled.
PATIENCE = 5
#: Rows whose products are held at a time, and models in one row of a task's result.
ROWS, MODELS = 1_024, 32


@dataclass(frozen=True)
class Fit:
    """One model: constants of the loss, its stopping rule and the columns it may use (None: all)."""

    C: float = 1.0
    epsilon: float = 0.0
    tol: float = 1e-4
    maxIter: int = 1000
    loss: str = "epsilon_insensitive"
    columns: tuple[int, ...] | None = None

    @property
    def squared(self) -> bool:
        return self.loss == "squared_epsilon_insensitive"


@dataclass
class Fitted:
    """Coefficients with the intercept last. `status`: `settled` (the objective stopped changing), `stalled` (no better
    one for a while; the best is kept) or `limit`. `path` holds (step, best coefficients) where asked for."""

    weights: np.ndarray
    steps: int
    objective: float
    status: str
    path: list = field(default_factory=list)


#: From a batch's meta columns to a row-by-model table of who sees what.
Membership = Callable[[np.ndarray], np.ndarray]


def rows_of(ready: DataFrame, label: str, meta: dict[str, Column], features: str = FEATURES) -> tuple[DataFrame, int]:
    """Model inputs as flat columns x0, x1, ..., `_y` and the meta columns, dealt evenly over the cores; and the width.

    The caller persists and releases them.
    """
    x = vector_to_array(features)
    first = ready.select(F.size(x).alias("n")).first()
    width = first["n"] if first else 0
    flat = ready.select(*[x[i].alias(f"x{i}") for i in range(width)], F.col(label).cast("double").alias("_y"),
                        *[c.cast("double").alias(n) for n, c in meta.items()])
    return flat.repartition(ready.sparkSession.sparkContext.defaultParallelism), width


def _matrices(batch, width: int):
    """Columns by rows: the inputs with a last one of ones; the label; and rows by columns: the meta columns."""
    data = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    x = np.vstack([*data[:width], np.ones(batch.num_rows)])
    meta = np.column_stack(data[width + 1:]) if len(data) > width + 1 else np.empty((batch.num_rows, 0))
    return x, data[width], meta


def _products(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Products of every pair of columns, in the order of the upper triangle."""
    first = 0
    for i in range(len(x)):
        np.multiply(x[i], x[i:], out=out[first:first + len(x) - i, :x.shape[1]])
        first += len(x) - i
    return out[:, :x.shape[1]]


def _added_up(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the blocks of every chunk of models; one block per chunk reaches the driver."""
    def add(table):
        import pyarrow as pa

        blocks = [np.frombuffer(b) for b in table.column("block").to_pylist()]
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "block": pa.array([sum(blocks[1:], blocks[0]).tobytes()], pa.binary())})

    out = parts.groupBy("chunk").applyInArrow(add, "chunk int, block binary").collect()
    return {r["chunk"]: np.frombuffer(bytes(r["block"])) for r in out}


def _emitted(total: np.ndarray):
    """A task's result, one row per chunk of models."""
    import pyarrow as pa

    chunks = [total[i:i + MODELS] for i in range(0, len(total), MODELS)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())],
                                      names=["chunk", "block"])


def _stacked(sums: dict[int, np.ndarray], models: int, size: int) -> np.ndarray:
    out = np.zeros((models, size))
    for chunk, block in sums.items():
        part = block.reshape(-1, size)
        out[chunk * MODELS:chunk * MODELS + len(part)] = part
    return out


def _pass(rows: DataFrame, width: int, fits: list[Fit], w: np.ndarray, who: list[int], member: Membership, start: bool):
    """Per model the upper triangle of its weighted normal equations, their right side and its loss at ``w``."""
    at, to = np.triu_indices(width + 1)
    c, eps = (np.array([getattr(f, name) for f in fits]) for name in ("C", "epsilon"))
    squared = np.array([f.squared for f in fits])
    size = len(at) + width + 2

    def run(batches):
        total, held = np.zeros((len(fits), size)), np.empty((len(at), ROWS))
        # the two kinds of loss lie apart, so that each is weighted without asking every value for its kind
        order = np.argsort(squared, kind="stable")
        plain = len(fits) - int(squared.sum())
        wt, ct, et, see = np.ascontiguousarray(w.T[order]), c[order, None], eps[order, None], np.array(who)[order]
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                x, y, meta = _matrices(whole.slice(first, ROWS), width)
                seen = np.ascontiguousarray(member(meta)[:, see].T)
                seen *= ct
                r = y - wt @ x
                beyond = np.abs(r)
                beyond -= et
                np.maximum(beyond, 0.0, out=beyond)
                loss = beyond.copy()
                loss[plain:] *= loss[plain:]
                total[:, -1] += np.einsum("ij,ij->i", seen, loss)
                if start:
                    weight, target = seen, np.broadcast_to(y, r.shape)
                else:
                    target = y - np.sign(r) * et
                    weight = seen * (beyond > 0)
                    weight[plain:] *= 2.0
                    weight[:plain] /= np.maximum(beyond[:plain], ERROR_FLOOR)
                total[:, :len(at)] += weight @ _products(x, held).T
                total[:, len(at):-1] += (weight * target) @ x.T
        yield _emitted(total[np.argsort(order)])

    sums = _stacked(_added_up(rows.mapInArrow(run, "chunk int, block binary")), len(fits), size)
    normal = np.zeros((len(fits), width + 1, width + 1))
    normal[:, at, to] = normal[:, to, at] = sums[:, :len(at)]
    return normal, sums[:, len(at):-1], sums[:, -1]


def fit_together(rows: DataFrame, width: int, fits: list[Fit], member: Membership | None = None,
                 path: bool = False, sees: list | None = None) -> list[Fitted]:
    """All fits on the rows that ``member`` gives each; ``rows`` as from `rows_of`, persisted.

    Minimises ``|w|^2 / 2 + C * sum(loss)`` of every model by reweighted least squares. A pass carries one block of
    (width + 1) numbers squared per model that still runs and task; settled models leave the following passes. With
    ``path`` the best coefficients after every step are kept, for reading off other limits and tolerances.

    ``sees`` names the rows of every fit: fits with the same name see the same rows. Without it every fit is taken to see
    rows of its own if there is a ``member``. Fits of equal rows, loss, C, epsilon and columns take the same steps; the
    first of them that still runs takes these for all, and each stops by its own rule.
    """
    sees = sees or (range(len(fits)) if member else [0] * len(fits))
    trails = [(f.C, f.epsilon, f.squared, f.columns, seen) for f, seen in zip(fits, sees)]
    member = member or (lambda meta: np.ones((len(meta), len(fits))))
    w = np.zeros((width + 1, len(fits)))
    usable = np.ones((len(fits), width + 1), bool)
    for m, f in enumerate(fits):
        if f.columns is not None:
            usable[m, :width] = False
            usable[m, list(f.columns)] = True
    best, stale = np.full(len(fits), np.inf), np.zeros(len(fits), int)
    out = [Fitted(w[:, m].copy(), 0, np.inf, "limit") for m in range(len(fits))]
    running, step = list(range(len(fits))), 0
    while running:
        trail: dict[tuple, list[int]] = {}
        for m in running:
            trail.setdefault(trails[m], []).append(m)
        heads = [same[0] for same in trail.values()]
        normal, right, loss = _pass(rows, width, [fits[m] for m in heads], w[:, heads], heads, member, step == 0)
        going = []
        for k, (head, same) in enumerate(zip(heads, trail.values())):
            at = w[:, head].copy()
            objective = float(loss[k] + at @ at / 2)
            left = [m for m in same if _goes_on(fits[m], out[m], best, stale, m, at, objective, step, path)]
            if not left:
                continue
            use = np.flatnonzero(usable[head])
            moved = np.zeros(width + 1)
            moved[use] = np.linalg.solve(normal[k][np.ix_(use, use)] + np.eye(len(use)), right[k][use])
            w[:, left] = moved[:, None]
            going += left
        running, step = sorted(going), step + 1
    return out


def _goes_on(fit: Fit, out: Fitted, best: np.ndarray, stale: np.ndarray, m: int, w: np.ndarray, objective: float, step: int,
             path: bool) -> bool:
    """Takes note of one fit's objective at ``w`` after ``step`` steps; whether it takes another."""
    if step == 0:
        return True
    gain, slack = best[m] - objective, fit.tol * abs(objective)
    if objective < best[m]:
        best[m] = objective
        out.weights, out.objective = w, objective
    if path:
        out.path.append((step, objective, out.weights))
    stale[m] = 0 if gain > slack else stale[m] + 1
    out.steps = step
    if abs(gain) <= slack:
        out.status = "settled"
    elif stale[m] >= PATIENCE:
        out.status = "stalled"
    return out.status == "limit" and step < fit.maxIter


def scores(rows: DataFrame, width: int, weights: list[np.ndarray], member: Membership) -> list[tuple[float, float, float]]:
    """(rows, RMSE, R²) of every model on the rows ``member`` gives it, all in one pass; NaN where there is nothing to
    score, and R² also where the label does not vary."""
    w, models = np.column_stack(weights), len(weights)

    def run(batches):
        total = np.zeros((models, 4))
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                x, y, meta = _matrices(whole.slice(first, ROWS), width)
                seen, error = member(meta), y[:, None] - x.T @ w
                total += np.column_stack([seen.sum(axis=0), (seen * error**2).sum(axis=0), y @ seen, (y * y) @ seen])
        yield _emitted(total)

    sums = _stacked(_added_up(rows.mapInArrow(run, "chunk int, block binary")), models, 4)
    out = []
    for n, sse, sy, syy in sums:
        spread = syy - sy * sy / n if n else 0.0
        out.append((n, float(np.sqrt(sse / n)) if n else np.nan, float(1 - sse / spread) if spread > 1e-9 * max(syy, 1.0) else np.nan))
    return out
