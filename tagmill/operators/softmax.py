"""Logistic regression over sparse counts, cross-validated: the models of all folds are fitted in the same passes.

The models are those of ``pyspark.ml.classification.LogisticRegression`` with its defaults (columns of unit deviation,
intercept, L2, L-BFGS of ten steps of memory, strong Wolfe line search): same objective, same start, same steps. There a
round of a fold is a pass over vectors that are kept in memory or on disk, five times what is stored here; here a round is
one pass over packed counts for all folds. Blocks of rows are unpacked into a dense block and multiplied by the
coefficients of all folds that train on them. What a task sends on is one sum of gradients a fold and class.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagmill.operators import grams

#: Rows of a dense block; 128 rows of 16,384 columns are 16 MB.
BLOCK = 128
#: Rows of which the places and counts are unpacked at once.
ROWS = 1024
MEMORY, TOLERANCE = 10, 1e-6


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def stored(places: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """Places (below 65,536) and counts of rows as bytes: two a place, one a count, and what is above 255 with its place in the row."""
    large = np.flatnonzero(counts > 255)
    row = np.searchsorted(starts, large, "right") - 1
    many = np.append(0, np.cumsum(np.bincount(row, minlength=len(starts) - 1)))
    column = lambda ends, data: pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    more = np.column_stack([large - starts[row], counts[large]]).astype(np.uint32)
    return [column(starts * 2, places.astype(np.uint16)), column(starts, np.minimum(counts, 255).astype(np.uint8)), column(many * 8, more)]


def packed(rows: DataFrame, text: str, width: int, keep: str) -> DataFrame:
    """Columns ``keep`` (a schema), at, n and more: the counts of words and pairs of words of a text."""
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *stored(*grams.counts(batch.column(text), width))], [*names, "at", "n", "more"])

    return rows.select(*names, text).mapInArrow(run, f"{keep}, at binary, n binary, more binary")


class _Rows:
    """Rows of a batch: starts, places and counts of all, and what is known of each row."""

    def __init__(self, batch: pa.RecordBatch):
        (places, ends), (counts, starts), (more, many) = (self._bytes(batch.column(c)) for c in ("at", "n", "more"))
        self.places, self.counts, self.starts = places.view(np.uint16), counts.astype(np.float64), starts
        if len(more):
            place, n = more.view(np.uint32).reshape(-1, 2).T
            self.counts[np.repeat(starts[:-1], np.diff(many) // 8) + place] = n
        self.fold, self.label, self.weight = batch.column("fold").to_numpy(), batch.column("class").to_numpy().astype(np.int64), batch.column("weight").to_numpy()

    @staticmethod
    def _bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
        return np.frombuffer(x.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].copy(), (ends - ends[0]).astype(np.int64)

    def blocks(self, dense: np.ndarray) -> Iterator[tuple[int, np.ndarray, slice]]:
        """fold, block of counts, place in the batch of runs of rows of one fold; the block is good until the next one."""
        cuts = [0, *(np.flatnonzero(np.diff(self.fold)) + 1), len(self.fold)]
        flat, width = dense.reshape(-1), dense.shape[1]
        for a, b in zip(cuts, cuts[1:]):
            for i in range(a, b, len(dense)):
                rows = slice(i, min(b, i + len(dense)))
                lo, hi = self.starts[rows.start], self.starts[rows.stop]
                spots = np.repeat(np.arange(rows.stop - i) * width, np.diff(self.starts[i : rows.stop + 1])) + self.places[lo:hi]
                flat[spots] = self.counts[lo:hi]
                yield int(self.fold[a]), dense[: rows.stop - i], rows
                flat[spots] = 0


def _summed(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Sums of vectors (as bytes) by fold and k, added up where the data is."""

    def add(group: pa.Table) -> pa.Table:
        total = 0
        for x in group.column("v"):
            total = total + np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"fold": group.column("fold")[:1], "k": group.column("k")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    return {(r.fold, r.k): np.frombuffer(r.v, np.float64) for r in parts.groupBy("fold", "k").applyInArrow(add, "fold int, k int, v binary").collect()}


def _sums(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (fold, k), v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["fold", "k", "v"])


_PARTS = "fold int, k int, v binary"


def _moments(rows: DataFrame, width: int, classes: int) -> dict[int, np.ndarray]:
    """By fold the sums of a column's weighted counts, their squares and the rows that have it; weights by class, their
    squares and the number of rows follow in a last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in _small(batches):
            x = _Rows(batch)
            sizes = np.diff(x.starts)
            fold, w = np.repeat(x.fold, sizes), np.repeat(x.weight, sizes)
            for f in np.unique(x.fold):
                its, mine = fold == f, x.fold == f
                at, n, v = x.places[its], x.counts[its], w[its]
                last = np.concatenate([np.bincount(x.label[mine], x.weight[mine], classes), [(x.weight[mine] ** 2).sum(), mine.sum()]])
                found = [np.bincount(at, v * n, width), np.bincount(at, v * n * n, width), np.bincount(at, minlength=width).astype(float), last]
                for k, s in enumerate(found):
                    sums[int(f), k] = sums.get((int(f), k), 0) + s
        yield from _sums(sums)

    found = _summed(rows.mapInArrow(run, _PARTS))
    return {f: [found[f, k] for k in range(4)] for f in {f for f, _ in found}}


def _minimum(x: np.ndarray, rounds: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS with a strong Wolfe line search, step by step as in Breeze: yields a point, is sent its value and gradient."""
    value, grad = yield x
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    failed = False
    for done in range(rounds):
        while True:
            d = grad.copy()
            rho = [s @ y for s, y in zip(steps, changes)]
            a = []
            for s, y, r in zip(steps, changes, rho):
                a.append((s @ d) / r)
                d -= a[-1] * y
            if steps:
                d *= rho[0] / (changes[0] @ changes[0])
            for s, y, r, b in reversed(list(zip(steps, changes, rho, a))):
                d += s * (b - (y @ d) / r)
            d = -d
            found = yield from _wolfe(x, d, value, grad, 1.0 if done else 1.0 / max(np.linalg.norm(d), 1e-300))
            if found is not None and found[0] * np.linalg.norm(grad) >= 1e-10:
                break
            if failed:
                return x
            failed, steps, changes = True, [], []
        failed = False
        t, now, slope = found
        moved = x + t * d
        steps, changes = [moved - x, *steps][:MEMORY], [slope - grad, *changes][:MEMORY]
        x, value, grad = moved, now, slope
        if np.linalg.norm(grad) <= TOLERANCE * value:
            break
    return x


def _wolfe(x, d, value, grad, t):
    """Step length, value and gradient there, or None."""
    slope = grad @ d
    if not slope < 0:
        return None

    def phi(t):
        v, g = yield x + t * d
        return t, v, g @ d, g

    def between(l, r):  # noqa: E741
        d1 = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
        d2 = np.sqrt(max(d1 * d1 - l[2] * r[2], 0.0))
        size = r[0] - l[0]
        return min(max(r[0] - size * (r[2] + d2 - d1) / (r[2] - l[2] + 2 * d2), l[0] + 0.1 * size), l[0] + 0.9 * size)

    def zoom(low, high):
        for _ in range(10):
            c = yield from phi(between(high, low) if low[0] > high[0] else between(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return c[0], c[1], c[3]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        return None

    low = (0.0, value, slope, grad)
    for i in range(10):
        c = yield from phi(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[0], c[1], c[3]
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low, t = c, t * 1.5
    return None


def _losses(rows: DataFrame, asked: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """By fold of ``asked`` (coefficients with the intercept as last column, a row a class but the first, whose margin is 0)
    the gradient over the rows of the other folds; the loss is in a last row."""
    folds, shape = sorted(asked), next(iter(asked.values())).shape
    shared = rows.sparkSession.sparkContext.broadcast(asked)
    m, width = shape[0], shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, sides, dense, sums = shared.value, {}, np.zeros((BLOCK, width)), {}
        for batch in _small(batches):
            x = _Rows(batch)
            for own, block, at in x.blocks(dense):
                if own not in sides:
                    others = [f for f in folds if f != own]
                    c = np.concatenate([asked[f] for f in others]) if others else np.zeros((0, width + 1))
                    sides[own] = others, np.ascontiguousarray(c[:, :-1]), c[:, -1], np.zeros((len(c), width)), np.zeros((len(others), m + 1))
                others, c, shift, total, ends = sides[own]
                if not others:
                    continue
                margins = ((c @ block.T).T + shift).reshape(len(block), len(others), m)
                top = np.maximum(margins.max(2), 0)
                e = np.exp(margins - top[:, :, None])
                z = e.sum(2) + np.exp(-top)
                label, w = x.label[at], x.weight[at]
                p = e / z[:, :, None]
                each, known = np.arange(len(block)), label > 0
                right = np.zeros(top.shape)
                right[known] = margins[each[known], :, label[known] - 1]
                p[each[known], :, label[known] - 1] -= 1
                p *= w[:, None, None]
                total += p.reshape(len(block), -1).T @ block
                ends[:, :-1] += p.sum(0)
                ends[:, -1] += w @ (top + np.log(z) - right)
        for others, _, _, total, ends in sides.values():
            for i, f in enumerate(others):
                for k in range(m):
                    sums[f, k] = sums.get((f, k), 0) + np.append(total[i * m + k], ends[i, k])
                sums[f, m] = sums.get((f, m), 0) + ends[i, -1:]
        yield from _sums(sums)

    found = _summed(rows.mapInArrow(run, _PARTS))
    shared.destroy()
    return {f: (np.stack([found[f, k] for k in range(m)]), float(found[f, m][0])) for f in folds}


def _fit(fold: int, moments: dict[int, list[np.ndarray]], scale: Callable[[float, np.ndarray], np.ndarray], penalty: float, rounds: int):
    """Generator: yields coefficients over counts, is sent gradient and loss; returns the coefficients of the model."""
    parts = [m for f, m in sorted(moments.items()) if f != fold]
    first, second, present, last = (sum(p[k] for p in parts) for k in range(4))
    by_class, square, n = last[:-2], last[-2], last[-1]
    weight, classes = by_class.sum(), len(by_class)
    m = classes - 1
    if np.count_nonzero(by_class) == 1:  # nothing to learn
        label = int(np.argmax(by_class))
        ends = np.where(np.arange(1, classes) == label, np.inf, 0.0) if label else np.full(m, -np.inf)
        return np.column_stack([np.zeros((m, len(first))), ends])
    factor = scale(n, present)
    mean = first / weight
    variance = np.maximum(second - first * mean, 0) / (weight - square / weight)
    unit = np.divide(1.0, np.sqrt(variance), out=np.zeros_like(variance), where=(variance > 0) & (factor != 0))  # a column's factor cancels, but 0
    own = classes if m > 1 else 1  # two classes have one row of coefficients, as in Spark
    if own == 1:
        start = np.array([np.log(by_class[1] / by_class[0])])
    else:
        start = np.log1p(by_class)
        start -= start.mean()

    def plain(x):
        b = x.reshape(own, -1)
        c = b[:, :-1] * unit
        c = np.column_stack([c, b[:, -1] - c @ mean])
        return c if own == 1 else c[1:] - c[0]

    search = _minimum(np.column_stack([np.zeros((own, len(first))), start]).ravel(), rounds)
    x = next(search)
    while True:
        gradient, loss = yield plain(x)
        g = np.column_stack([(gradient[:, :-1] - gradient[:, -1:] * mean) * unit, gradient[:, -1]])
        if own > 1:
            g = np.concatenate([-g.sum(0, keepdims=True), g])
        b = x.reshape(own, -1)[:, :-1]
        g /= weight
        g[:, :-1] += penalty * b
        try:
            x = search.send((loss / weight + 0.5 * penalty * (b * b).sum(), g.ravel()))
        except StopIteration as end:
            return plain(end.value)


def models(rows: DataFrame, width: int, classes: int, scale: Callable[[float, np.ndarray], np.ndarray], penalty: float, rounds: int) -> dict[int, np.ndarray]:
    """By fold the model of the rows outside it: coefficients over counts, a row a class but the first, intercepts last.

    rows: class, weight, fold and what ``packed`` gives. ``scale``: the factor of each column from the number of rows and of
    those that have the column.
    """
    # a task sends as much whatever it reads, so that a few files go to one
    rows = rows.coalesce(max(4 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() // 4))
    moments = _moments(rows, width, classes)
    if classes < 2 or len(moments) < 2:
        return {f: np.zeros((classes - 1, width + 1)) for f in moments}
    fits, asked, found = {f: _fit(f, moments, scale, penalty, rounds) for f in moments}, {}, {}
    answers = dict.fromkeys(fits)
    while answers:
        asked = {}
        for f, answer in answers.items():
            try:
                asked[f] = fits[f].send(answer)
            except StopIteration as end:
                found[f] = end.value
        answers = _losses(rows, asked) if asked else {}
    return found


def guesses(rows: DataFrame, fitted: dict[int, np.ndarray]) -> DataFrame:
    """id, truth, guess: each row by the model of its fold."""
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = None
        for batch in _small(batches):
            x = _Rows(batch)
            out = np.zeros(len(x.fold))
            dense = np.zeros((BLOCK, next(iter(shared.value.values())).shape[1] - 1)) if dense is None else dense
            for fold, block, at in x.blocks(dense):
                c = shared.value[fold]
                out[at] = np.argmax(np.column_stack([np.zeros(len(block)), block @ c[:, :-1].T + c[:, -1]]), 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("class"), pa.array(out)], ["id", "truth", "guess"])

    return rows.mapInArrow(run, "id bigint, truth double, guess double")
