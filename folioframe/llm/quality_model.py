"""Quality classifier: Bradley-Terry ranking of documents.

A document's strength is linear in features of its whole text.  All preference
pairs (a document labelled 1 over one labelled 0) are fitted by logistic loss
on feature differences; the strength at the quantile of the training scores
that equals the share of label 0 becomes the threshold, and the score is the
logistic of the distance from it.

Every label that isn't held out counts, in every pair: a Newton step needs of
all rows only sums by label and by bin of the score (``WIDTH`` wide, at its
rows' mean score), so the driver holds as much however many rows there are.
The sums are of whole numbers and don't depend on the order of rows.

Defined results: null and empty texts are scored by their (zero) features; a
text of any length is scored whole; without labels of both kinds (empty tables
too) every score is 0.5; several labels of one id all count; repeated rows are
scored each; rows without an id are scored, never learnt from, and have no
``held_out``; a score that ties with the threshold is 0.5; extra columns of any
name are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import store, textnp
from folioframe.llm.language_id import held_out

WIDTH, BINS, ONE = 0.25, 128, 1 << 12  # of bins of scores around 0; ONE: a standard deviation in sums
_CLASS = np.full(256, 0, np.uint8)
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\x0b\x0c", b".,;:'\"", b"!?", b"#*$%&|<>=+_~^@\\/{}[]()-", bytes(range(128, 256))), 1):
    _CLASS[list(_set)] = _k


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of numbers for each document: shares of character classes, shape of words and lines, repetition."""
    docs = len(off) - 1
    size = np.maximum(np.diff(off), 1).astype(float)
    of = np.repeat(np.arange(docs), np.diff(off))
    share = np.bincount(of * 9 + _CLASS[raw], minlength=docs * 9).reshape(docs, 9)[:, 1:] / size[:, None]
    starts, ends, before = textnp.word_spans(raw, off)
    n = np.diff(before)
    some = np.maximum(n, 1).astype(float)
    wdoc = np.repeat(np.arange(docs), n)
    length = (ends - starts).astype(float)
    by = lambda values: np.bincount(wdoc, values, minlength=docs)
    mean = by(length) / some
    spread = np.sqrt(np.maximum(by(length**2) / some - mean**2, 0))
    first, last = (_CLASS[raw[starts]], _CLASS[raw[ends - 1]]) if len(starts) else (wdoc, wdoc)
    kind = [by(x) / some for x in (first == 2, first == 7, last == 7, last == 5, last == 6, length == 1)]
    hashes = textnp.word_hashes(raw, starts, ends, lower=True)
    order = np.lexsort((hashes, wdoc))
    again = np.zeros(len(order))
    if len(order):
        again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (wdoc[order][1:] == wdoc[order][:-1])
    repeated = np.bincount(wdoc[order], again, minlength=docs) / np.sqrt(some) / 10
    lines = np.bincount(of, raw == 10, minlength=docs) + 1.0
    return np.column_stack([share, np.log1p(n) / 5, np.log1p(n / lines) / 3, mean / 10, spread / 10, *kind, repeated, n == 0]).astype(float)


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textnp.chunks(batches, max_bytes=1 << 20):
            x = features(*textnp.buffer_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(list(x), pa.list_(pa.float64()))], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", x array<double>")


def _totals(rows: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], kind: str = "long") -> np.ndarray:
    """Sum of what f gives of (x, label, times) over all rows, an array of a fixed length; zeros don't travel."""
    dtype = np.int64 if kind == "long" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, length = None, 0
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                now = f(x, part.column("_y").to_numpy(), part.column("_n").to_numpy())
                total, length = now if total is None else total + now, len(now)
        if total is not None:
            at = np.append(np.flatnonzero(total[:-1]), length - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].astype(dtype))], ["slot", "v"])

    got = rows.mapInArrow(run, f"slot int, v {kind}").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(max(got["slot"].to_pylist(), default=-1) + 1, dtype)
    out[got["slot"].to_numpy()] = got["v"].to_numpy()
    return out


def _moments(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.concatenate([n @ x, n @ (x * x), [n[y == 0].sum(), n[y == 1].sum(), 1.0]])


def _by_bin(w: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Of each label and bin of the score: rows, sums of features and of products of two."""
    i, j = np.triu_indices(len(w) + 1)

    def run(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = np.rint(np.clip((x - centre) / scale, -6, 6) * ONE).astype(np.int64)
        at = np.clip(np.floor(z @ w / ONE / WIDTH) + BINS // 2, 0, BINS - 1).astype(np.int64) + BINS * y
        order = np.argsort(at, kind="stable")
        z, at, n = np.column_stack([np.ones(len(z), np.int64), z])[order], at[order], n[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out = np.zeros((2 * BINS, len(i)), np.int64)
        out[at[first]] = np.add.reduceat(z[:, i] * (z[:, j] * n[:, None]), first)
        return out.ravel()

    return run


def _newton(sums: np.ndarray, w: np.ndarray, decay: float) -> tuple[float, np.ndarray, float]:
    """Mean loss of all pairs at w, the next w, and the deviation of the scores, from the sums by label and bin."""
    k = len(w)
    i, j = np.triu_indices(k + 1)
    flat = np.zeros(2 * BINS * len(i))
    flat[: len(sums)] = sums
    m = np.zeros((2, BINS, k + 1, k + 1))
    m[:, :, i, j] = m[:, :, j, i] = flat.reshape(2, BINS, -1)
    m[:, :, 1:, :] /= ONE
    m[:, :, :, 1:] /= ONE
    n, z, zz = m[:, :, 0, 0], m[:, :, 0, 1:], m[:, :, 1:, 1:]
    s = z @ w / np.maximum(n, 1)
    d = s[1][:, None] - s[0][None, :]  # of each pair of bins, label 1 first
    pairs = n[1][:, None] * n[0][None, :] / (n[1].sum() * n[0].sum())
    wrong = 1 / (1 + np.exp(np.clip(d, -500, 500)))
    loss = float((pairs * np.logaddexp(0, -d)).sum() + decay / 2 * w @ w)
    pull, bend = pairs * wrong, pairs * wrong * (1 - wrong)
    mean = z / np.maximum(n, 1)[:, :, None]
    slope = -(pull.sum(axis=1) @ mean[1] - pull.sum(axis=0) @ mean[0]) + decay * w
    own = lambda c, axis: np.tensordot(bend.sum(axis=axis) / np.maximum(n[c], 1), zz[c], 1)
    cross = mean[1].T @ bend @ mean[0]
    curve = own(1, 1) + own(0, 0) - cross - cross.T + decay * np.eye(k)
    every, total = zz.sum(axis=(0, 1)), n.sum()
    middle = z.sum(axis=(0, 1)) @ w / total
    return loss, w - np.linalg.solve(curve, slope), float(np.sqrt(max(w @ every @ w / total - middle**2, 0.0)))


def _ranked(rows: DataFrame, k: int, w: np.ndarray, centre: np.ndarray, scale: np.ndarray, bins: int = 1024) -> tuple[float, float]:
    """The k-th and the next training score, from 1, exactly: counts, least and largest of bins, and again within a bin that holds both."""
    lo, hi, below = -6 * float(np.abs(w).sum()) - 1, 6 * float(np.abs(w).sum()) + 1, 0
    while True:
        a, b = lo, hi

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                s = (np.clip((x - centre) / scale, -6, 6) * w).sum(axis=1)
                n, inside = part.column("_n").to_numpy(), (s >= a) & (s <= b)
                s, n = s[inside], n[inside]
                at = np.minimum(((s - a) / max(b - a, 1e-300) * bins).astype(np.int64), bins - 1)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n), pa.array(s)], ["bin", "n", "s"])

        got = rows.mapInArrow(run, "bin long, n long, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").toPandas()
        upto = below + got["n"].to_numpy().cumsum()
        first, second = int(np.searchsorted(upto, k)), int(np.searchsorted(upto, k + 1))
        if first != second:
            return float(got["high"][first]), float(got["low"][second])
        if got["low"][first] == got["high"][first]:
            return float(got["low"][first]), float(got["low"][first])
        below = int(upto[first - 1]) if first else below
        lo, hi = float(got["low"][first]), float(got["high"][first])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", steps: int = 30, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float] | None:
    """Mean, scale, weights, threshold and width, from all labels that aren't held out; None without both kinds."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id", F.col(label).cast("long").alias("_y")).agg(F.count("*").alias("_n"))
    scope = store.Scope(docs.sparkSession)
    try:
        with scope:
            rows = store.save(_featured(docs.where(F.col("doc_id").isNotNull() & ~held_out()), ["doc_id"]).join(known, "doc_id").select("_y", "_n", "x"), "labelled")
        return _fitted(rows, steps, decay)
    finally:
        scope.drop()


def _fitted(rows: DataFrame, steps: int, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float] | None:
    sums = _totals(rows, _moments, "double")
    if not len(sums) or not sums[-3] or not sums[-2]:
        return None
    n = sums[-3] + sums[-2]
    digits = lambda v: np.array([float(f"{x:.9g}") for x in v])  # noqa: E731  whatever the order of the sums
    centre, squares = np.split(sums[:-3] / n, 2)
    centre, scale = digits(centre), digits(np.sqrt(np.maximum(squares - centre**2, 0))) + 1e-6
    best, good, w = np.inf, np.zeros(len(centre)), np.zeros(len(centre))
    for _ in range(steps):
        loss, new, dev = _newton(_totals(rows, _by_bin(w, centre, scale)), w, decay)
        if loss > 1.001 * best:  # too far
            w = (good + w) / 2
            continue
        gain = best - loss
        if loss < best:
            best, good, width = loss, w, dev
        if gain < 1e-3 * loss:
            break
        w = new
    k = min(max(int(round(sums[-3])), 1), int(n) - 1)
    return centre, scale, good, float(np.mean(_ranked(rows, k, good, centre, scale))), width / 2 + 1e-9


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score (0 to 1) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textnp.chunks(batches, max_bytes=1 << 20):
            if shared.value is None:
                s = np.full(b.num_rows, 0.5)
            else:
                centre, scale, w, threshold, width = shared.value
                z = np.clip((features(*textnp.buffer_of(b.column("text"))) - centre) / scale, -6, 6)
                s = 1 / (1 + np.exp(-(z @ w - threshold) / width))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
