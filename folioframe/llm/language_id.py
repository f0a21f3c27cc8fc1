"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points: letters and their marks lower-cased, everything else
a blank.  Counts of hashed n-grams of one to three of them are added up over all
labelled training rows by Spark; the matrix of log-probabilities has
``buckets`` x languages cells of four bytes whatever the corpus (64 KB a
language) and is broadcast.  Scoring adds up the rows of the matrix for a
document's n-grams.  The posterior of some hundred n-grams is near one, so a
score below one half means a text of a few letters or an even mixture.

Defined results: ``und`` with score 0 where the text is null or has no letter,
or nothing could be learnt; a text of any length is scored whole, in a slice of
its own beyond a megabyte; rows without an id are never learnt from and have no
``held_out``; empty tables give empty results; repeated rows are scored each;
ties go to the language first in order; extra columns of any name are ignored,
or pass through ``accepted`` unchanged.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm import textnp

ORDERS, BUCKETS = (1, 2, 3), 1 << 14
_BLANK = 32


@cache
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case where it is a letter or mark, else a blank; whether it is a letter."""
    fold, letter = np.full(0x110000, _BLANK, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            fold[c], letter[c] = ord(low) if len(low) == 1 else c, kind == "L"
    return fold, letter


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _grams(points: np.ndarray, off: np.ndarray, orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each order n: bucket of the n-gram at each code point, where each document's first stands (one more than rows), n."""
    code = textnp.mix(_fold()[0][points].astype(np.uint64))
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(orders) + 1):
        h = (h[: len(code) - n + 1] if n > 1 else h) * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in orders:
            at = np.minimum(off, len(h))
            ids = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) & (buckets - 1)
            yield ids, at, n


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices with the code points of their texts and where each begins (one more than rows)."""
    for b in textnp.chunks(batches, max_bytes=1 << 20):
        raw, off = textnp.buffer_of(b.column("text"))
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        before = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
        yield b, points, before[off]


def fit(docs: DataFrame, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-priors and the matrix of log-probabilities, from every row of docs with text and lang (the caller chooses the training rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b, points, off in _slices(batches):
            langs = np.array(b.column("lang").to_pylist(), object)
            names, which = np.unique(langs, return_inverse=True)
            for k, name in enumerate(names):
                total.setdefault(name, np.zeros(buckets + 1, np.int64))[buckets] += int((which == k).sum())
            for ids, _, n in _grams(points, off, orders, buckets):
                of, ends = np.repeat(which, np.diff(off))[: len(ids)], np.repeat(off[1:], np.diff(off))[: len(ids)]
                own = np.arange(n, len(ids) + n) <= ends  # within one document
                found = np.bincount((of * buckets + ids)[own], minlength=len(names) * buckets).reshape(len(names), buckets)
                for k, name in enumerate(names):
                    total[name][:buckets] += found[k]
        for name, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(v[at])], ["lang", "bucket", "n"])

    seen = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    rows = seen.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(rows["lang"]))
    counts = np.zeros((len(names), buckets + 1))
    counts[np.searchsorted(np.array(names, object), rows["lang"].to_numpy(object)) if names else [], rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    prior = np.log(counts[:, buckets] / max(1.0, counts[:, buckets].sum())) if names else np.zeros(0)
    grams = counts[:, :buckets] + smoothing
    return names, prior, np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)


def _scored(batches: Iterator[pa.RecordBatch], model: tuple[list[str], np.ndarray, np.ndarray], orders: tuple[int, ...]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    names, prior, matrix = model
    kinds = len(names)
    for b, points, off in _slices(batches):
        size = np.diff(off)
        pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
        if kinds and len(points):
            total = np.zeros((b.num_rows, kinds))
            for ids, at, n in _grams(points, off, orders, len(matrix)):
                count, lo = np.maximum(size - n + 1, 0), at[:-1]
                for k in range(kinds):
                    upto = np.zeros(len(ids) + 1)
                    np.cumsum(matrix[ids, k], dtype=np.float64, out=upto[1:])
                    total[:, k] += np.where(count > 0, upto[np.minimum(lo + count, len(ids))] - upto[lo], 0)
            logp = total + prior
            logp -= logp.max(axis=1, keepdims=True)
            best = logp.argmax(axis=1)
            p = 1 / np.exp(logp).sum(axis=1)
            letters = np.zeros(len(points) + 1, np.int64)
            np.cumsum(_fold()[1][points], out=letters[1:])
            some = letters[off[1:]] > letters[off[:-1]]
            for i in np.flatnonzero(some):
                pred[i], score[i] = names[best[i]], p[i]
        yield b, pred, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """doc_id, lang_pred and score (the posterior) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pred, score in _scored(batches, shared.value, orders):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], least: float = 0.5, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """The rows of docs, with all their columns, whose language is found with a score of least or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pred, score in _scored(batches, shared.value, orders):
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(pred, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Predictions for every row of docs, learnt from its rows that aren't held out."""
    return predict(docs, fit(docs.where(~held_out())))
