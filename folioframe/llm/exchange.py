"""Sorted fingerprint blobs between chunks of documents and buckets of hashes.

Rows are dealt by a hash of id and text into chunks.  A chunk sends, for each
bucket of the hash space, one row: its sorted fingerprints (differences in
bytes) and what goes with them.  Buckets merge the rows of all chunks and send
one answer per chunk and bucket back; the chunk, which finds the same order
again, applies it.  Rows stay few and small, no hash makes a row of its own.

The numbers of chunks and buckets follow the input's bytes, so that neither a
chunk's text nor what meets in a bucket grows with the corpus.  The rows between
them are chunks x buckets, some hundred windows each at a terabyte; beyond it,
larger executors should take larger chunks.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import store


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed differences."""
    d = np.diff(values, prepend=values[:1] * 0).astype("<u8")
    wide = int(d.max(initial=0)) >= 1 << 32
    return (b"\1" if wide else b"\0") + pack_plain(d, "<u8" if wide else "<u4")


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_plain(blob[1:], "<u8" if blob[0] else "<u4"), dtype=np.uint64)


def pack_plain(values: np.ndarray, kind: str) -> bytes:
    v = np.ascontiguousarray(values.astype(kind))
    return zstandard.compress(v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes(), 1)


def unpack_plain(blob: bytes, kind: str) -> np.ndarray:
    raw = zstandard.decompress(blob)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).view(kind).ravel()


#: Bytes of text in a chunk (``folioframe.chunk.bytes`` overrides it), and of text behind a bucket's
#: fingerprints: a Python worker takes some 60 times the one and 10 times the other.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 24 << 20


def text_bytes(docs: DataFrame) -> int:
    """The bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def counts(docs: DataFrame, size: int) -> tuple[int, int]:
    """Chunks and buckets for texts of that many bytes: at least the session's shuffle partitions."""
    least = store.parts(docs.sparkSession)
    chunk = int(docs.sparkSession.conf.get("folioframe.chunk.bytes", str(CHUNK_BYTES)))
    return max(least, -(-size // chunk)), max(least, -(-size // BUCKET_BYTES))


def dealt(docs: DataFrame, chunks: int, *extra: str) -> DataFrame:
    """doc_id, text, extra columns and their chunk, in as many partitions as chunks."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra)
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")


def cuts(values: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted values of that many bits (one more than buckets)."""
    edges = [(k << bits) // buckets for k in range(buckets)]
    return np.append(np.searchsorted(values, np.array(edges, np.uint64)), len(values))
