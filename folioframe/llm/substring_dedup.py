"""Substring dedup over a log-structured fingerprint index.

The index is a list of immutable runs.  A run holds, for each bucket of the
hash space, the sorted 48-bit fingerprints of all windows of a batch, each
with 32 check bits of an independent hash.  A new batch sends its own sorted
fingerprints to the buckets, where they are merge-joined with all runs; a
match counts once the check bits agree too, 80 bits in all.  The batch's new
fingerprints become a run, and runs are compacted into one when there are more
than ``fan_in``.  With a ``path`` the runs and a list of them stay there, and
``SubstringIndex.open`` goes on with them in another session.

A window is removed if it starts in an earlier batch or, within the batch, in
a document with a smaller id.  Batches must come in the order that decides
which copy stays.  Windows are judged on the input, not on what is left.

Defined results: null and empty texts have no words; texts shorter than the
window lose nothing; a text of any length stands in one chunk, whole; rows
without an id count as last and never own a window against a row with one; rows
with equal ids, repeated or not, don't remove each other's words; ties need no
order; empty tables give empty results; extra columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import store, textnp
from folioframe.llm.exchange import BUCKET_BYTES, counts, cuts, dealt, pack_plain, pack_sorted, text_bytes, unpack_plain, unpack_sorted

WINDOW, BITS = 13, 48
_SIGN = np.uint64(1 << 63)
_LAST = np.int64((1 << 63) - 1)
ROW = "kind int, bucket int, chunk int, n long, prints binary, checks binary, owners binary, ids binary"
_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("prints", pa.binary()), ("checks", pa.binary()), ("owners", pa.binary()), ("ids", pa.binary())])


class _Chunk:
    """The windows of a chunk of documents, in an order that depends on its rows alone."""

    def __init__(self, table: pa.Table, width: int) -> None:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.table = table
        ids = table.column("doc_id").combine_chunks()
        key = ids.fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids, self.rank = np.unique(key, return_inverse=True)
        text = table.column("text").combine_chunks()
        self.raw, self.off = textnp.buffer_of(text)
        self.starts, self.ends, self.before = textnp.word_spans(self.raw, self.off)
        words = textnp.word_hashes(self.raw, self.starts, self.ends)
        n = np.maximum(np.diff(self.before) - width + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.before[row]
        prints = textnp.window_hashes(words, at, width) >> np.uint64(64 - BITS)
        order = np.argsort(prints, kind="stable")
        checks = textnp.window_hashes(words, at, width, check=True)
        self.at, self.owner = at[order], self.rank[row[order]]
        self.prints, self.checks = prints[order], checks[order]

    def group(self, kind: str) -> None:
        """Windows of equal prints and checks; the first has the smallest owner."""
        checks = self.checks.astype(kind)
        again = np.flatnonzero(self.prints[1:] == self.prints[:-1])
        if len(again):  # equal prints are few: only they need an order by checks
            touched = np.unique(np.concatenate([again, again + 1]))
            best = touched[np.lexsort((self.owner[touched], checks[touched], self.prints[touched]))]
            for name in ("at", "owner", "prints"):
                v = getattr(self, name)
                v[touched] = v[best]
            checks[touched] = checks[best]
        new = np.ones(len(checks), bool)
        new[1:] = (self.prints[1:] != self.prints[:-1]) | (checks[1:] != checks[:-1])
        self.checks, self.first, self.of = checks, np.flatnonzero(new), np.cumsum(new) - 1


def _row(kind: int, bucket: int, chunk: int, n: int, prints: bytes, checks: bytes = b"", owners: bytes = b"", ids: bytes = b"") -> tuple:
    return kind, bucket, chunk, n, prints, checks, owners, ids


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


class SubstringIndex:
    """Historical windows of ``width`` words, and the removal of those that a new batch repeats.

    size: bytes of text that the index is to hold in all, by which its buckets are counted.
    """

    def __init__(self, spark: SparkSession, width: int = WINDOW, check: str = "<u4", fan_in: int = 4, size: int = 0, path: str | None = None) -> None:
        self.spark, self.width, self.check, self.fan_in, self.path = spark, width, check, fan_in, path
        self.buckets = max(store.parts(spark), -(-size // BUCKET_BYTES))
        self.runs: list[DataFrame] = []
        self.names: list[str] = []
        self._files: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SubstringIndex:
        """The index that an earlier session left at path."""
        last = spark.read.schema("version int, width int, check string, fan_in int, buckets int, names array<string>").parquet(f"{path}/index").orderBy(F.desc("version")).first()
        index = cls(spark, last["width"], last["check"], last["fan_in"], path=path)
        index.buckets, index.version, index.names = last["buckets"], last["version"], list(last["names"])
        index.runs = [spark.read.schema(ROW).parquet(f"{path}/{name}") for name in index.names]
        return index

    def _keep(self, runs: list[DataFrame], added: DataFrame) -> None:
        """runs and one more are the index now; at a path the list is appended to once the run is written, so a lost write leaves the old one."""
        self.version += 1
        names = self.names[: len(runs)]
        if self.path:
            names.append(f"run-{self.version}")
            added.write.mode("overwrite").parquet(f"{self.path}/{names[-1]}")
            added = self.spark.read.schema(ROW).parquet(f"{self.path}/{names[-1]}")
            state = [(self.version, self.width, self.check, self.fan_in, self.buckets, names)]
            self.spark.createDataFrame(state, "version int, width int, check string, fan_in int, buckets int, names array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/index")
        self.names, self.runs = names, [*runs, added]

    def add(self, docs: DataFrame, keep: bool = True, size: int | None = None) -> DataFrame:
        """doc_id, n_words, n_removed and kept (the text's other words, joined by a blank) of each row of the batch; keep: its windows join the index; size: bytes of its text, counted where not given."""
        width, check, buckets = self.width, self.check, self.buckets
        chunks, _ = counts(docs, text_bytes(docs) if size is None else size)

        def send(table: pa.Table) -> pa.Table:
            c = _Chunk(table, width)
            c.group(check)
            prints, checks, owner = c.prints[c.first], c.checks[c.first], c.owner[c.first]
            edge = cuts(prints, buckets, BITS)
            ids = c.ids.astype(np.uint64) ^ _SIGN
            packed = pack_sorted(ids)
            chunk = table.column("chunk")[0].as_py()
            rows = []
            for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                if b > a:  # ids go along once, or each with its window where those are fewer
                    own = (pack_plain(owner[a:b], "<u4"), packed) if b - a > len(ids) else (pack_plain(ids[owner[a:b]], "<u8"), b"")
                    rows.append(_row(0, k, chunk, int(b - a), pack_sorted(prints[a:b]), pack_plain(checks[a:b], check), *own))
            return _table(rows)

        def merge(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            fresh = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["chunk"])
            old = [r for r in rows if r["kind"] == 1]
            if not fresh:
                return _table([])
            bucket = rows[0]["bucket"]
            prints = np.concatenate([unpack_sorted(r["prints"]) for r in [*old, *fresh]])
            checks = np.concatenate([unpack_plain(r["checks"], check) for r in [*old, *fresh]])
            history = sum(r["n"] for r in old)
            owner = [np.zeros(history, np.uint64)]
            for r in fresh:
                owner.append(unpack_sorted(r["ids"])[unpack_plain(r["owners"], "<u4")] if r["ids"] else unpack_plain(r["owners"], "<u8"))
            owner = np.concatenate(owner)
            order = np.lexsort((checks, prints))
            new = np.ones(len(order), bool)
            p, q = prints[order], checks[order]
            new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            first, of = np.flatnonzero(new), np.cumsum(new) - 1
            known = np.logical_or.reduceat(order < history, first)
            least = np.minimum.reduceat(np.where(order < history, ~np.uint64(0), owner[order]), first)
            hit = np.empty(len(order), bool)
            hit[order] = known[of] | (least[of] < owner[order])
            out, at = [], history
            for r in fresh:
                out.append(_row(2, bucket, r["chunk"], r["n"], np.packbits(hit[at : at + r["n"]]).tobytes()))
                at += r["n"]
            if keep:
                fresh_at = first[~known]
                out.append(_row(1, bucket, -1, len(fresh_at), pack_sorted(p[fresh_at]), pack_plain(q[fresh_at], check)))
            return _table(out)

        def apply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            c = _Chunk(left, width) if left.num_rows else None
            kinds = [pa.int64(), pa.int64(), pa.string()]
            if c is None:
                return pa.table([pa.array([], pa.int64()), *(pa.array([], k) for k in kinds)], names=["doc_id", "n_words", "n_removed", "kept"])
            c.group(check)
            hit = [np.unpackbits(np.frombuffer(r["prints"], np.uint8), count=r["n"]) for r in sorted(right.to_pylist(), key=lambda r: r["bucket"])]
            hit = np.concatenate([*hit, np.zeros(0, np.uint8)]).astype(bool)
            gone = (hit[c.of] | (c.owner > c.owner[c.first][c.of])) if len(c.first) else np.zeros(0, bool)
            words = len(c.starts)
            step = np.bincount(c.at[gone], minlength=words + width) - np.bincount(c.at[gone] + width, minlength=words + width + 1)[: words + width]
            covered = np.cumsum(step)[:words] > 0
            total = np.append(0, np.cumsum(covered))
            n, removed = np.diff(c.before), total[c.before[1:]] - total[c.before[:-1]]
            data, kept = c.raw.tobytes(), []
            for i in range(len(n)):
                split = data[c.off[i] : c.off[i + 1]].split() if removed[i] < n[i] else []
                if split and removed[i]:
                    split = [w for w, x in zip(split, covered[c.before[i] : c.before[i + 1]].tolist(), strict=True) if not x]
                kept.append(b" ".join(split).decode("utf-8"))
            return pa.table([c.table.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

        base = dealt(docs, chunks)
        sent = base.groupBy("chunk").applyInArrow(send, ROW)
        for r in self.runs:
            sent = sent.unionByName(r)
        met = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merge, ROW)
        merged, path = store.saved(met, "run", partitions=["kind"])
        merged = merged.select(*ROW.replace(",", "").split()[::2])
        if keep:
            self._files.append(f"{path}/kind=1")
            self._keep(self.runs, merged.where("kind = 1"))
            if len(self.runs) > self.fan_in:
                self.compact()
        answers = merged.where("kind = 2").select("chunk", "bucket", "n", "prints")
        answers = answers.repartition(chunks, "chunk")
        return base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")

    def compact(self) -> None:
        """All runs as one; their fingerprints are disjoint, so a bucket is a merge of sorted lists."""
        check = self.check

        def join(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            prints = np.concatenate([unpack_sorted(r["prints"]) for r in rows])
            checks = np.concatenate([unpack_plain(r["checks"], check) for r in rows])
            order = np.lexsort((checks, prints))
            return _table([_row(1, rows[0]["bucket"], -1, len(order), pack_sorted(prints[order]), pack_plain(checks[order], check))])

        every = self.runs[0]
        for r in self.runs[1:]:
            every = every.unionByName(r)
        run, path = store.saved(every.repartition(self.buckets, "bucket").groupBy("bucket").applyInArrow(join, ROW), "compacted")
        self._keep([], run)
        for old in self._files:  # what it replaces; answers stand beside it
            store.delete(self.spark, old)
        self._files = [path]


def dedup(docs: DataFrame, batches: int = 3, width: int = WINDOW, fan_in: int = 1) -> DataFrame:
    """The whole table through the index in ``batches`` ranges of ids, smaller ids first."""
    docs = docs.select("doc_id", "text")
    seen = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [0.5]).alias("e"), F.sum(F.octet_length("text")).alias("size")).first()
    edges, size = sorted(set(seen["e"] or [])) if batches > 1 else [], int(seen["size"] or 0)
    index = SubstringIndex(docs.sparkSession, width, fan_in=fan_in, size=size)
    out = None
    for k in range(len(edges) + 1):
        part = docs
        if k:
            part = part.where((F.col("doc_id") > edges[k - 1]) | (F.col("doc_id").isNull() if k == len(edges) else F.lit(False)))
        if k < len(edges):
            part = part.where(F.col("doc_id") <= edges[k])
        done = index.add(part, keep=k < len(edges), size=size // batches)
        out = done if out is None else out.unionByName(done)
    return out
