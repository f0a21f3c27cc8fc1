"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles.  Equal sets are one class
and one representative joins for it.  Shingles are ordered by how many
documents have them, so that a document's prefix holds its rarest ones; the
l-prefix of a set of n has n - ceil(t n) + l shingles, and two sets of
similarity t or more share at least min(l, l') shingles of these prefixes.
Each document picks the l of the least estimated cost: looking up its prefix
(the sum of its shingles' document counts) and verifying what shares l of them
(at most that sum divided by l).

Where at most ``LONG`` documents share a prefix shingle, every two of them are
counted and verified when they share enough.  Longer lists would make a
candidate of every pair of a group of near copies.  Each of their documents is
verified with the most central document of its longest-shared list first; two
documents that are linked with the same centre need no look at each other.  All
others are dealt into blocks around these centres, linked ones apart, and every
two blocks that meet in a list are joined by counting in one task, unless both
hold linked documents of one centre; a task returns only the links that connect
something new.  Blocks are split by documents and by shingles.  Nothing is
capped: a pair that the prefixes allow is verified or already connected.

Rows are told apart by a key of id and text, which null ids have too; ids only
name the classes and components that are found by it.  Classes and components
that hold a thousandth of the rows, a thousand at most, are looked up by
broadcast, so that no task gets all copies of one text.

Defined results: texts without words (null, empty) have an empty set, linked
with nothing; with fewer words than a shingle the whole sequence is the one
shingle; texts of any length are shingled whole; ties in frequency are ordered
by the shingle's hash, and ties between names go to the least id; rows without
an id are joined like others, never name a class or component that has a row
with one, and leave the name null where there is no such row; rows that share
an id share a component in ``join``, but are apart in ``survivors`` unless
their texts are alike; of repeated rows one survives; empty tables give empty
results; extra columns of any name are ignored, or pass through ``survivors``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm import store, textnp
from folioframe.llm.components import components, looked_up
from folioframe.llm.exchange import counts, cuts, dealt, pack_plain, pack_sorted, text_bytes, unpack_plain, unpack_sorted

LONG, BLOCK, MAX_MATCHES, VERIFY_COST, GROUP = 24, 1024, 8, 20.0, 128
SHINGLES = 1 << 20  # in a block or a part, so that a task's texts stay small
_PRINT = 40
INFO = "doc_id long, id long, n long, k1 long, k2 long, own long, l int, tokens array<long>, levels array<int>"


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after another, and where each begins (one more than rows)."""
    starts, ends, before = textnp.word_spans(raw, off)
    words = textnp.word_hashes(raw, starts, ends, lower=True)
    n = np.diff(before)
    full = np.maximum(n - width + 1, 0)
    row = np.repeat(np.arange(len(n)), full)
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + before[row]
    h = textnp.window_hashes(words, at, width)
    few = np.flatnonzero((n > 0) & (n < width))
    for k in range(1, width):
        some = few[n[few] == k]
        row, h = np.append(row, some), np.append(h, textnp.window_hashes(words, before[some], k) + np.uint64(k))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """INFO of each row (doc_id, id, text): set size, two sums that stand for the set, l, and the prefix shingles that more than one document has, with their levels."""
    chunks, buckets = counts(docs, text_bytes(docs))

    def prints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(h >> np.uint64(64 - _PRINT), return_inverse=True, return_counts=True)

    def send(table: pa.Table) -> pa.Table:
        h, _ = shingle_sets(*textnp.buffer_of(_ordered(table).column("text").combine_chunks()), width)
        p, _, n = prints(h)
        edge = cuts(p, buckets, _PRINT)
        chunk = table.column("chunk")[0].as_py()
        rows = [(k, chunk, pack_sorted(p[a:b]), pack_plain(n[a:b], "<u4")) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "prints", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        p, n = [unpack_sorted(r["prints"]) for r in rows], np.concatenate([unpack_plain(r["counts"], "<u4") for r in rows])
        _, of = np.unique(np.concatenate(p), return_inverse=True)
        total = np.bincount(of, n)[of]
        edge = np.cumsum([0, *map(len, p)])
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array([pack_plain(total[a:b], "<u4") for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["chunk", "bucket", "counts"])

    def apply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            table = _ordered(left)
            h, edge = shingle_sets(*textnp.buffer_of(table.column("text").combine_chunks()), width)
            _, of, _ = prints(h)
            known = [unpack_plain(r["counts"], "<u4") for r in sorted(right.to_pylist(), key=lambda r: r["bucket"])]
            df = np.concatenate([*known, np.zeros(0, np.uint32)]).astype(np.int64)[of]
            second = textnp.mix(h + np.uint64(77))
            for doc, name, a, b in zip(table.column("doc_id").to_pylist(), table.column("id").to_pylist(), edge[:-1], edge[1:], strict=True):
                n = int(b - a)
                if not n:
                    out.append((doc, name, 0, 0, 0, 0, 1, [], []))
                    continue
                need = (percent * n + 99) // 100
                most = min(MAX_MATCHES, need)
                base = n - need + 1
                d, x = df[a:b], h[a:b]
                order = np.lexsort((x, d))[: base + most - 1]
                cost = np.cumsum(d[order] - 1)[base - 1 :]
                l = int(np.argmin(cost * (1 + VERIFY_COST / np.arange(1, most + 1)))) + 1  # noqa: E741
                use = order[: base + l - 1]
                level = np.maximum(np.arange(len(use)) - base + 2, 1)
                shared = d[use] > 1
                out.append((doc, name, n, int(x.sum().astype(np.int64)), int(second[a:b].sum().astype(np.int64)), int((d == 1).sum()), l, x[use][shared].astype(np.int64), level[shared].astype(np.int32)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "id", "n", "k1", "k2", "own", "l", "tokens", "levels"])

    base = dealt(docs, chunks, "id")
    sent = base.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, prints binary, counts binary")
    counted = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merge, "chunk int, bucket int, counts binary").repartition(chunks, "chunk")
    return base.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(apply, INFO)


SAME = ["n", "k1", "k2", "lone"]


def groups(docs: DataFrame, width: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """INFO of each row by its key, and of each class (SAME) its least row (best: none, id, key), that of its component (least) and the component's root.

    by_id: rows that share an id are linked too.
    """
    docs = docs.select(store.row_key().alias("doc_id"), F.col("doc_id").cast("long").alias("id"), "text")
    info = store.save(prefixes(docs, width, percent), "prefixes")
    info = info.withColumn("lone", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(0))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("doc_id").alias("key")))
    classes = store.save(info.groupBy(*SAME).agg(F.min("doc_id").alias("class"), best.alias("best"), F.count("*").alias("rows")), "classes")
    total = info.count()
    lists = (
        info.join(classes.where("n > 0").select(F.col("class").alias("doc_id")), "doc_id", "left_semi")
        .select("doc_id", "n", "own", "l", F.explode(F.arrays_zip("tokens", "levels")).alias("t"))
        .select("doc_id", "n", "own", "l", F.col("t.tokens").alias("token"), F.col("t.levels").alias("level"))
    )
    central = F.min(F.struct((F.col("own") / F.col("n")).alias("r"), F.xxhash64("doc_id").alias("o"), "doc_id"))
    several = lists.groupBy("token").agg(F.count("*").alias("k"), central["doc_id"].alias("centre")).where("k > 1")
    lists = store.save(lists.join(several, "token").select("token", "doc_id", "n", "l", "level", "k", "centre"), "lists")

    short = lists.where(F.col("k") <= LONG)
    one = short.select("token", *(F.col(c).alias(f"{c}1") for c in ("doc_id", "n", "l", "level")))
    two = short.select("token", *(F.col(c).alias(f"{c}2") for c in ("doc_id", "n", "l", "level")))
    matches = F.least("l1", "l2")
    pairs = (
        one.join(two, "token")
        .where((F.col("doc_id1") < F.col("doc_id2")) & (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent) & (F.greatest("level1", "level2") <= matches))
        .groupBy(F.col("doc_id1").alias("a"), F.col("doc_id2").alias("b"))
        .agg(F.count("*").alias("c"), F.min(matches).alias("l"), F.max("n2").alias("n"))
        .where("c >= l")
        .select("a", "b", "n")
    )
    long = lists.where(F.col("k") > LONG)
    home = long.groupBy("doc_id", "centre").agg(F.count("*").alias("c"), F.max("n").alias("n")).groupBy("doc_id").agg(F.max_by("centre", F.struct("c", "centre")).alias("centre"), F.max("n").alias("n"))
    home = store.save(home, "home")
    first = store.save(pairs.union(home.where("doc_id <> centre").select("centre", "doc_id", "n")), "pairs")
    found = store.save(links(docs, partners(first), width, percent, many=True), "links")
    found = found.union(links(docs, blocks(long.select("token", "doc_id"), home, found), width, percent))
    if by_id:
        names = looked_up(info.where("id IS NOT NULL"), classes.select(*SAME, "class", "rows"), SAME, total)
        named = names.select("id", "class").distinct()
        several = named.groupBy("id").agg(F.min("class").alias("a"), F.count("*").alias("c")).where("c > 1").select("id", "a")
        found = found.union(named.join(several, "id").where("class <> a").select("a", F.col("class").alias("b")))
    of = classes.join(components(found), F.col("class") == F.col("id"), "left").select(*SAME, "best", F.col("rows").alias("of_class"), F.coalesce("root", "class").alias("root"))
    of = store.save(of, "rooted")
    roots = of.groupBy("root").agg(F.min("best").alias("least"), F.count("*").alias("rows"))
    return info, looked_up(of, store.save(roots, "roots"), ["root"], total).withColumnRenamed("of_class", "rows")


def join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, class_id (least id with the same set) and component_id (least id reachable by links) of each row."""
    info, of = groups(docs, width, percent, by_id=True)
    return looked_up(info, of, SAME, info.count()).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("best.id").alias("class_id"), F.col("least.id").alias("component_id"))


def survivors(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row of each component of docs, whole: that of the least id, a row without an id only where none has one."""
    _, of = groups(docs, width, percent, by_id=False)
    keys = store.save(of.select(F.col("least.key").alias("_key")).distinct(), "survivors")
    name = store.free("_key", docs.columns)
    chosen = docs.withColumn(name, store.row_key()).join(keys.withColumnRenamed("_key", name), name, "left_semi")
    return chosen.dropDuplicates([name]).drop(name)


def partners(pairs: DataFrame) -> DataFrame:
    """Tasks (kind, x, y, side, doc_id) that join each a of pairs (a, b, n: shingles of b) with its partners; many partners are split, each part with a copy of a."""
    parts = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / SHINGLES)).alias("_g"), F.count("*").alias("rows"))
    member = looked_up(pairs, store.save(parts, "parts"), ["a"], pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.col("_g")).alias("y"))
    head = member.select("a", "y").distinct()
    return head.select(F.lit(0).alias("kind"), F.col("a").alias("x"), "y", F.lit(0).alias("side"), F.col("a").alias("doc_id")).union(member.select(F.lit(0), "a", "y", F.lit(1), "b"))


def blocks(lists: DataFrame, home: DataFrame, found: DataFrame) -> DataFrame:
    """Tasks (kind, x, y, side, doc_id) that join the documents of every two blocks that meet in a token of lists (token, doc_id).

    home: the centre of each document (doc_id, centre, n); found: links (a, b),
    of which those with the centre set a document apart from the unlinked ones.
    """
    star = found.select(F.col("a").alias("centre"), F.col("b").alias("doc_id"), F.lit(True).alias("linked")).distinct()
    home = home.join(star, ["centre", "doc_id"], "left").withColumn("linked", F.coalesce("linked", F.col("doc_id") == F.col("centre")))
    sizes = home.groupBy("centre", "linked").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES)).alias("_b"))
    home = home.join(sizes, ["centre", "linked"]).select("doc_id", "centre", "linked", F.xxhash64("centre", "linked", F.pmod(F.xxhash64("doc_id"), F.col("_b"))).alias("block"))
    home = store.save(home, "blocks")
    met = lists.join(home, "doc_id").select("token", "block", "centre", "linked").distinct()
    other = met.select("token", F.col("block").alias("block2"), F.col("centre").alias("centre2"), F.col("linked").alias("linked2"))
    meet = met.join(other, "token").where((F.col("block") <= F.col("block2")) & ~(F.col("linked") & F.col("linked2") & (F.col("centre") == F.col("centre2"))))
    meet = store.save(meet.select("block", "block2").distinct(), "meet")
    first = meet.select(F.col("block").alias("x"), F.col("block2").alias("y"), F.lit(0).alias("side"), "block")
    second = meet.where("block <> block2").select("block", "block2", F.lit(1), "block2")
    return home.select("doc_id", "block").join(first.union(second), "block").select(F.lit(1).alias("kind"), "x", "y", "side", "doc_id")


def links(docs: DataFrame, asked: DataFrame, width: int, percent: int, many: bool = False) -> DataFrame:
    """Links that connect all pairs of percent or more between the sides of each task, or within a task of one side.

    Texts are looked up once, and travel to each of their tasks; many: by a
    shuffle at any size, as most texts are asked for in a large corpus.
    """

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        h, edge = shingle_sets(*textnp.buffer_of(table.column("text").combine_chunks()), width)
        size, ids, side = np.diff(edge), table.column("doc_id").to_numpy(), table.column("side").to_numpy()
        _, of, df = np.unique(h, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(size)), size)
        posting = row[np.argsort(of, kind="stable")]
        begin = np.cumsum(df) - df
        own = np.arange(len(size))
        twice = bool(side.max(initial=0))
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero((side == 0) & (size > 0)):
            t = of[edge[i] : edge[i + 1]]
            t = t[df[t] > 1]
            n = df[t]
            at = np.repeat(begin[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(posting[at], minlength=len(size))
            hit = (100 * both >= percent * (size[i] + size - both)) & (both > 0) & (own != own[i])
            hit &= (side == 1) if twice else (np.arange(len(size)) > i)
            found = np.flatnonzero(hit)
            if len(found):
                labels, where = np.unique(own[found], return_index=True)
                out += [(int(ids[i]), int(ids[j])) for j in found[where]]
                own[np.isin(own, labels)] = own[i]
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])

    asked = store.save(asked, "asked")  # a size that the planner knows
    if many:
        asked = asked.hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(asked, "doc_id").groupBy("kind", "x", "y").applyInArrow(count, "a long, b long")
