"""Benchmark decontamination by SimHash windows, in DataFrame functions only.

Texts are runs of letters and digits, lower-cased; five words are a shingle.
Only windows that share a shingle with an item can be similar to it, so the
windows fingerprinted are those of an item's size laid where a shared shingle
stands in the item.  Fingerprints are 64-bit SimHashes of a window's shingles;
of four blocks of 16 bits at least one differs in three bits or fewer where two
fingerprints are within the radius of 15, so the items, which are few, stand in
a table of (size, block, bits) under all such values, the windows look up their
own four, and no pair within the radius is lost.  These pairs are verified by
weighted Jaccard similarity of the shingles (weights are their counts), at
``percent`` or more.  Items of equal shingles are one item until the end.

Defined results: items or documents with fewer words than a shingle match
nothing, nor do null or empty texts and rows or items without an id (callers
that must see such rows pass a key as ``doc_id``); a document shorter than an
item is one window; a text of any length is split once and its windows are
slices; of several windows for an item the most similar, then the first, is
reported; repeated rows and items count each once, rows that share an id
together; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm import store

SHINGLE, RADIUS, PARTS, PERCENT = 5, 15, 4, 80
#: Item shingles that may be broadcast (24 bytes each); beyond it the join shuffles.
MAX_BROADCAST = 1 << 20


def shingles(df: DataFrame, keep: list[str], width: int = SHINGLE) -> DataFrame:
    """keep, and s: the hashes of the text's shingles in order, none for fewer words.

    No filter stands on what is computed here: Catalyst would push it below the
    projections and compute their expressions once more.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    df = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    at = F.when(F.size("_h") >= width, F.sequence(F.lit(0), F.size("_h") - width)).otherwise(F.array().cast("array<int>"))
    return df.select(*keep, F.transform(at, lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(width)))).alias("s"))


def _each(s: str) -> Column:
    """Positions and elements; of a slice, as a filter on a bare column's size would be pushed down."""
    return F.posexplode(F.slice(s, 1, F.size(s)))


def simhash(s: Column) -> Column:
    """64 bits: each the majority of that bit over the shingles."""
    ones = lambda b: F.aggregate(s, F.lit(0), lambda n, h: n + (h.bitwiseAND(b) != 0).cast("int"))
    bits = [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    return F.aggregate(F.array(*(F.lit(b) for b in bits)), F.lit(0).cast("long"), lambda acc, b: F.when(2 * ones(b) > F.size(s), acc.bitwiseOR(b)).otherwise(acc))


def blocks(code: Column, parts: int = PARTS, errors: int = 0) -> Column:
    """(block, bits) of each of the parts of the code, and of all that differ from it in at most errors bits."""
    edge = [64 * k // parts for k in range(parts + 1)]
    out = []
    for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        bits = F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)).cast("int")
        masks = [sum(1 << i for i in c) for n in range(errors + 1) for c in combinations(range(b - a), n)]
        out.append(F.transform(F.array(*map(F.lit, masks)), _changed(k, bits)))
    return F.concat(*out)


def _changed(k: int, bits: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct(F.lit(k).alias("k"), bits.bitwiseXOR(mask).alias("v"))


def _similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """Sums of the smaller and of the larger counts of each shingle."""
    times = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return both, F.size(a) + F.size(b) - both


def known_items(items: DataFrame, width: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(item, size, i, g): least id, number of shingles, shingles and fingerprint of each distinct text; (item, item_id): all items of that text."""
    every = store.save(shingles(items.where("item_id is not null"), ["item_id"], width).distinct(), "items").where("size(s) > 0")
    least = every.groupBy("s").agg(F.min("item_id").alias("item"))
    distinct = store.save(least.select("item", F.size("s").alias("size"), F.col("s").alias("i"), simhash(F.col("s")).alias("g")), "codes")
    return distinct, every.join(distinct.select("item", F.col("i").alias("s")), "s").select("item", "item_id")


def candidates(windows: DataFrame, codes: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """doc, start, size, item of the windows (doc, start, size, f) and items (item, size, g) of a size whose fingerprints differ in radius bits at most.

    Of ``parts`` blocks one differs in radius / parts bits at most, so an item
    stands under all values so close to its own blocks and a window under its
    blocks alone: a value of 16 bits holds few of either.
    """
    laid = windows.select("doc", "start", "size", "f", F.explode(blocks(F.col("f"), parts)).alias("b")).select("doc", "start", "size", "f", "b.k", "b.v")
    stands = codes.select("item", "size", "g", F.explode(blocks(F.col("g"), parts, radius // parts)).alias("b")).select("item", "size", "g", "b.k", "b.v")
    near = laid.join(stands, ["size", "k", "v"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius)
    return near.select("doc", "start", "size", "item").distinct()


def matches(docs: DataFrame, items: DataFrame, radius: int = RADIUS, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, start (shingle), similarity: the best window of each document for each item that it holds."""
    codes, members = known_items(items, width)
    grams = codes.select("size", F.posexplode("i").alias("q", "h")).distinct()
    small = grams.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    docs = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    rows = shingles(docs, ["doc_id", "mark"], width)
    stands = rows.select("doc_id", "mark", F.size("s").alias("n"), _each("s").alias("p", "h")).join(F.broadcast(grams) if small else grams, "h")
    size = F.least("size", "n")
    windows = stands.select("doc_id", "mark", "size", F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - size)).alias("start")).distinct()
    laid = windows.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "size")).alias("w"))
    held = docs.join(laid, ["doc_id", "mark"])
    held = shingles(held, ["doc_id", "mark", "w"], width).select("doc_id", "mark", "s", F.explode("w").alias("w"))
    held = held.select(F.struct("doc_id", "mark").alias("doc"), F.col("w.start").alias("start"), F.col("w.size").alias("size"), F.slice("s", F.col("w.start") + 1, F.col("w.size")).alias("a"))
    held = store.save(held.withColumn("f", simhash(F.col("a"))), "windows")
    near = store.save(candidates(held, codes, radius), "candidates")
    near = near.join(held, ["doc", "start", "size"]).join(codes.select("item", "i"), "item")
    both, either = _similarity(F.col("a"), F.col("i"))
    near = near.select("doc", "item", "start", both.alias("both"), either.alias("either")).where(100 * F.col("both") >= percent * F.col("either"))
    best = F.max(F.struct((F.col("both") / F.col("either")).alias("s"), (-F.col("start")).alias("p")))
    near = near.join(members, "item").groupBy(F.col("doc.doc_id").alias("doc_id"), "item_id").agg(best.alias("b"))
    return near.select("doc_id", "item_id", (-F.col("b.p")).cast("long").alias("start"), F.col("b.s").alias("similarity"))
