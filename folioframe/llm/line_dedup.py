"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

A line's tokens with a digit are variable fields (``<*>``).  Its path in the
tree is its token count and its first ``depth`` tokens.  In a leaf, a token
that fewer than ``min_docs`` documents have at its place is a variable field
too, as long as at least ``similar`` percent of the line stays constant; else
the line is its own template.  A template that ``min_docs`` documents or more
have is recurring: its lines are dropped everywhere but in the document with
the smallest id that has it.

Lines without a word never match and always stay.  Distinct lines are counted
before anything is joined, texts are never gathered by line, and what decides
a document's lines are positions only.  Templates that hold a thousandth of
all hits or more, a thousand at most, are joined by broadcast, so that no task
gets one template's hits, and so are lines of that share; the others by an
exchange.

``without_repeats`` is for identical lines that fewer documents have: a masked
line of ``words`` or more words that aren't variable fields, which are
``similar`` percent of it at least, stays only in the document with the
smallest id from ``exact`` documents on.  It belongs after all steps that take
out documents: before them, a near copy would be left as a few odd lines that
nothing resembles, and a line's one copy could go with its document.

Defined results: null text stays null with no lines; empty texts stay; a text
of any length is one string that is split once; documents are counted by id, so
repeated rows and rows that share an id are one document and lose the same
lines; rows without an id are one document, never first unless no row has one;
ties need no order; empty tables give empty results; extra columns of any name
pass through ``clean`` unchanged (``counters`` names what it adds, and a column
of such a name is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm import store

DEPTH, MIN_DOCS, SIMILAR = 3, 10, 70
EXACT, WORDS = 2, 4
HOT = 1000  # a key with a share of one in HOT of the rows is hot, so there are at most HOT such keys
COUNTERS = ("_n_lines", "_n_dropped")
SPACE = "[\\x20\\x09-\\x0D]+"
FIELD = "<*>"


def masked(line: Column) -> Column:
    """The line with each token that has a digit replaced."""
    field = F.regexp_replace(line, "[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*", FIELD)
    return F.when(line.rlike("[0-9]"), field).otherwise(line)


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE), "")


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def templates(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similar: int = SIMILAR) -> DataFrame:
    """line (hash of a masked line), template (hash), docs (that have the line), for the lines of every leaf that at least min_docs lines of documents reach."""
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), masked))
    each = docs.select(_key().alias("k"), F.explode(lines).alias("line"))
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        each = each.distinct()  # rows that share an id are one document
    seen = each.groupBy("line").agg(F.count("*").alias("docs"))
    seen = seen.withColumn("t", _tokens(F.col("line")))
    path = F.xxhash64(F.size("t"), *(F.coalesce(F.get("t", F.lit(k)), F.lit("")) for k in range(depth)))
    seen = store.save(seen.select(path.alias("leaf"), "docs", F.xxhash64("line").alias("line"), F.array_join("t", " ").alias("t")), "lines")
    leaves = seen.groupBy("leaf").agg(F.sum("docs").alias("n"), F.count("*").alias("kinds")).where(F.col("n") >= min_docs)
    reached = store.save(seen.join(leaves, "leaf").select("leaf", "line", "docs", "t", "kinds"), "leaves")
    mixed = reached.where("kinds > 1").select("leaf", "line", "docs", F.posexplode(F.split("t", " ")).alias("pos", "token"))
    constant = mixed.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "pos", "token", F.lit(True).alias("same"))
    shape = (
        mixed.join(constant, ["leaf", "pos", "token"], "left")
        .groupBy("leaf", "line")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("same"), F.col("token")).otherwise(FIELD).alias("token")))), lambda x: x["token"]), " ").alias("shape"),
            (100 * F.count("same") >= similar * F.count("*")).alias("alike"),
        )
    )
    general = shape.where("alike").select("leaf", "line", "shape")
    return reached.join(general, ["leaf", "line"], "left").select("line", F.xxhash64("leaf", F.coalesce("shape", "t")).alias("template"), "docs")


def dropped(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, mark (hash of the text), gone (positions of the lines to drop) for the rows that lose lines."""
    texts = docs.select("doc_id", "text")
    of = store.save(templates(texts, depth, min_docs, similar), "templates")
    lines = texts.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    lines = lines.where(F.col("l").rlike("[^\\x20\\x09-\\x0D]")).select("doc_id", "mark", "pos", F.xxhash64(masked(F.col("l"))).alias("line"))
    hot = F.col("docs") * HOT >= (of.agg(F.sum("docs")).first()[0] or 0)
    lines = lines.join(F.broadcast(of.where(hot).select("line", F.col("template").alias("top"))), "line", "left")
    # the rows of hot lines go on under a key of their own, which spreads them
    lines = lines.withColumn("line", F.when(F.col("top").isNull(), F.col("line")).otherwise(F.xxhash64("doc_id", "pos")))
    rest = of.where(~hot).select(F.col("line").alias("of"), F.col("template").alias("other"))
    hits = lines.join(rest, (F.col("line") == F.col("of")) & F.col("top").isNull(), "left").withColumn("template", F.coalesce("top", "other"))
    return _later(store.save(hits.where("template is not null").select("doc_id", "mark", "pos", "template"), "hits"), min_docs)


def repeated(docs: DataFrame, exact: int = EXACT, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """Like dropped, for identical masked lines of exact documents or more."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("pos", "l")).select("doc_id", "mark", "pos", masked(F.col("l")).alias("l"))
    t = _tokens(F.col("l"))
    fixed = F.size(F.filter(t, lambda x: x != FIELD))
    lines = lines.where((fixed >= words) & (100 * fixed >= similar * F.size(t))).select("doc_id", "mark", "pos", F.xxhash64(F.array_join(t, " ")).alias("template"))
    several = lines.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= exact).select("template")
    return _later(store.save(lines.join(several, "template").select("doc_id", "mark", "pos", "template"), "hits"), exact)


def _later(hits: DataFrame, min_docs: int) -> DataFrame:
    """doc_id, mark, gone: the hits of templates that min_docs documents have, but for those of the first document."""
    key = _key()
    counts = hits.select("template", key.alias("k")).groupBy("template", "k").agg(F.count("*").alias("hits"))
    recurring = counts.groupBy("template").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.sum("hits").alias("hits")).where(F.col("n") >= min_docs)
    recurring = store.save(recurring.select("template", "first", "hits"), "recurring")
    hot = F.col("hits") * HOT >= hits.count()
    top = recurring.where(hot).select("template", F.col("first").alias("top"))
    rows = hits.join(F.broadcast(top), "template", "left")
    often = rows.where(F.col("top").isNotNull() & (key != F.col("top"))).select("doc_id", "mark", "pos")
    rest = rows.where(F.col("top").isNull()).join(recurring.where(~hot), "template").where(key != F.col("first")).select("doc_id", "mark", "pos")
    return often.unionByName(rest).groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("gone"))


def clean(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, similar: int = SIMILAR, counters: tuple[str, str] = COUNTERS) -> DataFrame:
    """docs with the recurring lines taken out of text, and the numbers of its lines and of those taken out."""
    return _without(docs, dropped(docs, depth, min_docs, similar), counters)


def without_repeats(docs: DataFrame, exact: int = EXACT, words: int = WORDS, similar: int = SIMILAR, counters: tuple[str, str] = COUNTERS) -> DataFrame:
    """Like clean, with the lines taken out that are identical in exact documents or more."""
    return _without(docs, repeated(docs, exact, words, similar), counters)


def _without(docs: DataFrame, lines_gone: DataFrame, counters: tuple[str, str]) -> DataFrame:
    id_, mark, gone = (store.free(name, docs.columns) for name in ("_id", "_mark", "_gone"))
    found = lines_gone.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("gone").alias(gone))
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(mark)), "left")
    lines = F.split("text", "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone), i)), "\n"))
    replaced = {c.lower() for c in counters}
    return rows.select(
        *(text.alias(c) if c.lower() == "text" else store.quoted(c) for c in docs.columns if c.lower() not in replaced),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(counters[0]),
        F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long").alias(counters[1]),
    )
