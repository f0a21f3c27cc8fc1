"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import store


HOT = 1000  # a key with a share of one in HOT of the rows is hot, so there are at most HOT such keys


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with table, whose keys are distinct and whose column ``rows`` says how many of the total rows have each: hot keys by broadcast, so that their rows stay where they are."""
    hot = F.col("rows") * HOT >= total
    few, rest = F.broadcast(table.where(hot).drop("rows")), table.where(~hot).drop("rows")
    others = rows.join(few.select(*keys), keys, "left_anti").join(rest, keys)
    return rows.join(few, keys).unionByName(others)


def components(links: DataFrame) -> DataFrame:
    """id, root (the least id of its component) for every id in links (a, b).

    Each round takes the least label around each id and then the label of that
    label; rounds grow with the logarithm of a component's diameter.  No id's
    links are gathered, only their minimum is.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = store.save(both, "links")
    labels = store.save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        low = labels.join(near, "a").select("a", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("a").alias("m"), F.col("l").alias("j"))
        after = store.save(low.join(jump, "m").select("a", F.col("l").alias("was"), F.least("m", "j").alias("l")), "labels")
        moved = after.where("was <> l").limit(1).count()
        labels = after.select("a", "l")
        if not moved:
            return labels.select(F.col("a").alias("id"), F.col("l").alias("root"))
