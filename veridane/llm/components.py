"""Connected components of a link table by hooking and shortcutting parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridane.llm.shared import release, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) of each node in links (a, b): the smallest node that it is linked to over any number of links.

    Each node has a parent, itself at first. In a round a node learns the
    smallest grandparent among its neighbours; its parent, it itself and its own
    grandparent are candidates for smaller parents. As whole trees hook onto
    smaller ones, rounds grow with the logarithm of a component's size, also for
    chains; parents only ever get smaller, so the rounds end, at the first that
    changes nothing. Each round's parents are a written table: plans stay short,
    and hot nodes meet in joins that Spark can split or in aggregates that combine
    before their shuffle. Nothing but one checksum a round comes to the driver.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("up")).select("node", "up", F.col("up").alias("top")), "parents")
    checksum = None
    while True:
        tops = state.select(F.col("node").alias("b"), "top")
        near = written(both.join(tops, "b").groupBy("a").agg(F.min("top").alias("low")), "near")
        known = near.join(state, F.col("a") == F.col("node"))
        offers = known.select(F.explode(F.array(F.struct(F.col("up").alias("node"), F.col("low").alias("up")), F.struct("node", F.least("low", "top", "up").alias("up")))).alias("o")).select("o.node", "o.up")
        parents = written(offers.groupBy("node").agg(F.min("up").alias("up")), "parents")
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        before, state = state, written(parents.join(above, "up").select("node", "up", "top"), "parents")
        release(before, near, parents)
        now = state.agg(F.sum(F.col("up").cast("decimal(38,0)")), F.sum(F.col("top").cast("decimal(38,0)"))).first()
        if now == checksum:
            release(both)
            return state.select("node", F.col("top").alias("label"))
        checksum = now
