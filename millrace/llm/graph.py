"""Connected components of a distributed graph by randomised contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label): every node of the edges (u, v), labelled by a node of its component.

    In each round every node joins the neighbour (or itself) of the least random rank, and the
    edges are renamed, so their number falls by a constant factor whatever the shape: long chains
    take logarithmically many rounds.  A hub's neighbours are combined before the shuffle.  Each
    round is a written table; nothing is collected.  Nulls are no nodes; no edges give no rows.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    both = saved(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    renamings: list[DataFrame] = []
    while not both.isEmpty():
        rank = lambda c, k=len(renamings): F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("rank"), F.col(c).alias("node"))
        chosen = both.groupBy("u").agg(F.min(rank("v")).alias("near")).select("u", F.least("near", rank("u"))["node"].alias("to"))
        chosen = saved(chosen, "contraction")
        renamings.append(chosen)
        left = chosen.select("u", F.col("to").alias("tu"))
        right = chosen.select(F.col("u").alias("v"), F.col("to").alias("tv"))
        renamed = both.join(left, "u").join(right, "v").where("tu <> tv").select(F.col("tu").alias("u"), F.col("tv").alias("v"))
        both = saved(renamed.distinct(), "edges")
    if not renamings:
        return both.select(F.col("u").alias("node"), F.col("u").alias("label"))

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        """Nodes of the earlier round with the label that the later rounds give to their choice."""
        follow = later.select(F.col("node").alias("to"), "label")
        return earlier.join(follow, "to", "left").select(F.col("u").alias("node"), F.coalesce("label", "to").alias("label"))

    *rest, last = renamings
    return reduce(compose, reversed(rest), last.select(F.col("u").alias("node"), F.col("to").alias("label")))
