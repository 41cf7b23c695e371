"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeledger.llm.common import materialise


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, component`` for every id of the links ``a, b``: the smallest id that it reaches.

    A large-star step ties all larger neighbours of a node to the least node around it, a small-star step the smaller
    ones; sums per node are combined before the shuffle and the join back may be split where a node has very many
    links. Each round's table is written to the shared folder; rounds end when nothing changes, after about log(n) of
    them. Links with a NULL end and loops are ignored; repeated links do no harm.
    """
    pair = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v")
    table = materialise(pair.distinct(), "links")
    last = None
    for _ in range(rounds):
        both = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        table = materialise(small.where("u <> v").distinct(), "links")
        now = tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return table.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        table.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
