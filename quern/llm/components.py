"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """links: u, v (long).  Returns doc_id, component_id (the smallest id that can be reached)
    for every id that has a link to another.  All steps are joins and minima by key; each
    round is written to the shared folder, and nothing but a checksum comes to the driver."""
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    print_of = lambda e: tuple(e.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = print_of(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (minima are written first: a join with a table can be split where a vertex is hot)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = materialize(low, "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "large")
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        new = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = print_of(new)
        for t in (edges, low, large, down):
            discard(t)
        edges = new
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))
    return stars.unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct())
