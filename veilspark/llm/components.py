"""Connected components of a table of links, without collecting them anywhere.

Alternating large-star and small-star steps: every node points to the smallest node it knows, until each component is a
star around its smallest node. Rounds grow with the logarithm of a component's size. Each round is written to the shared
folder and the one before is deleted.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.scratch import dropped, kept


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(u, v) longs; component is the smallest node that can be reached.

    Links may repeat, in either direction; a link of a node with itself is ignored. Without links the result is empty.
    """
    edges = kept(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.filter("u > v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = kept(small.select("e.u", "e.v").filter("u > v").distinct(), "edges")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for old in (edges, large):
            dropped(old)
        edges = new
        if state == before or state[0] == 0:
            break
        before = state
    # Stars: every node but the smallest has one edge, to it.
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
