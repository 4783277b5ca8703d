"""Connected components of an edge table by hooking and pointer jumping, one written table a round."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a bigint, b bigint); root is the smallest node of its component.

    Each round lowers a node's label to the least label of its neighbours' parents and hooks the old parent
    below it (the FastSV scheme), so rounds grow with the logarithm of the longest path. Every frame that is
    joined is a written table: a hub's rows are split by adaptive skew joins, and lost executors lose nothing.
    Self-loops and repeated edges change nothing; null ends are left out; no edges: an empty table.
    """
    e = edges.where("a <> b").select("a", "b")
    e = stored(e.union(e.select("b", "a")).distinct(), "cc-edges")
    f = stored(e.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("p")), "cc-labels")
    total = F.sum(F.col("p").cast("decimal(38,0)")).alias("s")
    before = f.agg(total).first().s
    while before is not None:
        g = f.alias("x").join(f.select(F.col("node").alias("q"), F.col("p").alias("g")), F.col("p") == F.col("q")).select("node", "p", "g")
        g = stored(g, "cc-grand")
        m = e.join(g.select(F.col("node").alias("b"), "g"), "b").groupBy(F.col("a").alias("node")).agg(F.min("g").alias("m"))
        both = g.join(m, "node").select(F.explode(F.array(F.struct(F.col("p").alias("node"), F.col("m").alias("p")), F.struct("node", F.least("p", "g", "m").alias("p")))).alias("r"))
        new = stored(both.groupBy("r.node").agg(F.min("r.p").alias("p")), "cc-labels")
        after = new.agg(total).first().s
        drop_stored(f, g)
        f = new
        if after == before:
            break
        before = after
    drop_stored(e)
    return f.select("node", F.col("p").alias("root"))
