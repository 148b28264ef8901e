"""Connected components of a link table by hooking and shortcutting labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable, for every node with a link.

    Every node has a label f(u) <= u, at first its smallest neighbour or
    itself.  In each turn a node takes the least of its label's label and its
    neighbours' labels' labels, and so does the node that its label names;
    labels only fall, so an unchanged sum means that nothing changed, and
    then labels are equal along every link.  The number of turns is
    logarithmic in a component's length in practice.  The label table is
    written every turn; each join shuffles both of its sides, so Spark can
    split the links of a hot node, and minima are combined before shuffles.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = written(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("f")), "labels")
    before = None
    while (now := labels.agg(F.sum(F.col("f").cast("decimal(38,0)"))).collect()[0][0]) != before:
        before = now
        of_v = labels.select(F.col("u").alias("v"), F.col("f").alias("fv"))
        of_f = labels.select(F.col("u").alias("fv"), F.col("f").alias("gv"))
        near = edges.join(of_v, "v").join(of_f, "fv").groupBy("u").agg(F.min("gv").alias("m"))
        own = labels.join(near, "u").join(labels.select(F.col("u").alias("f"), F.col("f").alias("g")), "f")
        fresh = own.select(F.explode(F.array(
            F.struct("u", F.least("f", "m", "g").alias("f")), F.struct(F.col("f").alias("u"), F.col("m").alias("f")))).alias("x"))
        labels = written(fresh.groupBy("x.u").agg(F.min("x.f").alias("f")), "labels")
    return labels.select(F.col("u").alias("node"), F.col("f").alias("component"))
