"""Connected components of an edge relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.plans.session import cut


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of the (a, b) edges' nodes; root is the smallest node that is connected.

    Each round every node hangs on the smallest label among its neighbours', and then jumps to
    that label's own label, so the number of rounds is logarithmic.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = cut(both)
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        new = label.join(seen, label["node"] == seen["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        new = cut(new.join(jump, "root").select("node", "old", F.least("root", "next").alias("root")))
        if not new.filter("root != old").limit(1).count():
            return new.select("node", "root")
        label = new.select("node", "root")
