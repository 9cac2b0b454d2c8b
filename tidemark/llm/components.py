"""Connected components with DataFrame operations, and a pass that shortens the rounds where Python may run."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import pin, unpin


TOGETHER = 1 << 17  # edges whose forest a task finds at a time


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, of_u, of_v) to edges (u, v) that connect the same nodes: for each part of a task's rows, from every
    node to the one of lowest hash that the part connects it to."""
    def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        above, rank = {}, {}

        def root(x):
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for batch in held:
            for u, v, of_u, of_v in zip(*(c.to_pylist() for c in batch.columns)):
                for x, of in ((u, of_u), (v, of_v)):
                    if x not in above:
                        above[x], rank[x] = x, (of, x)
                low, high = sorted((root(u), root(v)), key=rank.__getitem__)
                above[high] = low
        leaves = [x for x in above if root(x) != x]
        kind = held[0].schema.field("u").type
        return pa.RecordBatch.from_arrays([pa.array([root(x) for x in leaves], kind), pa.array(leaves, kind)], ["u", "v"])

    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            yield forest(held)
            held = []
    if held:
        yield forest(held)


def components(edges: DataFrame, left: str = "a", right: str = "b", shorten: bool = False) -> DataFrame:
    """Every node that has an edge to another node, with the root of its component: (node, root).

    Each round maps every node to the node of lowest hash among itself and its neighbours and contracts the
    graph, which drops a constant share of its nodes, so the rounds grow with the logarithm of the graph
    whatever its shape. Rounds are written to the shared folder. Null ends, loops and repeated edges do not
    matter; an empty graph gives no row. ``shorten`` lets every task join what its own edges connect before each
    round (in Python), so that a graph of few edges takes one round.
    """
    live = pin(edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
               .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    labels, turn = None, 0
    while not live.isEmpty():
        if shorten:
            hashed = live.select("u", "v", F.xxhash64("u", F.lit(turn)), F.xxhash64("v", F.lit(turn)))
            kinds = ", ".join(f"{c} {t}" for c, t in live.dtypes)
            fewer = pin(hashed.coalesce(1 + live.count() // TOGETHER).mapInArrow(_forests, kinds).distinct(), "edges")
            unpin(live)
            live = fewer
        both = live.union(live.select("v", "u")).toDF("u", "v")
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: E731,B023
        step = pin(both.groupBy("u").agg(F.min(order("v")).alias("m"))
                   .select("u", F.least(order("u"), F.col("m"))["n"].alias("to")), "step")
        before = labels
        labels = pin(step.toDF("node", "root") if labels is None else
                     labels.join(step, labels.root == step.u, "left").select("node", F.coalesce("to", "root").alias("root")),
                     "labels")
        after = (live.join(step.toDF("u", "x"), "u").select("x", "v")
                 .join(step.toDF("v", "y"), "v").where("x != y")
                 .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        after = pin(after, "edges")
        unpin(before, step, live)
        live, turn = after, turn + 1
    return labels if labels is not None else live.toDF("node", "root")
