"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import cut

#: Links that one task takes, at least: a table that shrinks each round is dealt to fewer tasks each round, and so many or fewer are joined in one.
ROWS = 1 << 15


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b; longs): component is its smallest reachable node.

    ``ROWS`` links or fewer are joined in one task. While there are more, each round hangs every node on
    the first of its neighbours and itself in an order drawn anew, jumps twice along these parents, and
    contracts the links by the result. In the order of ids a chain of ascending ones would lose four
    nodes a round; in a drawn order any table of links shrinks by a factor each round. Only sums per key and joins are shuffled: a node with very many links never gathers in one task.
    Rows with nulls and loops are ignored. Empty links give no rows. Each round ends in a checkpoint.
    """
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(edges)
    comp = None
    most = None
    for k in range(most_rounds):
        tasks = -(-edges.count() // ROWS)
        if tasks == 1:  # the last round
            up = cut(_united(edges))
            comp = _raised(None, up) if comp is None else cut(_raised(comp, up).coalesce(most))
        if tasks <= 1:
            if k:
                first = comp.groupBy("component").agg(F.min("node").alias("first"))
                comp = cut(comp.join(first, "component").select("node", F.col("first").alias("component")).coalesce(most))
            break
        most, edges = most or tasks, edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda x: F.struct(F.xxhash64(x, F.lit(k)).alias("h"), F.col(x).alias("at"))  # noqa: B023, E731
        up = both.groupBy("a").agg(F.min(drawn("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", drawn("a"))["at"].alias("up")).coalesce(tasks)
        up = cut(_jump(_jump(up).coalesce(tasks)).coalesce(tasks))
        comp = _raised(comp, up)
        edges = _mapped(_mapped(edges, up, "a"), up, "b").where("a <> b")
        edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges, comp = cut(edges.coalesce(tasks)), cut(comp.coalesce(most))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if comp is None:
        comp = links.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    return comp


def with_links(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, component) after further links (a, b), whose ends it need not have yet: only components are linked anew."""
    of = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    placed = cut(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    if placed.isEmpty():
        return comps
    ends = placed.select(F.col("a").alias("node")).unionByName(placed.select(F.col("b").alias("node"))).distinct()
    every = comps.unionByName(ends.join(comps, "node", "left_anti").select("node", F.col("node").alias("component")))
    step = connected_components(placed.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("up"))
    return cut(every.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")))


def _united(edges: DataFrame) -> DataFrame:
    """(node, up) of ``ROWS`` links at most: up is the smallest node that they reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = sorted((top(x), top(y)))
                up[y] = x
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(x) for x in up], pa.int64())], ["node", "up"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, up long")


def _raised(comp: DataFrame | None, up: DataFrame) -> DataFrame:
    """Nodes so far (none yet: those of ``up``) with their components after a round."""
    if comp is None:
        return up.select("node", F.col("up").alias("component"))
    step = up.select(F.col("node").alias("component"), F.col("up"))
    return comp.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))


def _jump(up: DataFrame) -> DataFrame:
    over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
    return up.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"))


def _mapped(edges: DataFrame, up: DataFrame, side: str) -> DataFrame:
    other = "b" if side == "a" else "a"
    to = up.select(F.col("node").alias(side), "up")
    return edges.join(to, side, "left").select(F.coalesce("up", side).alias(side), other)
