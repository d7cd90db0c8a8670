"""Connected components of a link table.

Tasks contract ``TASK_LINKS`` links each to a forest of stars, whatever the number of links. If more
than one task was needed, their stars are joined by alternating star operations in DataFrames.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, number_batches, small_plans, work_path

#: Links that one task contracts by itself (two numbers each).
TASK_LINKS = 1 << 20
#: Copies of the small side of a join in which one key may hold a large share of the rows.
SALTS = 16


def salted(rows: DataFrame, table: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (few rows a key), a key's rows being dealt to SALTS parts by a hash of ``by``.

    Spark's estimate of the table does not see its copies; so where it broadcasts the table, that is at most
    SALTS times the session's limit for broadcasts.
    """
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, [*on, "_salt"], how).drop("_salt")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links (a, b), ascending, and the least one it can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _stars(links: DataFrame, tasks: int) -> DataFrame:
    """(k, root) of every node of a task's share of ``links``."""

    def run(batches):
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            k, root = forest(*(np.concatenate(side) for side in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(root)], names=["k", "root"])

    return links.select("a", "b").where("a <> b").repartition(tasks).mapInArrow(run, "k long, root long")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted(around.where("v > u"), least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node, and its neighbours below it, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = salted(down, least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _contracted(links: DataFrame, name: str) -> DataFrame:
    """Edges (u, v) from every node to the least one it can reach."""
    spark = links.sparkSession
    path = work_path(spark, name)
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), name, path)
    before = None
    while True:
        after = work_path(spark, name)
        edges = materialize(_small_star(_large_star(edges)).distinct(), name, after, few=True)
        discard(spark, path)
        path = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(k, root) for every node of ``links`` (columns a, b): root is the least key it can reach.

    Empty links give an empty table; repeated links and links of a node to itself change nothing. Where
    one task does not hold all links, rounds of star operations follow, each written to the shared
    folder, which cuts lineage; they go on until nothing changes and grow with the logarithm of the
    longest chain.
    """
    spark = links.sparkSession
    tasks = max(1, -(-links.count() // TASK_LINKS))
    with small_plans(spark), number_batches(spark):
        stars = materialize(_stars(links, tasks), name)
        if tasks == 1:
            return stars
        edges = _contracted(stars.select(F.col("k").alias("a"), F.col("root").alias("b")), name)
    roots = edges.select(F.col("u").alias("k"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("k"), "root").distinct())
