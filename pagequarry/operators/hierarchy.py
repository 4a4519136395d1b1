"""Parent-child links resolved to full hierarchies.

Level-wise frontier joins run from the roots down; every level extends depth,
root and path of the level before.  Nodes that no level reaches hang on a
cycle; peeling off those that nothing leads to any more leaves the cycles.

Every level is one job that writes one part of a table, so no plan grows with
the depth.  While levels are large, a level's job also writes the links it did
not use, and the next one reads only those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagequarry.session import discard, work_path

ON_CYCLE = -1
INTO_CYCLE = -2
#: A frontier of more bytes is shuffled, not broadcast.
BROADCAST_BYTES = 8 * 2**20
#: Small levels are not spread over more tasks than they need.
ROWS_A_TASK = 50_000


@dataclass
class Hierarchy:
    """nodes: scope, node, root, depth and path (root first).

    Nodes on a cycle have root '' and depth -1, nodes that lead into one root
    '' and depth -2; their path is the node alone.  further_links: scope,
    child, parent of the links beside a child's smallest parent.
    """

    nodes: DataFrame
    further_links: DataFrame

    def descendants(self) -> DataFrame:
        """One row per node and node below it: scope, ancestor, descendant, distance.

        Ancestors are read off each node's own path, so no group of
        descendants is ever collected, however many share one root.
        """
        pairs = self.nodes.where(F.col("depth") > 0).select(
            "scope", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("level", "ancestor")
        )
        return pairs.where(F.col("level") < F.col("depth")).select(
            "scope", "ancestor", "descendant", (F.col("depth") - F.col("level")).cast("int").alias("distance")
        )


def _write(df: DataFrame, path: str, *figures, split: str | None = None) -> dict:
    """Writes ``df`` and returns figures gathered on the way."""
    seen = Observation()
    writer = df.observe(seen, *figures).write
    (writer.partitionBy(split) if split else writer).parquet(path)
    return seen.get


def resolve(links: DataFrame, scope: str, child: str, parent: str, broadcast_bytes: int = BROADCAST_BYTES) -> Hierarchy:
    """Every node of ``links`` with its root, depth and path, separately per ``scope``.

    Nodes are compared and given back as text.  Repeated links count once.
    Links with a null in scope, child or parent are no links.  A child with
    several parents hangs below the smallest; its other links are listed in
    ``further_links``.  A node that is its own parent is a cycle of one.
    Empty input gives no nodes.  Other columns of ``links`` are ignored,
    whatever their names.
    """
    spark, work = links.sparkSession, work_path(links.sparkSession, "hierarchy")
    plain = links.select(F.col(scope).alias("scope"), F.col(child).cast("string").alias("node"), F.col(parent).cast("string").alias("parent")).dropna()
    reached, unreached = F.col("root").isNotNull(), F.col("root").isNull()
    size = F.octet_length(F.col("scope").cast("string")) + F.octet_length("node") + F.octet_length("root") + F.octet_length(F.array_join("path", "")) + 64
    figures = F.count_if(reached).alias("n"), F.sum(F.when(reached, size)).alias("bytes"), F.count_if(unreached).alias("left")

    # Level 0 are the nodes without a parent. All others wait for the level of their parent.
    ends = F.array(F.struct("node", "parent"), F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    nodes = plain.select("scope", F.explode(ends).alias("e")).groupBy("scope", F.col("e.node").alias("node")).agg(F.min("e.parent").alias("parent"))
    root = F.when(F.col("parent").isNull(), F.col("node"))
    level = nodes.select("scope", "node", "parent", root.alias("root"), F.lit(0).alias("depth"), F.when(root.isNotNull(), F.array("node")).alias("path"))
    schema = level.schema

    def read(paths: list[str]) -> DataFrame:
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    levels: list[str] = []
    waiting: list[str] = []
    used: list[str] = []  # levels whose links still stand in ``waiting``
    used_rows, number, shrink = 0, 0, True
    while True:
        at = f"{work}/level-{number}"
        now = _write(level.withColumn("reached", reached) if shrink else level, at, *figures, split="reached" if shrink else None)
        if shrink:
            discard(spark, waiting)
            waiting, left = [f"{at}/reached=false"] if now["left"] else [], now["left"]
            at = f"{at}/reached=true"
        if not now["n"]:
            break
        levels.append(at)
        if not shrink:
            used.append(at)
            used_rows += now["n"]
        if used_rows >= left:
            waiting, used = discard(spark, waiting), []
        if not waiting:
            break
        if 2 * used_rows >= left:
            fewer = f"{work}/waiting-{number}"
            left = _write(read(waiting).join(read(used).select("scope", "node"), ["scope", "node"], "left_anti"), fewer, F.count("*").alias("left"))["left"]
            discard(spark, waiting)
            waiting, used, used_rows = [fewer], [], 0
        number += 1
        shrink = not used and 8 * now["n"] >= left
        frontier = read([at]).coalesce(1 + now["n"] // ROWS_A_TASK).select("scope", F.col("node").alias("parent"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        frontier = F.broadcast(frontier) if now["bytes"] <= broadcast_bytes else frontier.hint("merge")
        joined = read(waiting).select("scope", "node", "parent").coalesce(1 + left // ROWS_A_TASK).join(frontier, ["scope", "parent"], "left" if shrink else "inner")
        # No figure of this level in its expressions: the compiled code serves all levels.
        level = joined.select("scope", "node", "parent", F.col("_root").alias("root"), (F.col("_depth") + 1).alias("depth"), F.concat("_path", F.array("node")).alias("path"))

    # What no level reached leads up to a cycle for ever. What nothing leads to is no part of it.
    rest = read(waiting).join(read(used).select("scope", "node"), ["scope", "node"], "left_anti") if used else read(waiting)
    rest, tails, more = rest.select("scope", "node", "parent"), [], bool(waiting)
    while more:
        number += 1
        at = f"{work}/rest-{number}"
        led_to = rest.select("scope", F.col("parent").alias("node")).distinct().withColumn("kept", F.lit(True))
        now = _write(rest.join(led_to, ["scope", "node"], "left").withColumn("kept", F.coalesce("kept", F.lit(False))), at, F.count_if(~F.col("kept")).alias("tail"), F.count_if("kept").alias("left"), split="kept")
        discard(spark, waiting)
        waiting = [f"{at}/kept=true"] if now["left"] else []
        rest, more = read(waiting).select("scope", "node", "parent"), bool(now["tail"])
        if now["tail"]:
            tails.append(f"{at}/kept=false")

    def marked(paths: list[str], depth: int) -> DataFrame:
        return read(paths).select("scope", "node", F.lit("").alias("root"), F.lit(depth).alias("depth"), F.array("node").alias("path"))

    found = read(levels).select("scope", "node", "root", "depth", "path").unionByName(marked(waiting, ON_CYCLE)).unionByName(marked(tails, INTO_CYCLE))
    chosen = nodes.where(F.col("parent").isNotNull()).select("scope", "node", F.col("parent").alias("_chosen"))
    others = plain.distinct().join(chosen, ["scope", "node"]).where(F.col("parent") != F.col("_chosen"))
    return Hierarchy(found, others.select("scope", F.col("node").alias("child"), "parent"))
