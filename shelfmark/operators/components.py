"""Connected clusters of files that share groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialize


def cluster_labels(edges: DataFrame) -> DataFrame:
    """(path, cluster) for membership rows (group_id, path).

    Clusters are named by their smallest path. Every round hooks each node to
    the smallest node it shares a group with, follows the hooks to their roots
    by pointer jumping, and contracts the graph to the roots: the nodes at
    least halve, groups left with one node drop out, and the rounds end when
    no group joins two nodes. Group minima combine on the map side, so a group
    of any size costs its rows once.
    """
    edges = materialize(edges.distinct(), "edges")
    nodes = edges.select(F.col("group_id"), F.col("path").alias("node"))
    hooks = []
    while True:
        best = nodes.groupBy("group_id").agg(F.min("node").alias("best"), F.max("node").alias("top"))
        live = nodes.join(best.filter("best <> top").drop("top"), "group_id")
        hook = materialize(live.groupBy("node").agg(F.min("best").alias("target")), "hook")
        if hook.isEmpty():
            break
        hook = _to_roots(hook)
        hooks.append(hook)
        nodes = materialize(
            live.join(hook, "node").select("group_id", F.col("target").alias("node")).distinct(), "nodes"
        )
    labels = edges.select("path").distinct()
    if not hooks:
        return labels.withColumn("cluster", F.col("path"))
    # compose the rounds from the last, smallest one, so that the files are joined once
    final = hooks[-1]
    for hook in reversed(hooks[:-1]):
        onward = final.select(F.col("node").alias("target"), F.col("target").alias("end"))
        final = hook.join(onward, "target", "left").select("node", F.coalesce("end", "target").alias("target"))
    named = final.select(F.col("node").alias("path"), "target")
    return labels.join(named, "path", "left").select("path", F.coalesce("target", "path").alias("cluster"))


def _to_roots(hook: DataFrame) -> DataFrame:
    """Every node's target replaced by the root its hooks lead to.

    One pass jumps twice; a chain of hooks of any length shrinks to a quarter
    per pass, also when paths lie along it in sorted order.
    """
    while True:
        once = _jump(hook.select("node", "target"), hook)
        twice = _jump(once.select("node", "target"), once)
        hook = materialize(twice.withColumn("moved", F.col("target") != F.col("was")), "hook")
        if hook.filter("moved").isEmpty():
            return hook.select("node", "target")


def _jump(hook: DataFrame, by: DataFrame) -> DataFrame:
    """(node, target, was): each target replaced by its own target."""
    onward = by.select(F.col("node").alias("target"), F.col("target").alias("end"))
    return hook.join(onward, "target").select("node", F.col("end").alias("target"), F.col("target").alias("was"))
