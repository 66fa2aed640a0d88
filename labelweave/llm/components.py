"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Staging


def connected_components(
    edges: DataFrame, staging: Staging, name: str = "components", most_rounds: int = 64
) -> DataFrame:
    """``id, component`` for every id in ``edges`` (``a, b``); a component's name is its least id.

    Every round lets each node of the contracted graph hook onto its least neighbour and then onto
    that one's choice, and contracts the edges.  What is left shrinks with each round, no list of
    neighbours is formed, and the driver sees a count per round.  Rounds are written tables, so a
    lost executor costs no earlier round.
    """
    ends = edges.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    live = staging.write(ends.distinct(), f"{name}-edges")
    labels = live.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = labels.select("id", F.col("id").alias("component"))
    for number in range(most_rounds):
        # Each node's least neighbour, itself included; the smaller end never needs the larger.
        hooks = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("hook"))
        # A neighbour may have hooked onto something smaller still.
        onward = hooks.select(F.col("node").alias("hook"), F.col("hook").alias("further"))
        parents = staging.write(
            hooks.join(onward, "hook", "left").select(
                "node", F.coalesce("further", "hook").alias("parent")
            ),
            f"{name}-parents-{number}",
        )
        labels = labels.join(parents, labels["component"] == parents["node"], "left").select(
            "id", F.coalesce("parent", "component").alias("component")
        )
        at_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("parent_a"))
        at_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("parent_b"))
        moved = (
            live.join(at_a, "a", "left")
            .join(at_b, "b", "left")
            .select(F.coalesce("parent_a", "a").alias("a"), F.coalesce("parent_b", "b").alias("b"))
            .filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        live = staging.write(moved, f"{name}-live-{number}")
        if live.isEmpty():
            return staging.write(labels, name)
    raise RuntimeError("components did not settle")
