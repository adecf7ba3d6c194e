"""Graph operators on edge tables: components, reachable ancestors, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

MAX_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """id, component (the smallest id of the component) for every id with an edge to another.

    Large-star and small-star rounds alternate until the edges are stars around
    the smallest ids. A round moves at most as many edges as it got; a hub costs
    a partial minimum and a join that adaptive execution can split. Every round
    is written, so a lost executor repeats one round at most.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    current = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    current = scratch.keep(current, "edges-0")
    seen = _fingerprint(current)
    for step in range(1, MAX_ROUNDS):
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.where(F.col("a") != F.col("b")).distinct(), f"large-{step}")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(down, "a").where(F.col("b") != F.col("m")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        current = scratch.keep(moved.union(down.select("a", F.col("m").alias("b"))).distinct(), f"edges-{step}")
        scratch.drop(f"large-{step}", f"edges-{step - 1}")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("id")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def component_changes(labels: DataFrame, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """id, component of the ids whose component changes, or which are new, when ``edges`` (a, b) are added to ``labels`` (id, component).

    New edges meet labels, not the edges of earlier runs: they become edges between
    labels, the components of this small graph rename labels, and only rows of renamed
    labels are given. As a label is the smallest id of its component, so is the new one.
    """
    scratch = scratch or Scratch(edges.sparkSession, "changes")
    held = labels.select("id", "component")
    ends = [held.select(F.col("id").alias(f"id_{e}"), F.col("component").alias(f"label_{e}")) for e in "ab"]
    met = edges.select("a", "b").where("a <> b").distinct()
    met = met.join(ends[0], F.col("a") == F.col("id_a"), "left").join(ends[1], F.col("b") == F.col("id_b"), "left")
    met = scratch.keep(met.select("a", "b", "label_a", "label_b"), "met")
    renamed = connected_components(met.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")), scratch=scratch)
    renamed = scratch.keep(renamed.select(F.col("id").alias("old"), F.col("component").alias("new")), "renamed")
    moved = held.join(renamed.where("old <> new"), F.col("component") == F.col("old")).select("id", F.col("new").alias("component"))
    fresh = met.where("label_a IS NULL").select(F.col("a").alias("id")).union(met.where("label_b IS NULL").select("b")).distinct()
    return moved.unionByName(fresh.join(renamed, F.col("id") == F.col("old")).select("id", F.col("new").alias("component")))


def with_changes(labels: DataFrame, changes: DataFrame) -> DataFrame:
    """``labels`` after ``changes``."""
    kept = labels.select("id", "component").join(changes.select("id"), "id", "left_anti")
    return kept.unionByName(changes.select("id", "component"))
