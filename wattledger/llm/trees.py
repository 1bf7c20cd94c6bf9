"""A forest of random projection trees over unit vectors: recursive random splits whose sides overlap.

A cell with many vectors is split at the median of their projections on a random
direction. A vector is at home on its own side and visits the other one if its
projection is within the overlap there, so that a linked vector beyond the cut
is mostly met. Each tree has directions of its own, so what one tree parts
another keeps together. Directions follow from seed, tree and node; only cuts are stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unsent

TREES = 6
# Overlap on either side of a cut, in standard deviations of the projected difference of two vectors that just link.
OVERLAP = 0.5
MOST_KEPT = 0.6  # a split that leaves a side more than this of a cell is not made, since copies would outgrow the gain
SAMPLE = 1024  # vectors of a cell, about, that its cuts are taken from
STEP = 4  # levels of splits that one round makes
ROUNDS = 12
PART = 20_000  # rows of a cell that one task deals out, about


def vectors(raw: pd.Series) -> np.ndarray:
    """Unit vectors, one a row, of little-endian single precision components."""
    values = np.array([np.frombuffer(r, "<f4") for r in raw]).astype(np.float64)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _projected(unit: np.ndarray, seed: int, root: int, tree: int, node: int) -> np.ndarray:
    direction = np.random.default_rng([seed, int(root) & (1 << 64) - 1, int(tree), int(node)]).standard_normal(unit.shape[1])
    return unit @ (direction / np.sqrt(direction @ direction))


def _overlap(least: float, dim: int) -> float:
    return OVERLAP * float(np.sqrt(max(2 - 2 * least, 0) / dim))


def _cuts(unit: np.ndarray, each: float, leaf: int, over: float, seed: int, root: int, tree: int, node: int) -> np.ndarray:
    """Cuts of STEP levels below a node, in heap order, NaN where none is made; a vector of the sample stands for ``each``."""
    cuts = np.full((1 << STEP) - 1, np.nan)
    open_nodes = [(0, node, np.arange(len(unit)))]
    while open_nodes:
        at, code, rows = open_nodes.pop()
        if at >= len(cuts) or len(rows) < 2 or len(rows) * each <= leaf:
            continue
        value = _projected(unit[rows], seed, root, tree, code)
        cut = np.median(value)
        low, high = rows[value < cut + over], rows[value >= cut - over]
        if max(len(low), len(high)) > MOST_KEPT * len(rows):
            continue
        cuts[at] = cut
        open_nodes += [(2 * at + 1, 2 * code, low), (2 * at + 2, 2 * code + 1, high)]
    return cuts


def leaves(classes: DataFrame, least: float, leaf: int, seed: int) -> DataFrame:
    """(class, dim, root, tree, node, cell, home) of (class, label, dim, raw): every class in its leaves of each tree.

    A root, all vectors of one label and length, that no tree splits is one cell
    of one tree; its node is 1. ``home`` marks the one leaf of a tree where a class is at home.
    """
    raw = unsent(classes.select("class", "raw"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class", kind="stable")
        unit, (cell, root, tree, node, n) = vectors(rows["raw"]), rows[["cell", "root", "tree", "node", "n"]].iloc[0]
        over, each = _overlap(least, unit.shape[1]), n / len(unit)
        # A root starts all trees.
        found = [(t, _cuts(unit, each, leaf, over, seed, root, t, node)) for t in (range(TREES) if node == 1 else (tree,))]
        if any(np.isnan(cuts[0]) for _, cuts in found):
            found = []
        return pd.DataFrame([(cell, root, t, node, 1 + n // PART, cuts.tobytes()) for t, cuts in found],
                            columns=["cell", "root", "tree", "node", "parts", "cuts"])

    def deal(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows):
            unit, own = vectors(rows["raw"]), rows["home"].to_numpy(bool)
            over = _overlap(least, unit.shape[1])
            for root, tree, node, raw_cuts in zip(chosen["root"], chosen["tree"], chosen["node"], chosen["cuts"], strict=True):
                cuts = np.frombuffer(raw_cuts)
                open_nodes = [(0, node, np.arange(len(unit)), own)]
                while open_nodes:
                    at, code, found, home = open_nodes.pop()
                    if at >= len(cuts) or np.isnan(cuts[at]):
                        out.append(pd.DataFrame({
                            "class": rows["class"].to_numpy()[found], "dim": rows["dim"].to_numpy()[found],
                            "root": root, "tree": tree, "node": code, "home": home}))
                        continue
                    value = _projected(unit[found], seed, root, tree, code) - cuts[at]
                    for side, there, mine in ((0, value < over, value < 0), (1, value >= -over, value >= 0)):
                        open_nodes.append((2 * at + 1 + side, 2 * code + side, found[there], (home & mine)[there]))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("class", "dim", "root", "tree", "node", "home")})

    root = F.xxhash64("label", "dim")
    now = classes.select("class", "dim", root.alias("root"), F.lit(0).alias("tree"), F.lit(1).cast("bigint").alias("node"),
                         root.alias("cell"), F.lit(True).alias("home"))
    done: list[DataFrame] = []
    for number in range(ROUNDS):
        large = stored(now.groupBy("cell").agg(F.count("class").alias("n")).filter(F.col("n") > leaf), f"large-nodes-{number}")
        if large.isEmpty():
            break
        drawn = now.join(large, "cell").filter(F.pmod(F.xxhash64("class", F.lit(seed + number)), F.col("n")) < SAMPLE).join(raw, "class")
        split = stored(drawn.select("cell", "root", "tree", "node", "n", "class", "raw").groupBy("cell").applyInPandas(
            choose, "cell bigint, root bigint, tree int, node bigint, parts bigint, cuts binary"), f"cuts-{number}")
        if split.isEmpty():
            break
        parts = split.groupBy("cell").agg(F.first("parts").alias("parts"))
        done.append(now.join(parts, "cell", "left_anti").select(now.columns))
        rows = now.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))).select(
            "class", "dim", "home", "cell", "part").join(raw, "class")
        each = split.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
        dealt = rows.groupBy("cell", "part").cogroup(each.groupBy("cell", "part")).applyInPandas(
            deal, "class bigint, dim int, root bigint, tree int, node bigint, home boolean")
        now = stored(dealt.select("class", "dim", "root", "tree", "node", F.xxhash64("root", "tree", "node").alias("cell"), "home"), f"nodes-{number}")
    for part in done:
        now = now.unionByName(part)
    return now
