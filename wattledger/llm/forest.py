"""Near-duplicate vectors by a forest of random projection trees, and by cells that complete it.

The vectors of a label go down the trees of ``trees``; each meets all others of its leaves, and what a tree before
has counted is not counted again. A forest finds a link with high probability only, so vectors that trees have taken
apart also meet in cells that keep every linked pair together, which adds the links that no leaf held.

A large cell is dealt out to pivots: a vector is at home with its nearest pivot
and visits every other one whose share may hold a vector linked to it, which is
so if its distance to the plane halfway is at most the greatest distance of a
linked pair. So each vector meets all that link with it in the cell where it is
at home, whatever the sizes. Cells that no pivots take apart are compared whole,
in tiles of bounded size, one task each; all products are exact.

Equal vectors are one class with a count, so copies are never compared. A tile
returns one row per class: how many vectors it links, and the smallest class
that links within the tile reach.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import SENT_ROWS, stored, table, unsent
from .components import components
from .trees import vectors as _vectors

# Classes of a leaf or cell that is not split or dealt out further.
LEAF = 2048
PIVOTS = 64  # of a cell, at most
SAMPLE = 512  # vectors of a cell, about, that pivots are chosen from
LEVELS = 40  # cells after so many steps are compared whole
# What one more row of a cell costs, in compared pairs, and the share of the cost that pivots must save.
ROW_COST = 500
SAVED = 0.25
PART = 20_000  # rows of a cell that one task deals out, about
# Sides of a tile: at least LEAF classes, at most so many vector components; a cell has eight a side if that lies between.
TILE_VALUES = 1 << 21
SEED = 20_240_229
_BLOCK = (512, 4096)  # rows and columns of a tile whose products are made at once
# Numbers of trees are below this one, which stands for the cells that complete them.
_AFTER_TREES = 256


def classes_of(vectors: DataFrame) -> DataFrame:
    """(key columns, class, copies, raw): different vectors that can link, by label; class is the smallest vec_id."""

    @F.arrow_udf("binary")
    def raw(embedding: pa.Array) -> pa.Array:
        out = []
        for v in embedding:
            values = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(np.float32)
            fit = values is not None and len(values) > 0 and v.values.null_count == 0 and np.isfinite(values).all() and values.any()
            out.append(values.astype("<f4").tobytes() if fit else None)
        return pa.array(out, pa.binary())

    fit = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    grouped = fit.groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("class"), F.count("vec_id").alias("copies"), F.first("embedding").alias("embedding"))
    one = grouped.select("label", "h1", "h2", "class", "copies", F.size("embedding").alias("dim"), raw("embedding").alias("raw"))
    return stored(one.filter("raw IS NOT NULL"), "vector-classes")


def _members(unit: np.ndarray, pivots: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, matrix of the pivots that a vector is with) of unit vectors.

    The plane halfway between two pivots holds the origin, since pivots have unit length. Vectors on either side
    of it are no closer than either is to the plane.
    """
    value = unit @ pivots.T
    home = value.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    beyond = value[np.arange(len(unit)), home][:, None] - value
    return home, beyond <= (gap + 1e-6) * apart[home] + 1e-9


def _pivots(unit: np.ndarray, gap: float, n: int) -> np.ndarray | None:
    """Unit vectors to deal out a cell of n vectors like these; None if that saves too little."""
    chosen, near = [0], np.full(len(unit), np.inf)
    while len(chosen) < PIVOTS:  # the farthest from those chosen; a closer one than this parts nothing
        near = np.minimum(near, 2 - 2 * unit @ unit[chosen[-1]])
        far = int(near.argmax())
        if near[far] <= (2 * gap) ** 2:
            break
        chosen.append(far)
    least, best, k = (1 - SAVED) * (n + ROW_COST), None, 2
    while k < 2 * len(chosen) and len(chosen) > 1:
        pivots = unit[chosen[:k]]
        nearest = (unit @ pivots.T).argmax(1)
        sums = np.array([unit[nearest == i].sum(0) for i in range(len(pivots))])
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        pivots = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), pivots)
        home, members = _members(unit, pivots, gap)
        share = members.mean(0)
        cost = n * float(np.bincount(home, minlength=len(pivots)) @ share) / len(unit) + ROW_COST * float(share.sum())
        if cost < least:
            least, best = cost, pivots
        k *= 2
    return best


def cells(classes: DataFrame, least: float, seed: int = SEED) -> DataFrame:
    """(class, dim, cell, home): every class at home in one cell, and a visitor of all others with a class it may link with."""
    gap = float(np.sqrt(max(2 - 2 * least, 0)))
    raw = unsent(classes.select("class", "raw"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class", kind="stable")
        pivots = _pivots(_vectors(rows["raw"]), gap, int(rows["n"].iloc[0]))
        found = [] if pivots is None else [(rows["cell"].iloc[0], 1 + int(rows["n"].iloc[0]) // PART, pivots.tobytes())]
        return pd.DataFrame(found, columns=["cell", "parts", "pivots"])

    def deal(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"class": [], "dim": [], "cell": [], "pivot": [], "home": []})
        unit = _vectors(rows["raw"])
        nearest, members = _members(unit, np.frombuffer(chosen["pivots"].iloc[0]).reshape(-1, unit.shape[1]), gap)
        row, pivot = np.nonzero(members)
        return pd.DataFrame({
            "class": rows["class"].to_numpy()[row], "dim": rows["dim"].to_numpy()[row], "cell": rows["cell"].to_numpy()[row],
            "pivot": pivot, "home": rows["home"].to_numpy(bool)[row] & (nearest[row] == pivot),
        })

    now = classes.select("class", "dim", F.xxhash64("label", "dim").alias("cell"), F.lit(True).alias("home"))
    done: list[DataFrame] = []
    for level in range(LEVELS):
        large = stored(now.groupBy("cell").agg(F.count("class").alias("n")).filter(F.col("n") > LEAF), f"large-{level}")
        if large.isEmpty():
            break
        drawn = now.join(large, "cell").filter(F.pmod(F.xxhash64("class", F.lit(seed + level)), F.col("n")) < SAMPLE).join(raw, "class")
        split = stored(drawn.select("cell", "n", "class", "raw").groupBy("cell").applyInPandas(
            choose, "cell bigint, parts bigint, pivots binary"), f"pivots-{level}")
        if split.isEmpty():
            break
        # Stored without the pivots, in whose size Spark would take this for larger than the rows it is joined with.
        parts = stored(split.select("cell", "parts"), f"parts-{level}")
        # Cells that pivots do not take apart would not be taken apart later either.
        done.append(now.join(parts, "cell", "left_anti").select("class", "dim", "cell", "home"))
        rows = now.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))).join(raw, "class").drop("parts")
        each = split.select("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "pivots")
        dealt = rows.groupBy("cell", "part").cogroup(each.groupBy("cell", "part")).applyInPandas(
            deal, "class bigint, dim int, cell bigint, pivot int, home boolean")
        now = stored(dealt.select("class", "dim", F.xxhash64("cell", "pivot").alias("cell"), "home"), f"cells-{level}")
    for part in done:
        now = now.unionByName(part)
    return now


def _tiles(members: DataFrame) -> DataFrame:
    """(class, cell, tree, i, j, role): rows of each tile; role has bit 0 if the class's links count there, bit 1 if it is met there."""
    sizes = members.groupBy("cell").agg(F.count("class").alias("n"), F.first("dim").alias("dim"))
    side = F.greatest(F.lit(LEAF), F.least(F.ceil(F.col("n") / 8), F.floor(F.lit(TILE_VALUES) / F.col("dim"))))
    groups = stored(sizes.select("cell", F.ceil(F.col("n") / side).cast("bigint").alias("groups")), "groups")
    dealt = members.join(groups, "cell").withColumn("g", F.pmod(F.xxhash64("class", "cell"), F.col("groups")))
    k, g, mine = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)), F.col("g"), F.col("home").cast("int")
    spread = dealt.select("class", "cell", "tree", "g", "home", k.alias("k"))
    tile = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.cast("int").alias("role"))
    own = F.array(tile(g, g, mine + 2))
    others = F.when(F.col("home"), F.array(tile(g, F.col("k"), F.lit(1)), tile(F.col("k"), g, F.lit(2)))).otherwise(
        F.array(tile(F.col("k"), g, F.lit(2))))
    return spread.select("class", "cell", "tree", F.explode(F.when(g == F.col("k"), own).otherwise(others)).alias("t")).select(
        "class", "cell", "tree", "t.*")


def _counted(homes: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """Which pairs of a row of ``homes`` and one of ``places`` a tree before has counted: a home is one of the places."""
    leaves, at = np.unique(np.concatenate(homes), return_inverse=True)
    met = np.concatenate(places)
    there = np.minimum(np.searchsorted(leaves, met), len(leaves) - 1)
    column, same = np.repeat(np.arange(len(places)), [len(p) for p in places]), leaves[there] == met
    holds = np.zeros((len(leaves), len(places)), bool)
    holds[there[same], column[same]] = True
    out = np.zeros((len(homes), len(places)), bool)
    for tree in at.reshape(len(homes), -1).T:  # each vector has one home in each tree
        out |= holds[tree]
    return out


def _compare(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """By class of a tile, how many vectors it links there that no tree before has counted, and the smallest class reached.

    ``homes`` and ``places`` are a class's leaves in the trees before: those where it is at home, and all.
    """
    rows = rows.sort_values("class", kind="stable")
    cls, copies, role = (rows[c].to_numpy() for c in ("class", "copies", "role"))
    homes, places = rows["homes"].tolist(), rows["places"].tolist()
    unit = _vectors(rows["raw"])
    short = unit.astype(np.float32)
    unsure = np.float32((unit.shape[1] + 8) * 2.0**-22)  # single precision may be wrong within this
    mine, met = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    n, root = np.zeros(len(cls)), np.arange(len(cls))
    for a in range(0, len(mine), _BLOCK[0]):
        i = mine[a:a + _BLOCK[0]]
        for b in range(0, len(met), _BLOCK[1]):
            j = met[b:b + _BLOCK[1]]
            value = short[i] @ short[j].T
            linked = value >= least
            u, v = np.nonzero(np.abs(value - np.float32(least)) <= unsure)
            for at in range(0, len(u), 50_000):
                x, y = u[at:at + 50_000], v[at:at + 50_000]
                linked[x, y] = (unit[i[x]] * unit[j[y]]).sum(1) >= least
            at = np.minimum(np.searchsorted(j, i), len(j) - 1)
            linked[np.arange(len(i)), at] &= j[at] != i  # not with itself
            some = linked.any(1)
            if not some.any():
                continue
            i, linked = i[some], linked[some]
            root = _joined(root, linked, i, j)
            if len(homes[i[0]]):
                linked &= ~_counted([homes[x] for x in i], [places[x] for x in j])
            n[i] += linked @ copies[j].astype(float)
    seen = (n > 0) | (root != np.arange(len(cls)))
    return pd.DataFrame({"class": cls[seen], "n": n[seen].astype(np.int64), "root": cls[root[seen]]})


def _joined(root: np.ndarray, linked: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links between rows i and j: the smallest row of each set that links connect."""
    while True:
        mine, theirs = root[i], root[j]
        if (mine == mine[0]).all() and (theirs[linked.any(0)] == mine[0]).all():
            return root
        low = np.minimum(mine, np.where(linked, theirs[None, :], len(root)).min(1))
        parent = np.arange(len(root))
        np.minimum.at(parent, mine, low)
        np.minimum.at(parent, theirs, np.where(linked, low[:, None], len(root)).min(0))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        if (parent == np.arange(len(parent))).all():
            return root
        root = parent[root]


def _met(members: DataFrame, classes: DataFrame, leaves: DataFrame, least: float, name: str) -> DataFrame:
    """(class, n, root): what ``_compare`` finds in all tiles of the members (class, dim, cell, tree, home)."""
    before = lambda c: F.coalesce(F.filter(c, lambda x: F.pmod(x, F.lit(_AFTER_TREES)) < F.col("tree")), F.array().cast("array<bigint>"))
    full = _tiles(members).join(unsent(classes.select("class", "copies", "raw")), "class").join(unsent(leaves), "class", "left").select(
        "class", "cell", "i", "j", "role", "copies", "raw", before("homes").alias("homes"), before("places").alias("places"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return _compare(rows, least)

    return stored(full.groupBy("cell", "i", "j").applyInPandas(compare, "class bigint, n bigint, root bigint"), name)


def near_duplicates(vectors: DataFrame, least: float, seed: int = SEED, complete: bool = True) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding, label): vectors of one label with a cosine of at least ``least``.

    Rows with one vec_id are one vector: the one with the smallest label and
    embedding. Vectors that are null, empty, zero or hold null or non-finite
    components, and those without a label or id, link with nothing; the row of a
    null id has no component. Equal vectors link like all others. All links are found, and none below ``least`` is made;
    without ``complete`` only those that a leaf of the forest holds.
    """
    one = vectors.select("vec_id", "label", "embedding").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
    keyed = one.select("vec_id", "v.*").withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")})
    classes = classes_of(keyed)
    members = stored(trees.leaves(classes, least, LEAF, seed), "leaves")
    code = F.col("node") * _AFTER_TREES + F.col("tree")
    split = members.filter("node > 1")
    leaves = stored(split.groupBy("class").agg(F.collect_list(F.when(F.col("home"), code)).alias("homes"), F.collect_list(code).alias("places")), "places")
    met = _met(members, classes, leaves, least, "met-in-leaves")
    if complete and not leaves.isEmpty():
        rest = stored(cells(classes.join(unsent(leaves.select("class")), "class", "left_semi"), least, seed), "members")
        met = met.unionByName(_met(rest.withColumn("tree", F.lit(_AFTER_TREES)), classes, leaves, least, "met-in-cells"))
    counts = met.groupBy("class").agg(F.sum("n").alias("n"))
    reached = components(met.filter("class <> root").select(F.col("class").alias("u"), F.col("root").alias("v")))
    named = classes.select("label", "h1", "h2", "class", "copies").join(unsent(counts), "class", "left").join(
        unsent(reached.withColumnRenamed("node", "class")), "class", "left").select(
        "label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "class").alias("component_id"))
    if classes.count() > SENT_ROWS:
        named = unsent(named)
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "vec_id"))
    return keyed.join(named, ["label", "h1", "h2"], "left").select(
        "vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, cosine 0.93."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)
