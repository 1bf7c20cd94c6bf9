"""Exact join of similar documents by the Jaccard coefficient of their word n-gram sets, skipping by set relations.

Sets that are equal are one class. The rarer part of a class's n-grams, long
enough that two similar sets share one, goes into an inverted index with its
position in a global order. A list is cut into two blocks by position: two
sets whose first common n-gram stands in the far block of both cannot be
similar, so far blocks meet near blocks only (index skipping).

In each list the sets of about one size are compared with one of them, their
centre. A set similar to a centre joins its cluster and takes over the centre's
answers: it needs no comparison inside the cluster, and none with a set whose
distance to the centre is more than its own distance and the threshold's, since
the Jaccard distance is a metric (answer skipping). Only what is left, pairs of
clusters that are close enough and not yet linked, is opened up.

N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import bit_filter, in_filter, stored, table
from .components import closer, components

# Buckets for the frequencies of n-grams: about one for 128 n-grams of the corpus, between these powers of two. Tasks get
# a bit for each. Frequent n-grams come last in the global order; any order gives the same links.
LEAST_BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 27
# A bucket is frequent with so many standard deviations more n-grams than the median bucket, as if n-grams fell into
# buckets at random, and with at least this many.
FREQUENT_DEVIATIONS, FREQUENT_LEAST = 4, 32
# Differences from a centre that exceed the allowed one by about this much more or less are treated alike.
EXCESS_BAND = 8
# Lists of sets of about one size with more members than this are compared with a second centre.
SECOND_CENTRE = 16
_SET_FILTER_BITS = 1 << 24
# Bits of a set's sketch: each n-gram flips one. Two sets differ in at least as many n-grams as their sketches in bits.
SKETCH_BITS = 2048
# Rows sketched at a time: a sketch takes eight bytes a bit while it is counted, however short its text is.
SKETCHED_ROWS = 256


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets of the rows): the distinct n-grams of every row in ascending order."""
    found = tb.words(data, offsets)
    at, h = tb.grams_in_rows(found, k)
    row = found.row[at]
    n = np.diff(found.first)
    for m in range(1, k):  # fewer words than k: the whole sequence is the one n-gram
        rows = np.flatnonzero(n == m)
        if len(rows):
            row = np.concatenate([row, rows])
            h = np.concatenate([h, tb.grams(found.hash, m)[found.first[rows]]])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if len(h):
        keep = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
        row, h = row[keep], h[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))])


def _digests(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set that tell sets apart; 0 for an empty set."""
    out = []
    for salt in (0x632BE59BD9B4E019, 0x9E6C63D0876A9A47):
        total = np.concatenate([[np.uint64(0)], np.cumsum(tb.mix(h ^ np.uint64(salt)))])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _sketches(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    out = []
    for at in range(0, len(bounds) - 1, SKETCHED_ROWS):
        b = bounds[at:at + SKETCHED_ROWS + 1]
        rows = len(b) - 1
        place = np.repeat(np.arange(rows) * SKETCH_BITS, np.diff(b)) + (h[b[0]:b[-1]] >> np.uint64(20) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
        bits = np.bincount(place, minlength=rows * SKETCH_BITS).astype(np.uint8) & 1
        out += [row.tobytes() for row in np.packbits(bits.reshape(rows, SKETCH_BITS), axis=1)]
    return out


class _Fresh:
    """Tells which classes come for the first time. It forgets what it saw when that gets long: a copy may pass, no class is lost."""

    def __init__(self, most: int = 1 << 16) -> None:
        self.seen, self.most = set(), most

    def __call__(self, cls: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cls), bool)
        for i, c in enumerate(cls.tolist()):
            if c not in self.seen:
                if len(self.seen) >= self.most:
                    self.seen.clear()
                self.seen.add(c)
                out[i] = True
        return out


def _indexed(least: Fraction, n: np.ndarray) -> np.ndarray:
    """How many n-grams of a set of n stand in the index: one of them is in every similar set."""
    return n - -(-least.numerator * n // least.denominator) + 1


def _held(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which values of x are in y; both ascending and not empty."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x


def _in_component(rows: DataFrame, joined: DataFrame, column: str) -> DataFrame:
    """Rows with the least class that ``joined`` links a class to, or itself; what has one of these is connected."""
    named = joined.groupBy(F.col("u").alias(column)).agg(F.min("v").alias("component"))
    return rows.join(named, column, "left").withColumn("component", F.coalesce("component", column))


class Join:
    """Documents of (doc_id, text), n-grams of k words, and the least similarity as an exact fraction."""

    def __init__(self, documents: DataFrame, k: int, least: Fraction) -> None:
        self.documents = documents.select("doc_id", "text")
        self.k, self.least = k, least

    def signatures(self) -> DataFrame:
        """(doc_id, n, class, check, sketch): size of each document's set, two digests of it and its sketch."""
        k = self.k

        @F.arrow_udf("struct<n: bigint, class: bigint, check: bigint, sketch: binary>")
        def sign(text: pa.Array) -> pa.Array:
            parts, sketches = [(np.zeros(0, np.int64),) * 3], []
            for _, data, offsets in tb.slices(text):
                h, bounds = _sets(data, offsets, k)
                parts.append((np.diff(bounds), *_digests(h, bounds)))
                sketches += _sketches(h, bounds)
            numbers = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
            return pa.StructArray.from_arrays([*numbers, pa.array(sketches, pa.binary())], ["n", "class", "check", "sketch"])

        return stored(self.documents.select("doc_id", sign("text").alias("s")).select("doc_id", "s.*"), "signatures")

    def frequent(self, signatures: DataFrame) -> np.ndarray:
        """A bit for each bucket that is frequent among the n-grams of all documents."""
        k = self.k
        total = signatures.agg(F.sum("n")).first()[0] or 0
        buckets = min(max(LEAST_BUCKETS, 1 << (total // 128).bit_length()), MOST_BUCKETS)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(buckets, np.int32)
            for batch in batches:
                for _, data, offsets in tb.slices(batch.column(0)):
                    bucket, times = np.unique((_sets(data, offsets, k)[0] & np.uint64(buckets - 1)).astype(np.int32), return_counts=True)
                    n[bucket] += times
            there = np.flatnonzero(n).astype(np.int32)
            for at in range(0, len(there), 1 << 18):
                part = there[at:at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["bucket", "n"])

        counts = stored(self.documents.select("text").mapInArrow(count, "bucket int, n int").groupBy("bucket").agg(F.sum("n").alias("n")), "buckets")
        # The mean would grow with a few very frequent n-grams, and then hide others.
        median = counts.agg(F.percentile_approx("n", 0.5)).first()[0] or 0
        least = max(FREQUENT_LEAST, median + FREQUENT_DEVIATIONS * math.sqrt(median))
        return bit_filter(counts.filter(F.col("n") > least).select(F.col("bucket").cast("bigint")), "bucket", buckets)

    def index(self, signatures: DataFrame) -> DataFrame:
        """(gram, class, n, pos): the indexed n-grams of each class, in the global order frequent last, then by hash."""
        k, indexed, frequent = self.k, partial(_indexed, self.least), self.frequent(signatures)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh = _Fresh()
            for batch in batches:
                for _, data, offsets in tb.slices(batch.column(0)):
                    h, bounds = _sets(data, offsets, k)
                    n = np.diff(bounds)
                    row = np.repeat(np.arange(len(n)), n)
                    order = np.argsort(row * 2 + in_filter(frequent, h), kind="stable")
                    pos = np.arange(len(h)) - bounds[:-1][row]
                    cls, _ = _digests(h, bounds)
                    kept = (pos < indexed(n)[row]) & fresh(cls)[row]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h[order][kept].view(np.int64)), pa.array(cls[row[kept]]), pa.array(n[row[kept]]), pa.array(pos[kept].astype(np.int32)),
                    ], ["gram", "class", "n", "pos"])

        rows = self.documents.select("text").mapInArrow(emit, "gram bigint, class bigint, n bigint, pos int")
        p, q = self.least.numerator, self.least.denominator
        near = F.col("pos") * (2 * p) <= F.col("n") * (q - p)
        # A task sends a class about once, so combining rows before the shuffle would fill its memory for nothing.
        once = rows.repartition("gram", "class").groupBy("gram", "class").agg(F.min("n").alias("n"), F.min("pos").alias("pos")).withColumn("near", near)
        once = stored(once, "grams")
        lists = once.groupBy("gram").agg(F.count("class").alias("size"), F.max("near").alias("any_near"))
        return stored(once.join(lists.filter("size > 1 AND any_near").select("gram"), "gram"), "index")

    def _may_be_similar(self, a: str, b: str):
        """Size and position filter of two index rows, or two clusters' rows."""
        p, q = self.least.numerator, self.least.denominator
        c = lambda side, name: F.col(f"{side}.{name}")
        size = (c(a, "least_n") * p <= c(b, "most_n") * q) & (c(b, "least_n") * p <= c(a, "most_n") * q)
        # Before the first common n-gram all differ: at most this many of both sets together.
        apart = (c(a, "pos") + c(b, "pos")) * (p + q) <= (c(a, "most_n") + c(b, "most_n")) * (q - p)
        return size & apart & (c(a, "near") | c(b, "near"))

    def sets_of(self, classes: DataFrame, signatures: DataFrame) -> DataFrame:
        """(class, grams): the sets of some classes, as ascending hashes; read from one document of each class."""
        k = self.k
        chosen = signatures.join(classes, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
        chosen = stored(chosen.filter("doc_id IS NOT NULL"), "chosen")
        may = bit_filter(chosen, "doc_id", _SET_FILTER_BITS)

        @F.arrow_udf("struct<class: bigint, grams: binary>")
        def grams(doc_id: pa.Array, text: pa.Array) -> pa.Array:
            wanted = in_filter(may, doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) & doc_id.is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(wanted)
            some = text.take(pa.array(rows))
            cls, values = np.zeros(len(text), np.int64), np.full(len(text), None, object)
            for first, data, offsets in tb.slices(some):
                h, bounds = _sets(data, offsets, k)
                there = rows[first:first + len(offsets) - 1]
                cls[there] = _digests(h, bounds)[0]
                raw = h.astype("<u8").tobytes()
                values[there] = [raw[8 * a:8 * b] for a, b in zip(bounds, bounds[1:], strict=False)]
            return pa.StructArray.from_arrays([pa.array(cls), pa.array(values, pa.binary())], ["class", "grams"])

        every = self.documents.select("doc_id", grams("doc_id", "text").alias("s")).filter("s.grams IS NOT NULL").select("doc_id", "s.*")
        return stored(every.join(chosen, ["doc_id", "class"]).select("class", "grams").dropDuplicates(["class"]), "sets")

    def sketched(self, pairs: DataFrame, sketches: DataFrame, name: str) -> DataFrame:
        """(a, b, apart, total): in how many n-grams the sets of a pair differ at least, and their sizes together."""

        @F.arrow_udf("bigint")
        def bits(left: pa.Array, right: pa.Array) -> pa.Array:
            if not len(left):
                return pa.array([], pa.int64())
            x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), -1) for v in (left, right))
            return pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64))

        once = stored(pairs.select("a", "b").distinct(), f"{name}-found")
        left = sketches.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        right = sketches.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        return once.join(left, "a").join(right, "b").select(
            "a", "b", bits("sketch_a", "sketch_b").alias("apart"), (F.col("n_a") + F.col("n_b")).alias("total"))

    def linkable(self, pairs: DataFrame, sketches: DataFrame, name: str) -> DataFrame:
        """The pairs that their sketches do not rule out."""
        p, q = self.least.numerator, self.least.denominator
        return self.sketched(pairs, sketches, name).filter(F.col("apart") * (p + q) <= F.col("total") * (q - p)).select("a", "b")

    def _with_sets(self, pairs: DataFrame, signatures: DataFrame, name: str) -> DataFrame:
        """Pairs of classes (a, b) with their sets as grams_a and grams_b."""
        pairs = stored(pairs.select("a", "b").distinct(), f"{name}-pairs")
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), signatures)
        left = sets.select(F.col("class").alias("a"), F.col("grams").alias("grams_a"))
        right = sets.select(F.col("class").alias("b"), F.col("grams").alias("grams_b"))
        return pairs.join(left, "a").join(right, "b")

    def compared(self, pairs: DataFrame, signatures: DataFrame, name: str) -> DataFrame:
        """(a, b, distance, linked) of pairs of classes, by their whole sets."""
        p, q = self.least.numerator, self.least.denominator

        @F.arrow_udf("struct<distance: double, linked: boolean>")
        def compare(left: pa.Array, right: pa.Array) -> pa.Array:
            distance, linked = np.zeros(len(left)), np.zeros(len(left), bool)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                both = int(np.count_nonzero(_held(x, y)))
                union = len(x) + len(y) - both
                distance[i], linked[i] = 1 - both / union, q * both >= p * union
            return pa.StructArray.from_arrays([pa.array(distance), pa.array(linked)], ["distance", "linked"])

        joined = self._with_sets(pairs, signatures, name)
        return stored(joined.select("a", "b", compare("grams_a", "grams_b").alias("c")).select("a", "b", "c.*"), name)

    def differences(self, pairs: DataFrame, signatures: DataFrame, name: str) -> DataFrame:
        """(a, b, n, delta, linked): what b has and a has not, then the reverse, each by hash; n is the size of b."""
        p, q = self.least.numerator, self.least.denominator

        @F.arrow_udf("struct<n: bigint, delta: array<bigint>, linked: boolean>")
        def differ(left: pa.Array, right: pa.Array) -> pa.Array:
            n, delta, linked = [], [], []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                more, less = y[~_held(y, x)], x[~_held(x, y)]
                n.append(len(y))
                delta.append(np.concatenate([more, less]).view(np.int64))
                linked.append(q * (len(y) - len(more)) >= p * (len(x) + len(more)))
            fields = [pa.array(n, pa.int64()), pa.array(delta, pa.list_(pa.int64())), pa.array(linked, pa.bool_())]
            return pa.StructArray.from_arrays(fields, ["n", "delta", "linked"])

        joined = self._with_sets(pairs, signatures, name)
        return stored(joined.select("a", "b", differ("grams_a", "grams_b").alias("c")).select("a", "b", "c.*"), name)

    def _star(self, rows: DataFrame, leader: DataFrame) -> DataFrame:
        """(a, b): the leader of each list and band with the others there that may be similar to it."""
        leader = leader.join(rows, ["gram", "band", "class"]).alias("l")
        star = rows.alias("m").join(leader, ["gram", "band"]).filter((F.col("l.class") != F.col("m.class")) & self._may_be_similar("l", "m"))
        return star.select(F.col("l.class").alias("a"), F.col("m.class").alias("b"))

    def links(self, signatures: DataFrame) -> DataFrame:
        """(u, v): links between classes that connect whatever similarity connects."""
        index = self.index(signatures)
        sketches = stored(signatures.join(index.select("class").distinct(), "class", "left_semi").groupBy("class").agg(
            F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
        # The sets of about one size in a list meet the one with the smallest hash among the near ones.
        band = F.floor(F.log("n") / math.log(1 / float(self.least))) if self.least < 1 else F.col("n")
        rows = index.select("gram", "class", "pos", "near", F.col("n").alias("least_n"), F.col("n").alias("most_n"), band.alias("band"))
        leader = rows.filter("near").groupBy("gram", "band").agg(F.min_by("class", F.xxhash64("class")).alias("class"))
        first = self.compared(self.linkable(self._star(rows, leader), sketches, "first"), signatures, "first-centres")
        # In long lists the set nearest to that one is a better centre: it is likelier to be what all are copies of.
        long = rows.groupBy("gram", "band").agg(F.count("class").alias("size")).filter(F.col("size") > SECOND_CENTRE).join(
            leader.withColumnRenamed("class", "a"), ["gram", "band"])
        nearest = first.groupBy("a").agg(F.min_by("b", F.struct("distance", F.xxhash64("b"))).alias("class"))
        better = long.join(nearest, "a").select("gram", "band", "class")
        fresh = self.linkable(self._star(rows, better).join(first, ["a", "b"], "left_anti"), sketches, "second")
        first = first.unionByName(self.compared(fresh, signatures, "second-centres"))
        linked = first.filter("linked")
        cluster = stored(linked.groupBy(F.col("b").alias("class")).agg(
            F.min_by("a", F.struct("distance", "a")).alias("centre"), F.min("distance").alias("distance")), "clusters")
        # Only connection is asked for: what the first links are seen to connect, in one round, need not meet again.
        joined = closer(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))
        member = rows.join(cluster, "class", "left").select(
            "gram", "pos", "near", "least_n", "most_n", F.coalesce("centre", "class").alias("centre"))
        grouped = member.groupBy("gram", "centre").agg(
            F.min("pos").alias("pos"), F.max("near").alias("near"), F.min("least_n").alias("least_n"), F.max("most_n").alias("most_n"))
        grouped = _in_component(grouped, joined, "centre")
        several = grouped.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("gram")
        open_lists = stored(grouped.join(several, "gram"), "open-lists")
        crossing = open_lists.alias("x").join(open_lists.alias("y"), "gram").filter(
            (F.col("x.component") != F.col("y.component")) & (F.col("x.centre") < F.col("y.centre")) & self._may_be_similar("x", "y"))
        # Centres farther apart than their members can bridge are out.
        reach = F.lit(1 - float(self.least) + 1e-9)
        pairs = self.sketched(crossing.select(F.col("x.centre").alias("a"), F.col("y.centre").alias("b")), sketches, "crossing")
        radius = cluster.groupBy("centre").agg(F.max("distance").alias("radius"))
        for side in ("a", "b"):
            pairs = pairs.join(radius.select(F.col("centre").alias(side), F.col("radius").alias(f"radius_{side}")), side, "left")
            reach = reach + F.coalesce(f"radius_{side}", F.lit(0.0))
        pairs = stored(pairs.filter(2 * F.col("apart") / (F.col("total") + F.col("apart")) <= reach).select("a", "b"), "crossing")
        done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance", "linked").distinct()
        second = self.compared(pairs.join(done, ["a", "b"], "left_anti"), signatures, "centres")
        known = second.unionByName(pairs.join(done, ["a", "b"]).select("a", "b", "distance", "linked"))
        # The same for clusters, by all links so far.
        joined = closer(joined.unionByName(second.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))))
        apart = known.filter("NOT linked")
        for side in ("a", "b"):
            apart = _in_component(apart, joined, side).withColumnRenamed("component", f"component_{side}")
        opened = self._opened(apart.filter("component_a <> component_b"), cluster, signatures)
        return joined.unionByName(opened)

    def _opened(self, centres: DataFrame, cluster: DataFrame, signatures: DataFrame) -> DataFrame:
        """Links between members of clusters whose centres are not similar but near enough that members can be.

        Members y of a and z of b are written as their differences from a. y and z
        differ in just what one of the two differences holds, so unless z links with a,
        similar ones must have some of them in common: members meet through the rarer
        part of their differences, never all with all.
        """
        apart = 1 - float(self.least) + 1e-9
        shape = cluster.groupBy("centre").agg(F.max("distance").alias("radius"), F.count("class").alias("size"))
        near = centres
        for side in ("a", "b"):
            near = near.join(shape.select(F.col("centre").alias(side), F.col("radius").alias(f"radius_{side}"), F.col("size").alias(f"size_{side}")), side, "left")
        reach = F.coalesce("radius_a", F.lit(0.0)) + F.coalesce("radius_b", F.lit(0.0))
        near = near.filter((reach > 0) & (F.col("distance") <= reach + apart))
        swap = F.coalesce("size_a", F.lit(0)) < F.coalesce("size_b", F.lit(0))
        near = stored(near.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")), "near")
        members = cluster.select("centre", "class")
        mine = members.join(near.select(F.col("a").alias("centre")).distinct(), "centre", "left_semi").select(
            F.col("centre").alias("a"), F.col("class").alias("b"), F.lit(True).alias("inside"))
        others = near.join(members.select(F.col("centre").alias("b"), "class"), "b").select("a", F.col("class").alias("b")).unionByName(near).distinct()
        both = mine.unionByName(others.withColumn("inside", F.lit(False)))
        delta = self.differences(both, signatures, "deltas").join(both, ["a", "b"])
        direct = delta.filter("NOT inside AND linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        # Similar sets of n and m differ in at most (n + m) * share, so of what differs from a they have at least half of
        # what both have in excess in common. Rows of about one excess make a band; how much must be common is known by
        # the two bands of a pair, and the rest of a difference, rarest first, is long enough for them to meet in.
        p, q = self.least.numerator, self.least.denominator
        excess = F.size("delta") - F.col("n") * ((q - p) / (p + q))
        rest = stored(delta.filter("inside OR NOT linked").select(
            "a", "b", "inside", "delta", excess.alias("excess"), F.floor(excess / EXCESS_BAND).alias("band")), "differences")
        # One order for all that meet at a: by how many of the differences hold an n-gram.
        flat = rest.select("a", "b", "inside", F.explode("delta").alias("gram"))
        held = flat.groupBy("a", "gram").agg(F.count("b").alias("times"))
        ordered = flat.join(held, ["a", "gram"]).groupBy("a", "b", "inside").agg(
            F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("ordered"))
        bands = stored(rest.groupBy("a", "inside", "band").agg(F.min("excess").alias("lowest")), "bands")
        met = bands.select("a", (~F.col("inside")).alias("inside"), F.col("band").alias("other_band"), F.col("lowest").alias("other_lowest"))
        own = bands.select("a", "inside", "band", F.col("lowest").alias("own_lowest"))
        common = F.greatest(F.lit(1), F.ceil((F.col("own_lowest") + F.col("other_lowest")) / 2 - 1e-6).cast("int"))
        size = F.size("ordered") - common + 1
        part = rest.drop("delta").join(ordered, ["a", "b", "inside"]).join(own, ["a", "inside", "band"]).join(met, ["a", "inside"]).filter(
            size > 0).select("a", "b", "inside", "band", "other_band", F.explode(F.slice("ordered", F.lit(1), size)).alias("g"))
        inner = part.filter("inside").select("a", F.col("b").alias("y"), F.col("band").alias("i"), F.col("other_band").alias("j"), "g.gram")
        outer = part.filter("NOT inside").select("a", F.col("b").alias("z"), F.col("band").alias("j"), F.col("other_band").alias("i"), "g.gram")
        pairs = inner.join(outer, ["a", "gram", "i", "j"]).select(F.col("y").alias("a"), F.col("z").alias("b")).filter("a <> b")
        return direct.unionByName(self.compared(pairs, signatures, "members").filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))


def similar_documents(documents: DataFrame, k: int, least: Fraction) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text).

    Words are what stands between ASCII white space, A-Z as a-z. A set holds the
    distinct runs of k words; with fewer words it is the one run of all of them.
    Two documents link if their sets' Jaccard coefficient is at least ``least``, an
    exact fraction; component_id is the smallest doc_id that links reach. A null
    text or one without words has an empty set and links with nothing. Rows with
    one doc_id are one document. A null doc_id has no component.
    """
    join = Join(documents, k, least)
    signed = join.signatures()
    signatures = signed.drop("sketch")
    nodes = signatures.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(nodes.groupBy("class", "check", "n").agg(F.min("doc_id").alias("least_id")), "classes")
    links = join.links(signed)
    # Classes and the documents that stand in for them make one graph: a document's smallest class-mate is its neighbour.
    name = classes.select(F.col("class").alias("u"), F.col("least_id"))
    by_id = links.join(name, "u").select(F.col("least_id").alias("x"), F.col("v").alias("u")).join(name, "u").select(
        F.col("x").alias("u"), F.col("least_id").alias("v"))
    several = nodes.groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high")
    repeated = nodes.join(several.select("doc_id"), "doc_id", "left_semi").join(classes, ["class", "check", "n"]).select(
        F.col("doc_id").alias("u"), F.col("least_id").alias("v"))
    reached = components(by_id.unionByName(repeated))
    named = classes.join(reached, classes["least_id"] == reached["node"], "left").select(
        "class", "check", "n", F.coalesce("component", "least_id").alias("component_id"))
    return signatures.join(named, ["class", "check", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sets of three words, similarity 0.9."""
    return similar_documents(table(spark, sf_dir, "documents"), 3, Fraction(9, 10))
