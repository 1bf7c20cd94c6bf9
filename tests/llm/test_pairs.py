"""Near duplicates and shared passages against brute force."""

import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import helpers
import numpy as np
import pyarrow as pa
import pytest

from wattledger.llm import components as graph
from wattledger.llm import forest, setjoin, trees, winnow
from wattledger.llm import textbytes as tb
from wattledger.llm.components import components


def reach(nodes, links):
    """node -> smallest node that links reach."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (1, 2), (2, 1), (1, 2)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    nodes = {n for link in links for n in link}
    want = {n: m for n, m in reach(nodes, links).items() if any(n in link and link[0] != link[1] for link in links)}
    assert {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()} | {
        n: n for n in want if want[n] == n} == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_rounds_of_stars_are_planned_in_steps_of_one_join(spark, monkeypatch):
    plans, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: (
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")), stored(df, name))[1])
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "u bigint, v bigint")
    derived = links.join(links.select("u").distinct(), "u")
    assert {r.u for r in graph.closer(derived).collect()} == {2, 3, 5}
    assert components(derived).count() > 0
    assert max(plans) == 1


def planned(monkeypatch, *modules):
    """Physical plans of all tables that the modules store from now on."""
    plans = []
    for module in modules:
        monkeypatch.setattr(module, "stored", lambda df, name, *by, f=module.stored: (
            plans.append(df._jdf.queryExecution().executedPlan().toString()), f(df, name, *by))[1])
    return plans


def test_many_edges_are_not_broadcast(spark, monkeypatch):
    # Numbers in a row take about a byte each in a file, by which Spark would send them all through the driver.
    plans, n = planned(monkeypatch, graph), 120_000
    star = spark.range(1, n).selectExpr("id AS u", "0L AS v")
    got = components(star)
    assert got.count() == n - 1 and got.agg({"component": "max"}).first()[0] == 0
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_many_short_texts(monkeypatch):
    texts = pa.array([f"w{i}" for i in range(20_000)])
    (_, data, offsets), = tb.slices(texts)
    h, bounds = setjoin._sets(data, offsets, 3)
    every = []
    assert peak_mb(lambda: every.extend(setjoin._sketches(h, bounds))) < 32
    assert len(every) == 20_000 and all(np.unpackbits(np.frombuffer(x, np.uint8)).sum() == 1 for x in every)
    alone = setjoin._sketches(h[300:301], np.array([0, 1]))
    assert every[300:301] == alone and every[301:302] != alone
    assert setjoin._sketches(h[:0], np.zeros(1, np.int64)) == []


def test_memory_of_words_does_not_follow_the_column(monkeypatch):
    monkeypatch.setattr(tb, "_powers", [])
    column = pa.array(["some words of a text " * 50] * 2000)
    assert peak_mb(lambda: [len(tb.words(data, offsets).row) for _, data, offsets in tb.slices(column)]) < 24


def test_copies_send_their_class_once_until_it_is_forgotten():
    fresh = setjoin._Fresh(2)
    assert fresh(np.array([1, 1, 2])).tolist() == [True, False, True]
    assert fresh(np.array([2, 1])).tolist() == [False, False]
    assert fresh(np.array([3, 1, 3])).tolist() == [True, True, False]


def sets_of(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_join(rows, k, least):
    sets = {(i, t): sets_of(t, k) for i, t in rows}
    links = [(a[0], b[0]) for a in sets for b in sets if a[0] is not None and b[0] is not None and sets[a] and sets[b]
             and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= least]
    component = reach({i for i, _ in rows if i is not None}, links)
    return Counter((i, len(sets[i, t]), component.get(i)) for i, t in rows)


def near_copies(seed, n, words=60):
    """Unrelated texts, and copies of a few with one to eight words changed, shuffled."""
    rng = random.Random(seed)
    bases = [[rng.choice("the of and in to it".split()) if rng.random() < 0.3 else f"w{rng.randrange(4000)}" for _ in range(words)] for _ in range(4)]
    texts = []
    for i in range(n):
        text = list(rng.choice(bases)) if i % 3 else [f"u{rng.randrange(3000)}" for _ in range(rng.randrange(1, words))]
        if i % 3:
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                text[rng.randrange(len(text))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(text))
    return list(enumerate(texts))


@pytest.mark.parametrize("k, least, words, seed", [
    (3, Fraction(9, 10), 120, 2), (5, Fraction(8, 10), 60, 3),
])
def test_join_finds_what_brute_force_finds(spark, k, least, words, seed, monkeypatch):
    monkeypatch.setattr(setjoin, "FREQUENT_LEAST", 6)
    monkeypatch.setattr(setjoin, "SECOND_CENTRE", 3)
    rows = near_copies(seed, 240, words)
    docs = helpers.documents(spark, [(i, t, "en") for i, t in rows])
    assert Counter(map(tuple, setjoin.similar_documents(docs, k, least).collect())) == brute_join(rows, k, least)


def test_join_of_odd_documents(spark):
    docs = helpers.odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, setjoin.similar_documents(docs, 3, Fraction(9, 10)).collect())) == brute_join(rows, 3, Fraction(9, 10))
    assert setjoin.similar_documents(helpers.empty_documents(spark), 3, Fraction(9, 10)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, n bigint, class string").select("vec_id", "embedding", "label", "n", "class")


def brute_vectors(rows, least):
    fit = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        fit[i] = (label, np.array(v, np.float32).astype(float))
    links = [(a, b) for a, (la, x) in fit.items() for b, (lb, y) in fit.items()
             if a != b and la == lb and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least]
    ids = {r[0] for r in rows if r[0] is not None}
    return links, reach(ids, links), ids


def test_forest_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 40)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        base = rng.standard_normal(24) if i % 3 == 0 or not rows else np.array(rows[int(rng.integers(len(rows)))][1]) + 0.12 * rng.standard_normal(24) * (i % 2)
        rows.append((i, [float(x) for x in np.float32(base)], int(i % 2), 0, "x"))
    links, component, ids = brute_vectors(rows, 0.93)
    got = {r.vec_id: r for r in forest.near_duplicates(vectors(spark, rows), 0.93).collect()}
    assert got.keys() == ids
    n = Counter(a for a, _ in links)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got.values()} == {(i, n[i], component[i], component[i] == i) for i in ids}
    # The trees alone: no link twice, nearly all of them.
    alone = forest.near_duplicates(vectors(spark, rows), 0.93, complete=False).collect()
    assert all(r.n_links <= n[r.vec_id] for r in alone) and sum(r.n_links for r in alone) >= 0.95 * len(links)


def test_trees_have_one_home_each(spark, monkeypatch):
    monkeypatch.setattr(trees, "PART", 500)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(24))], int(i >= 3000), 0, "x") for i in range(3030)]
    keyed = vectors(spark, rows).selectExpr("vec_id", "embedding", "label", "xxhash64(embedding) AS h1", "hash(embedding) AS h2")
    found = trees.leaves(forest.classes_of(keyed), 0.93, 40, 1).toPandas()
    large, small = found[found["class"] < 3000], found[found["class"] >= 3000]
    assert small["home"].all() and set(zip(small["tree"], small["node"], strict=True)) == {(0, 1)} and len(small) == 30
    assert large[large["home"]].groupby(["class", "tree"]).size().tolist() == [1] * (3000 * trees.TREES)
    assert not large.duplicated(["class", "tree", "node"]).any()
    # More than one round of splits, into leaves near the size asked for.
    assert large["node"].max() >= 2 << trees.STEP and large.groupby(["tree", "node"]).size().median() <= 60


def one_cluster(n, groups=1, dim=64):
    """Vectors around one or a few centres: within a group most pairs link and many are close to the limit."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((groups, dim)) / np.sqrt(dim)
    x = np.float32(centres[rng.integers(groups, size=n)] + 0.0285 * rng.standard_normal((n, dim)))
    return [(i, v, 0, 0, "x") for i, v in enumerate(x.tolist())], x.astype(float)


@pytest.mark.parametrize("n, groups, tile", [(3000, 1, 400), (3000, 12, 400), (3000, 12, 4000)])
def test_no_link_of_a_dense_group_is_lost(spark, monkeypatch, n, groups, tile):
    monkeypatch.setattr(forest, "LEAF", 100)
    monkeypatch.setattr(forest, "TILE_VALUES", tile * 64)
    rows, x = one_cluster(n, groups)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in forest.near_duplicates(vectors(spark, rows), 0.93).collect()}
    assert [got[i].n_links for i in range(n)] == linked.sum(1).tolist()
    component = np.arange(n)
    while (low := np.minimum(component, np.where(linked, component, n).min(1))).tolist() != component.tolist():
        component = low
    assert [got[i].component_id for i in range(n)] == component.tolist()


@pytest.mark.parametrize("groups", [1, 12])
def test_tables_of_vectors_are_not_broadcast(spark, monkeypatch, groups):
    monkeypatch.setattr(forest, "LEAF", 100)
    monkeypatch.setattr(forest, "SENT_ROWS", 500)
    plans = planned(monkeypatch, forest, trees)
    out = forest.near_duplicates(vectors(spark, one_cluster(1000, groups)[0]), 0.93)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    # Joins by cell may send their smaller side, a row for each cell of many vectors; those by vector or class nothing.
    sent = re.findall(r"BroadcastHashJoin \[(\w+).*?(BuildLeft|BuildRight)", "\n".join(plans))
    assert sent and set(sent) == {("cell", "BuildRight")}


def test_cells_take_groups_apart(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 100)
    rows, _ = one_cluster(3000, 12)
    keyed = vectors(spark, rows).selectExpr("vec_id", "embedding", "label", "xxhash64(embedding) AS h1", "hash(embedding) AS h2")
    found = forest.cells(forest.classes_of(keyed), 0.93)
    assert found.filter("home").count() == 3000 == found.filter("home").select("class").distinct().count()
    assert found.select("cell").distinct().count() > 6 and found.count() < 2 * 3000


def test_forest_of_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 0, 0, ""), (2, v, 0, 0, ""), (3, v, 1, 0, ""), (4, [2.0, 4.0, 6.0], 0, 0, ""), (5, None, 0, 0, ""), (6, [0.0] * 3, 0, 0, ""),
        (7, [float("nan"), 1.0, 1.0], 0, 0, ""), (8, [None, 2.0, 3.0], 0, 0, ""), (9, v, None, 0, ""), (10, [], 0, 0, ""), (None, v, 0, 0, ""),
        (1, v, 0, 0, ""), (11, [1.0, 2.0], 0, 0, ""), (12, [float("inf")] * 3, 0, 0, ""), (13, [-1.0, -2.0, -3.0], 0, 0, ""),
    ]
    got = {r.vec_id: tuple(r)[1:] for r in forest.near_duplicates(vectors(spark, rows), 0.93).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 4: (2, 1, False), 3: (0, 3, True), None: (0, None, False)} | {
        i: (0, i, True) for i in (5, 6, 7, 8, 9, 10, 11, 12, 13)}
    assert forest.near_duplicates(vectors(spark, []), 0.93).count() == 0


def test_forest_on_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    links, component, ids = brute_vectors(rows, 0.93)
    got = forest.query(spark, "/root/testdata/sf0.001").collect()
    n = Counter(a for a, _ in links)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, n[i], component[i], component[i] == i) for i in ids}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items):
    import hashlib

    out = Counter()
    for doc_id, text in docs:
        words, hit, named = words_of(text), set(), set()
        for item_id, item in set(items):
            w = words_of(item)
            m = min(10, len(w))
            windows = {tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if w else set()
            for s in range(len(words) - m + 1) if windows else ():
                if tuple(words[s:s + m]) in windows:
                    hit.update(range(s, s + m))
                    named.add(item_id)
        ids = ",".join(sorted(str(i) for i in named if i is not None))
        out[doc_id, len(words), len(hit), len(named - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)] += 1
    return out


def test_contamination_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd ef gh ij The of 12 üb".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 8, 9, 10, 11, 14, 30])))) for i in range(14) if i % 5]
    items += [(90, None), (91, " - "), (92, items[0][1]), (1, items[0][1]), (None, "q r s")]
    docs = []
    for i in range(60):
        parts = [word() if rng.random() < 0.5 else f"z{rng.randrange(99)}" for _ in range(rng.randrange(0, 60))]
        if i % 2:
            parts += (rng.choice(items)[1] or "").split() + parts[:4]
        docs.append((i, (", " if i % 3 else " ").join(parts)))
    docs += [(1, None), (1, "other"), (None, items[0][1]), (None, ""), (200, items[0][1]), (200, items[0][1]), (300, "q, R-s q r")]
    frame = helpers.documents(spark, [(i, t, "en") for i, t in docs])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter(map(tuple, winnow.contamination(frame, bench).collect()))
    assert got == brute_contamination(docs, items)


def test_contamination_of_odd_tables(spark):
    docs = helpers.odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bench = spark.createDataFrame([(1, "x" * 5000), (2, "w " * 12), (3, None)], "item_id bigint, text string")
    assert Counter(map(tuple, winnow.contamination(docs, bench).collect())) == brute_contamination(rows, [(r.item_id, r.text) for r in bench.collect()])
    assert not winnow.contamination(docs, bench.limit(0)).filter("contaminated").count()
    assert winnow.contamination(helpers.empty_documents(spark), bench).count() == 0
