"""Operators against brute force on small random or literal inputs."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.operators import batches, clustering, coref, dedup, links, metrics, pages, partition, sampling, sentences, subgraphs
from linkloom.operators import components
from linkloom.operators.components import chained, connected_components, extended
from linkloom.operators.materialize import TASK_ROWS, Scratch, few
from linkloom.plans import dedup_queries
from linkloom.plans.stages import Stage, run_stages
from linkloom.sources import tables
from linkloom.sources.html import parse_page


def components_by_hand(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(12)], [(0, i) for i in range(1, 30)] + [(50, 51)], [(random.Random(i).randrange(60), random.Random(i + 99).randrange(60)) for i in range(40)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == components_by_hand([(a, b) for a, b in edges if a != b])


def test_stars_need_no_round(spark, monkeypatch):
    # A star is written once as links and once as components; before, two rounds were.
    tables_written, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: tables_written.append(df) or keep(self, df))
    edges = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(50, 51)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {0: 0, 50: 50, 51: 50} | {i: 0 for i in range(1, 30)}
    assert len(tables_written) == 1


def test_components_are_extended(spark, monkeypatch):
    # Only links between different components are contracted again; components merge, grow and appear.
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(30)]
    more = [(e[0], e[1]) for e in edges[:10]] + [(rng.randrange(90), rng.randrange(90)) for _ in range(25)] + [(200, 201), (7, 7)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    scratch, given, known = Scratch(spark), [], components_by_hand([e for e in edges if e[0] != e[1]])
    parts = connected_components(table(edges), "a", "b", scratch)
    monkeypatch.setattr(components, "connected_components", lambda e, *rest: given.extend(e.collect()) or connected_components(e, *rest))
    grown = {r.node: r.component for r in extended(parts, table(more), "a", "b", scratch).collect()}
    assert grown == components_by_hand([e for e in edges + more if e[0] != e[1]])
    ends = [(known.get(a, a), known.get(b, b)) for a, b in more]
    assert sorted((r.a, r.b) for r in given) == sorted({e for e in ends if e[0] != e[1]})
    same = {r.node: r.component for r in extended(parts, table(edges), "a", "b", scratch).collect()}
    scratch.clear()
    assert same == known


def test_components_are_extended_without_a_round_for_known_links(spark):
    scratch = Scratch(spark)
    parts = connected_components(spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"), "a", "b", scratch)
    assert extended(parts, spark.createDataFrame([(0, 2)], "a long, b long"), "a", "b", scratch) is parts
    scratch.clear()


def test_chained(spark):
    pairs = spark.createDataFrame([(1, 5), (1, 3), (1, 9), (2, 3), (2, 5), (4, 9)], "key long, other long")
    assert sorted((r.a, r.b) for r in chained(pairs, "key", "other").collect()) == [(3, 5), (3, 9)]


def test_small_tables_are_few_files(spark):
    parts = spark.range(0, 1000, 1, 60)
    assert few(parts, 1000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert few(parts, 50 * TASK_ROWS).rdd.getNumPartitions() == 51
    assert sorted(r.id for r in few(parts, 1000).collect()) == list(range(1000))


def test_token_spans_meet_sentences(spark):
    # Against the join of tokens by both edges; keys that repeat give each beginning with each end, null keys nothing.
    texts = [(1, 0, "One, two  three."), (1, 1, "é😀x y"), (2, 0, "ab cd ef"), (2, 0, "ab  d ef"), (2, 0, "ab cd ef"), (3, 0, None), (None, 0, "One two"), (4, 0, "")]
    asked = [(k, i, s, e) for k, i in {(k, i) for k, i, _ in texts} for s in (None, 0, 1, 3, 5, 6) for e in (None, 2, 3, 5, 8, 16)] * 2
    keys = "k long, i long"
    sents = spark.createDataFrame(texts, f"{keys}, sentence string")
    tokens = [(k, i, n, s, e) for k, i, t in texts if t and k is not None for n, s, e in sentences.token_offsets(t)]
    want = Counter((*a, b[2], e[2] + 1) for a in asked for b in tokens for e in tokens if a[:3] == (b[0], b[1], b[3]) and (a[0], a[1], a[3]) == (e[0], e[1], e[4]) and e[2] >= b[2])
    rows = sentences.token_spans(spark.createDataFrame(asked, f"{keys}, s long, e long"), sents, ["k", "i"], start="s", end="e")
    assert Counter(map(tuple, rows.select("k", "i", "s", "e", "token_idx_from", "token_idx_to").collect())) == want and len(want) > 10
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") <= 3


def test_substring_filter_without_blacklist_drops_all(spark):
    df = spark.createDataFrame([("a/x",), ("b",)], "url string")
    assert pages.substring_filter(df, F.col("url")).count() == 0
    assert [r.url for r in pages.substring_filter(df, F.col("url"), (), ["x"]).collect()] == ["a/x"]


def test_degree_cutoff_of_one_keeps_everything(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 3)], "src long, dst long")
    assert links.without_high_degrees(edges, "src", "dst", 1.0, 1.0).count() == 3
    assert links.degree_histogram(edges, "src", "dst").where("direction = 'in' AND degree = 0").first().n_pages == 2


def test_selected_prefixes_nearest_to_mass(spark):
    rows = [("com/a/S/x",)] * 5 + [("com/a/S/y",)] * 3 + [("com/b/S",)] * 2
    got = links.selected_prefixes(spark.createDataFrame(rows, "g string"), "g", 0.8).collect()
    assert [(r.prefix, r.n) for r in got] == [("com/a/S/x", 5), ("com/a/S/y", 3)]
    assert links.selected_prefixes(spark.createDataFrame([], "g string"), "g", 0.8).count() == 0


def test_html_spans():
    # Nested tags, an anchor that starts with a space, several sentences in a paragraph.
    page = """<div><p>Our ferry left <a href="http://port.example/times">well before noon</a> that day.</p>
    <p>Rain fell. Nobody had<a href="http://port.example/coats"> brought any coats along</a>. Later on we found <a href="http://port.example/inn">a small inn</a>, luckily open.</p>
    <p>Its owner sold <a href="http://port.example/maps">maps <b>drawn by</b> hand</a>! Splendid.</p></div>"""

    def anchors(markup):
        found, links = parse_page(markup)
        assert all(a == found[i].index(found[i][a:b]) for i, a, b, _ in links)
        return len(found), [(i, found[i][a:b], url.rpartition("/")[2]) for i, a, b, url in links]

    assert anchors(page) == (6, [(0, "well before noon", "times"), (2, " brought any coats along", "coats"), (3, "a small inn", "inn"), (4, "maps drawn by hand", "maps")])
    # A soft hyphen, doubled spaces; an anchor across a sentence's end; the same words twice.
    assert anchors('<p>They met <a href="d">an old &shy;lighthouse keeper</a>  near town.</p><p>He waved.</p>') == (2, [(0, "an old lighthouse keeper", "d")])
    assert anchors('<p>Take <a href="d">this road. </a>Take <a href="e">that road.</a></p>') == (2, [(0, "this road.", "d"), (1, "that road.", "e")])
    assert parse_page("<p> <a href=''>x</a></p>")[1] == [] and parse_page("") == ([], [])


def test_sentences_and_tokens(spark):
    df = spark.createDataFrame([(1, "One two. Three!  \n\nFour"), (2, ""), (3, None)], "k long, t string")
    got = sentences.split_sentences(df, "k", "t").collect()
    assert [(r.sentence_idx, r.sentence, r.chars_start) for r in got] == [(0, "One two.", 0), (1, "Three!", 9), (2, "Four", 19)]
    toks = sentences.tokenize(sentences.split_sentences(df, "k", "t"), ["k", "sentence_idx"], "sentence").where("sentence_idx = 0").collect()
    assert [(r.token_idx, r.token, r.chars_start, r.chars_end) for r in toks] == [(0, "One", 0, 3), (1, "two", 4, 7), (2, ".", 7, 8)]


def assignment_by_hand(w):
    if w.shape[0] > w.shape[1]:
        w = w.T
    return max(sum(w[i, p[i]] for i in range(w.shape[0])) for p in itertools.permutations(range(w.shape[1]), w.shape[0]))


def test_assignment():
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = rng.integers(0, 9, rng.integers(1, 6, 2)).astype(float)
        assert abs(metrics.assigned(w) - assignment_by_hand(w)) < 1e-9


def linkage_by_hand(d, t):
    clusters = [[i] for i in range(len(d))]
    while len(clusters) > 1:
        best = min((np.mean([d[x][y] for x in a for y in b]), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        if best[0] > t:
            break
        clusters[best[1]] += clusters.pop(best[2])
    return {frozenset(c) for c in clusters}


def test_average_linkage():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 12):
        x = rng.random((n, n))
        d = (x + x.T) / 2
        labels = clustering.average_linkage(d, 0.45)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels)} == linkage_by_hand(d, 0.45)


def test_what_rounds_leave_is_solved_in_a_task(spark, monkeypatch):
    # Points on a circle with growing gaps: a round merges one pair, so rounds alone took one for each point.
    angle = np.cumsum(np.arange(1, 13)) * 0.01
    rows = spark.createDataFrame([("a", i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(angle)], "g string, k long, v array<double>")
    monkeypatch.setattr(clustering, "IN_TASK", 10)
    rounds, one = [], clustering.vector_round
    monkeypatch.setattr(clustering, "vector_round", lambda *a: rounds.append(1) or one(*a))
    forest = clustering.vectors_forest(rows, "g", "k", "v", 1.0)
    d = np.maximum(0, 1 - np.cos(angle[:, None] - angle))
    assert sorted(round(r.height, 9) for r in forest.collect()) == sorted(round(h, 9) for _, _, h in clustering.merges_of(d, 1.0))
    assert 0 < len(rounds) <= 2


def test_dense_vectors_are_a_matrix():
    table = lambda idx: pa.table({"node": [1, 2], "n": [1, 2], "idx": pa.array(idx, pa.list_(pa.int64())), "val": pa.array([[0.6, 0.8], [2.0, 0.0]], pa.list_(pa.float64()))})
    dense, sparse = clustering.Vectors(table([[0, 1], [0, 1]])), clustering.Vectors(table([[0, 1], [0, 2]]))
    assert dense.matrix is not None and sparse.matrix is None
    assert np.allclose(dense.distances(dense), [[0, 0.4], [0.4, 0]]) and np.allclose(sparse.distances(dense), [[0, 0.4], [0.4, 0]])


def test_equal_members_are_contracted_before_clustering(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(8, 3)).round(2)[rng.integers(0, 8, 30)], np.zeros((3, 3))])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = linkage_by_hand(np.maximum(0, 1 - unit @ unit.T), 0.5)

    def found(labelled):
        clusters = {}
        for r in labelled.collect():
            clusters.setdefault((r.g, r.label), set()).add(r.k)
        return {frozenset(c) for c in clusters.values()}

    limit = clustering.IN_TASK
    rows = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(x)], "g string, k long, v array<double>")
    for most, block in ((limit, clustering.BLOCK), (3, 4)):  # in one task, and in rounds over blocks
        monkeypatch.setattr(clustering, "IN_TASK", most)
        monkeypatch.setattr(clustering, "BLOCK", block)
        assert found(clustering.cluster_vectors(rows, "g", "k", "v", 0.5)) == want
    grams = [(None, i, f"g{j}", float(v)) for i, r in enumerate(unit) for j, v in enumerate(r) if v] + [(None, i, None, None) for i in (30, 31, 32)]
    weights = spark.createDataFrame(grams, "g string, k long, gram string, weight double")
    assert found(clustering.cluster_texts(weights, "g", "k", 0.5)) == want
    assert clustering.cluster_texts(weights.where("false"), "g", "k", 0.5).count() == 0
    whole = linkage_by_hand(np.maximum(0, 1 - unit @ unit.T), 1.0)
    assert len(found(clustering.cluster_texts(weights, "g", "k", 1.0))) == len(whole)


@pytest.mark.parametrize("most", [4, 2])
def test_texts_are_clustered_by_components(spark, monkeypatch, most):
    """A group of forty documents in parts of at most four; parts of three and four in rounds too."""
    rng = np.random.default_rng(7)
    docs = [(g, i, f"{i // 4}-{j}", float(w)) for g in ("a", "b") for i in range(40) for j, w in enumerate(rng.random(5)) if w > 0.3]
    frame = pd.DataFrame(docs, columns=["g", "k", "gram", "weight"])
    frame["weight"] /= np.sqrt((frame["weight"] ** 2).groupby([frame["g"], frame["k"]]).transform("sum"))
    monkeypatch.setattr(clustering, "IN_TASK", most)
    got = clustering.cluster_texts(spark.createDataFrame(frame), "g", "k", 0.2).toPandas()
    for g, rows in frame.groupby("g"):
        keys = sorted(rows["k"].unique())
        x = rows.pivot(index="k", columns="gram", values="weight").fillna(0).loc[keys].to_numpy()
        mine = got[got["g"] == g].groupby("label")["k"].apply(frozenset)
        assert {frozenset(keys[i] for i in c) for c in linkage_by_hand(np.maximum(0, 1 - x @ x.T), 0.2)} == set(mine)
        assert list(mine.index) == list(range(len(mine))) and [min(c) for c in mine] == sorted(min(c) for c in mine)


@pytest.mark.parametrize("linkage", clustering.LINKAGES)
def test_forests_of_pairs_and_their_cuts(spark, monkeypatch, linkage):
    rng = np.random.default_rng(5)
    n, thresholds = 12, [0.2, 0.4, 0.7]
    pairs = [(i + 100 * g, j + 100 * g, float(rng.random())) for g in range(2) for i in range(n) for j in range(i) if rng.random() < 0.9]
    far = {frozenset(p[:2]): p[2] for p in pairs}
    mean = {"average": np.mean, "complete": max, "single": min}[linkage]

    def by_hand(t):
        clusters = [[i + 100 * g] for g in range(2) for i in range(n)]
        while True:
            d = lambda x, y: mean([far.get(frozenset((p, q)), 1.0 if linkage == "average" else np.inf) for p in x for q in y])
            best = min((d(x, y), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
            if best[0] > t:
                return {frozenset(c) for c in clusters}
            clusters[best[1]] += clusters.pop(best[2])

    rows = spark.createDataFrame(pairs, "a long, b long, distance double")
    nodes = spark.range(n).union(spark.range(100, 100 + n)).toDF("node")
    for most in (clustering.IN_TASK, 2):
        monkeypatch.setattr(clustering, "IN_TASK", most)
        found = {}
        for r in clustering.cut(clustering.pair_forest(rows, 0.7, linkage), nodes, thresholds).collect():
            found.setdefault(r.threshold, {}).setdefault(r.cluster, set()).add(r.node)
        for t in thresholds:
            assert {frozenset(c) for c in found[t].values()} == by_hand(t) and all(k == min(c) for k, c in found[t].items())


def test_forests_of_vectors_without_a_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(12, 3)).round(1), np.zeros((2, 3))])
    x = np.vstack([x, x[:4]])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = np.maximum(0, 1 - unit @ unit.T)
    rows = spark.createDataFrame([(g, i + 100 * g, [float(v) for v in r]) for g in (0, 1) for i, r in enumerate(x)], "g int, k long, v array<float>")
    nodes = rows.select(F.col("k").alias("node"))

    def found(forest, t):
        clusters = {}
        for r in clustering.cut(forest, nodes, [t]).collect():
            clusters.setdefault(r.cluster, set()).add(r.node)
        return {frozenset(c) for c in clusters.values()}

    both = lambda clusters: {frozenset(i + 100 * g for i in c) for g in range(2) for c in clusters}
    near = [(i, j, float(d[i, j])) for i in range(len(x)) for j in range(i)]
    whole = spark.createDataFrame([(i + 100 * g, j + 100 * g, w) for g in range(2) for i, j, w in near], "a long, b long, distance double")
    for most, block in ((1500, 1024), (2, 3)):
        monkeypatch.setattr(clustering, "IN_TASK", most)
        monkeypatch.setattr(clustering, "BLOCK", block)
        monkeypatch.setattr(coref, "BLOCK", block)
        assert found(clustering.vectors_forest(rows, "g", "k", "v", 0.4), 0.4) == both(linkage_by_hand(d, 0.4))
        links = clustering.spanning_links(rows, "g", "k", "v", 0.2)
        assert found(clustering.pair_forest(links, 0.2, "single"), 0.2) == found(clustering.pair_forest(whole, 0.2, "single"), 0.2)


@pytest.mark.parametrize("groups", [0, 200_000])
def test_best_of_rows_made_from_fewer(spark, monkeypatch, groups):
    monkeypatch.setattr(sampling, "GROUPS", groups)
    rows = spark.createDataFrame([(g, s, 3 * s % 7 + 1) for g in "ab" for s in range(40)], "g string, s int, n int")
    made = lambda df: df.select("g", "s", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"), *[c for c in df.columns if c.startswith("__")]).withColumn("score", F.col("s") * 5 % 11 + F.col("i"))
    limits = spark.createDataFrame([("a", 9), ("b", 70)], "g string, k int")
    got = sampling.best(rows, limits, "g", "score", "s", "i", expand=made)
    every = [(g, s, i, s * 5 % 11 + i) for g in "ab" for s in range(40) for i in range(3 * s % 7 + 2)]
    want = [r for g, k in (("a", 9), ("b", 70)) for r in sorted((r for r in every if r[0] == g), key=lambda r: (-r[3], r[1], r[2]))[:k]]
    assert sorted(tuple(r) for r in got.select("g", "s", "i", "score").collect()) == sorted(want)


def test_batches_in_slices_of_bounded_text():
    texts = ["a" * n for n in (3, 4, 50, 0, 1, 2)] + [None, "ü" * 6]
    batch = pa.RecordBatch.from_pydict({"k": list(range(8)), "t": pa.array(texts, pa.string())})
    parts = list(batches.slices([batch, batch.slice(0, 0)], "t", 10))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(8))
    assert all(sum(len((t or "").encode()) for t in p.column("t").to_pylist()[1:]) < 10 for p in parts) and len(parts) > 3


def test_copies_of_mentions_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(coref, "BLOCK", 4)
    monkeypatch.setattr(coref, "BLOCKS", 3)
    rows = spark.range(500).select(F.lit(1).alias("topic"), "id", F.array(F.lit(1.0), F.col("id") + 0.5).alias("v"))
    assert coref.cells(rows, "topic", F.col("id")).groupBy("id").count().agg(F.max("count")).first()[0] == 3
    monkeypatch.setattr(coref, "PAIRS", 1000)
    assert coref.scored_pairs(rows, "topic", "id", "v").select("a", "b").distinct().count() == 500 * 499 // 2


def test_ceaf_and_conll_of_equal_clusterings(spark):
    rows = [("d", m, m % 3) for m in range(9)]
    key = spark.createDataFrame(rows, "doc string, mention long, cluster long")
    system = key.withColumn("cluster", F.col("cluster") + 7)
    assert metrics.conll(key, system).first().conll == pytest.approx(100)
    other = spark.createDataFrame([("d", m, 0) for m in range(9)], key.schema)
    got = metrics.summed(metrics.ceaf(key, other)).first()
    assert (got.precision, got.recall) == (pytest.approx(0.5), pytest.approx(0.5 / 3))


def test_lea_by_pairs(spark):
    rng = random.Random(4)
    rows = [(m, rng.randrange(4), rng.randrange(3)) for m in range(14)]
    df = spark.createDataFrame(rows, "mention long, k long, s long").withColumn("doc", F.lit("d"))
    key, system = (df.select("doc", "mention", F.col(c).alias("cluster")) for c in "ks")
    got = metrics.by_document(key, system, "lea").first()
    num = 0
    for c in {k for _, k, _ in rows}:
        members = [(m, s) for m, k, s in rows if k == c]
        if len(members) == 1:
            num += sum(s == members[0][1] for _, _, s in rows) == 1
        else:
            common = sum(a[1] == b[1] for a, b in itertools.combinations(members, 2))
            num += len(members) * common / (len(members) * (len(members) - 1) / 2)
    assert got.r_num == pytest.approx(num) and got.r_den == 14


def test_conll_round_trip(spark):
    tokens = spark.createDataFrame([("d", i, f"t{i}") for i in range(8)], "doc string, pos long, token string")
    mentions = spark.createDataFrame([("d", 0, 0, 5), ("d", 1, 4, 3), ("d", 2, 4, 3), ("d", 2, 3, 7)], "doc string, start long, end long, cluster long")
    marked = coref.conll_column(tokens, mentions, "doc", "pos")
    assert {r.pos: r.coref for r in marked.collect()}[4] == "3)|3)"
    got = coref.read_mentions(marked, "doc", "pos", "coref").collect()
    assert sorted((r.start, r.end, int(r.cluster)) for r in got) == [(0, 0, 5), (1, 4, 3), (2, 3, 7), (2, 4, 3)]


def test_balanced_partition(spark):
    rng = random.Random(3)
    rows = [(s, (s // 50) * 10 + rng.randrange(10)) for s in range(600) for _ in range(3)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    splits = partition.balanced_partition(edges, "src", "dst", {"a": 0.3, "b": 0.7}).cache()
    got = {r.src: r.split for r in splits.collect()}
    assert len(got) == splits.count() == 600 and sum(v == "a" for v in got.values()) == 180
    # Twelve groups of fifty: one of them must be parted.
    cut = partition.cut_links(edges, splits, "src", "dst").first()
    assert cut.total == 1800 and cut.lost <= 150
    three = {r.src: r.split for r in partition.balanced_partition(edges, "src", "dst", {"x": 1, "y": 1, "z": 1}, rounds=1).collect()}
    assert sorted(Counter(three.values()).items()) == [("x", 200), ("y", 200), ("z", 200)]
    assert partition.balanced_partition(edges.where("false"), "src", "dst", {"a": 0.3, "b": 0.7}).count() == 0
    hot = edges.unionByName(spark.range(600).selectExpr("id AS src", "-1L AS dst"))
    assert partition.cut_links(hot, partition.balanced_partition(hot, "src", "dst", {"a": 0.3, "b": 0.7}), "src", "dst").first().lost <= 750


def test_subgraphs(spark):
    said = spark.createDataFrame([("p", i, s) for i, s in enumerate(["One.", "See the mill here.", "Three."])] + [("q", 0, "mill")], "page string, sentence_idx long, sentence string")
    rows = [("p", "t", 1, 8, 12), ("p", "t", 0, 0, 3), ("q", "t", 0, 0, 4), ("q", "t", 7, 0, 1), ("q", "u", 0, 0, 1)]
    links = spark.createDataFrame(rows, "page string, to string, sentence_idx long, chars_start int, chars_end int")
    texts = spark.createDataFrame([("u", "u-page", "All of u")], "to string, doc string, text string")
    got = {tuple(r) for r in subgraphs.export(links, said, texts, "page", "to", low=1, high=4).collect()}
    assert got == {
        ("t", "anchor-context", "p", 1, "One. See the >>>mill<<< here. Three."), ("t", "anchor-context", "p", 0, ">>>One<<<. See the mill here."), ("t", "anchor-context", "q", 0, ">>>mill<<<"),
        ("u", "anchor-context", "q", 0, ">>>m<<<ill"), ("u", "target", "u-page", -1, "All of u"),
    }
    known = {r.target for r in subgraphs.export(links, said, texts, "page", "to", low=1, high=4, known=True).collect()}
    assert known == {"u"} and subgraphs.targets(links, "to", 3, 5).count() == 1


def test_hashed_columns_collide_with_signs(spark):
    docs = spark.createDataFrame([(1, "red house red boat"), (2, "blue house"), (3, None)], "k long, t string")
    grams = dedup.word_grams(docs, "k", "t", 1).collect()
    for bits in (1, 20):
        want: dict = {}
        for r in grams:
            d = int(hashlib.md5(r.gram.encode()).hexdigest()[:15], 16)
            want[r.k, d % 2**bits] = want.get((r.k, d % 2**bits), 0) + r.tf * (1 - 2 * (d >> bits & 1))
        got = {(r.k, r.gram): r.tf for r in dedup.hashed(dedup.word_grams(docs, "k", "t", 1), "k", bits).collect()}
        assert got == {x: v for x, v in want.items() if v}
    unit = dedup.hashed_tfidf(docs, "k", "t", 1).groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert [round(r.n, 12) for r in unit] == [1, 1]


def test_shingle_hashes_are_polynomials():
    for text in ("", "a", "añ😀é\n", "abcdefg" * 40):
        codes = [ord(c) for c in text]
        grams = {tuple(codes[i : i + 5]) for i in range(max(1, len(codes) - 4))} - {()}
        want = set()
        for g in grams:
            h = 0
            for c in g:
                h = (h * dedup.BASE + c) % dedup.PRIME
            want.add(h)
        assert set(dedup.shingle_hashes(text, 5).tolist()) == want if text else True


def test_tfidf_pairs_match_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(9))) for i in range(25)] + [(90, ""), (91, None)]
    w = dedup.tfidf(spark.createDataFrame(docs, "k long, t string"), "k", "t")
    vectors: dict = {}
    for r in w.collect():
        vectors.setdefault(r.k, {})[r.gram] = r.weight
    want = {(a, b) for a in vectors for b in vectors if a < b and sum(v * vectors[b].get(g, 0) for g, v in vectors[a].items()) >= 0.2}
    assert {(r.a, r.b) for r in dedup.cosine_pairs(w, "k", 0.2).collect()} == want


@pytest.mark.parametrize("block", [3, 1000])
def test_all_pairs_of_buckets(spark, monkeypatch, block):
    # Pairs of documents that share a bucket without its least member's agreement, and copies.
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block)
    rng = random.Random(5)
    first = [rng.randrange(9) for _ in range(16)]
    signs = {i: first + [rng.randrange(2) for _ in range(112)] for i in range(25)} | {30 + i: first + [7] * 112 for i in range(4)}
    got = {(r.src, r.dst): r.similarity for r in dedup_queries.all_pairs(spark.createDataFrame(list(signs.items()), "k long, signature array<long>"), "k").collect()}
    agree = lambda a, b: sum(x == y for x, y in zip(signs[a], signs[b]))
    least = [i for i in signs if i <= 30]
    want = {(a, b): round(agree(a, b) / 128, 6) for a in least for b in least if a > b and agree(a, b) > 64} | {(i, 30): 1.0 for i in (31, 32, 33)}
    assert got == pytest.approx(want, abs=2e-6) and len(want) > 100


def test_stage_runner(spark):
    df = spark.range(3)
    double = Stage("double", ("x",), ("y",), lambda x: {"y": x.select((F.col("id") * 2).alias("id"))}, keep=True)
    assert {r.id for r in run_stages([double], {"x": df})["y"].collect()} == {0, 2, 4}
    with pytest.raises(KeyError):
        run_stages([double], {})


def test_capture_index(spark, tmp_path):
    urls = ["http://a.org/x/1", "https://www.a.org/x/2#f", "http://a.org/y", "http://b.a.org:80/x/3", "http://u@a.org/X/4", "http://ab.org/x", "http://a.orgs/x", "http://a.org", "http://org/"]
    rows = [(u, f"2020010{1 + i % 3}", "f" if i % 4 else "robotstxt/f", i, 200 if i != 2 else 404, "text/html", "eng") for i, u in enumerate(urls * 2)]
    captures = spark.createDataFrame(rows, "url string, timestamp string, filename string, offset long, status int, mime_detected string, languages string")
    tables.write_index(captures, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    found = lambda url, **kw: sorted(r.offset for r in tables.query_index(index, url, **kw).collect())
    assert found("http://a.org/x") == [1, 9, 10, 13] and found("a.org/x/*") == found("http://a.org/x/")
    assert found("http://a.org/y", wildcard=False) == [11] and found("http://a.org/y", status=None, wildcard=False) == [2, 11]
    assert found("http://a.org") == [1, 7, 9, 10, 11, 13] and found("*.a.org") == [1, 3, 7, 9, 10, 11, 13]
    assert found("*.org", languages="deu") == [] and len(found("*.org")) == 10
    assert found("*.a.org", limit=2) == [7, 9] and found("*.a.org", end=F.lit("20200101")) == [3, 9]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = tables.query_index(index, "http://a.org/x")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(key,org,a)/x)" in plan.split("PushedFilters")[1]
    runs = []

    def ask():
        runs.append(1)
        return tables.query_index(index, "*.org")

    for asked in ({"url": "*.org", "limit": None}, {"limit": None, "url": "*.org"}, {"url": "*.org", "limit": 3}):
        assert tables.kept_query(spark, str(tmp_path / "kept"), asked, ask).count() == 10
    assert len(runs) == 2


def test_configs_and_readers(spark, tmp_path):
    assert tables.merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    (tmp_path / "i.csv").write_text("url,timestamp,filename,offset,length\nhttp://a/b,20200102030405,f,1,2\nhttp://a/c,bad,robotstxt/f,1,2\n")
    index = tables.read_page_index(spark, str(tmp_path / "i.csv"))
    tables.write_index(index, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    free = {"status": None, "mime": None, "languages": None}
    assert [str(r.timestamp) for r in tables.query_index(stored, "http://a", **free).collect()] == ["2020-01-02 03:04:05"]
    (tmp_path / "x.conll").write_text("#begin document (n); part 000\nd\t0\tA\t(1)\nd\t1\tB\t-\n\nd\t2\tC\t(1)\n#end document\n")
    got = tables.read_conll(spark, str(tmp_path / "x.conll")).orderBy("token_id").collect()
    assert [(r.sentence, r.token_id, r["columns"][3]) for r in got] == [(0, 0, "(1)"), (0, 1, "-"), (1, 2, "(1)")]


def test_grams_where_keys_repeat_or_not(spark):
    rng = random.Random(4)
    words = ["red", "mill", "über", "x1", "the", "a"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(40)] + [None, "", "one two " * 3000]
    for keys in (list(range(42)) + [None], [i // 3 if i % 5 else None for i in range(43)]):
        for n in (1, 2, 3):
            want: Counter = Counter()
            for k, t in zip(keys, texts):
                left = [w for w in (t or "").split() if len(w) > 1 and w != "the"]
                want.update((k, " ".join(left[i : i + n])) for i in range(len(left) - n + 1))
            rows = dedup.word_grams(spark.createDataFrame(list(zip(keys, texts)), "k long, t string"), "k", "t", n).collect()
            assert {(r.k, r.gram): r.tf for r in rows} == dict(want) and len(rows) == len(want)


def test_tfidf_shuffles_grams_twice(spark):
    docs = spark.createDataFrame([(1, "red mill water wheel"), (2, "red mill water stone")], "k long, t string")
    for got in (dedup.counted_tfidf(docs, "k", "t"), dedup.weighted(dedup.word_grams(docs, "k", "t", 2), 2, "k", docs.select("k"))):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "saved-" not in plan
    only = dedup.weighted(dedup.word_grams(docs, "k", "t", 2), 2, "k", docs.where("k = 2").select("k")).collect()
    every = {tuple(r) for r in dedup.counted_tfidf(docs, "k", "t").collect() if r.k == 2}
    assert {tuple(r) for r in only} == every and {r.df for r in only} == {1, 2}


def test_pairs_of_large_parts_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(9)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(["w1 w2 w3 lone"] * 3 + ["own words here", None])]
    weights = dedup.counted_tfidf(spark.createDataFrame(docs, "k long, t string"), "k", "t")
    vectors: dict = {}
    for r in weights.collect():
        vectors.setdefault(r.k, {})[r.gram] = r.weight
    dot = lambda a, b: sum(v * vectors[b].get(g, 0) for g, v in vectors[a].items())
    want = {(a, b): dot(a, b) for a in vectors for b in vectors if a < b and dot(a, b) >= 0.3}
    for block in (2048, 7):
        monkeypatch.setattr(dedup, "PART_BLOCK", block)
        rows = dedup.cosine_pairs(weights, "k", 0.3, counted=True).collect()
        got = {(r.a, r.b): r.similarity for r in rows}
        assert set(got) == set(want) and len(rows) == len(want) > 20
        assert all(abs(got[p] - want[p]) < 1e-9 for p in want)
    # No table has a row for each gram of each candidate.
    plan = dedup.cosine_pairs(weights, "k", 0.3, counted=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_top_spans_make_no_arrays_of_spans(spark):
    tokens = spark.createDataFrame([(d, s, t) for d in (1, 2) for s in (0, 3) for t in range(4 + d)], "d long, s long, t long")
    got = coref.top_spans(tokens, "d", "s", "t", (F.col("start") * 31 + F.col("end") * 17 + F.col("s") * 7) % 11, 3, 0.5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(" not in plan and "lambda" not in plan
    want = []
    for d in (1, 2):
        n = 4 + d
        every = [(-((a * 31 + b * 17 + s * 7) % 11), s, a, b) for s in (0, 3) for a in range(n) for b in range(a, min(a + 3, n))]
        want += [(d, s, a, b, -x) for x, s, a, b in sorted(every)[:n]]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_tfidf_joins_its_model_once(spark):
    docs = spark.createDataFrame([(1, "red mill water wheel"), (2, "red mill water stone"), (3, "red mill water wheel"), (4, None)], "k long, t string")
    weights = dedup.tfidf(docs, "k", "t")
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    norms = {r.k: r.n for r in weights.groupBy("k").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()}
    assert set(norms) == {1, 2, 3} and all(abs(n - 1) < 1e-9 for n in norms.values())
    assert {tuple(r) for r in dedup.cosine_classes(weights, "k").collect()} == {(1, 1), (2, 2), (3, 1)}
    # A model of other documents: what is rare there may be shared here.
    model = spark.createDataFrame([("red mill", 1, 1.0), ("mill water", 1, 1.0)], "gram string, df long, idf double")
    other = dedup.transformed(dedup.word_grams(docs, "k", "t", 2), model, "k")
    assert {(r.a, r.b) for r in dedup.cosine_pairs(other, "k", 0.9).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_places_take_one_shuffle(spark):
    rows = sampling.placed(spark.range(0, 5000, 1, 8).select((5000 - F.col("id")).alias("k"), (F.col("id") % 7).alias("g")), "g", "k")
    assert "Exchange hashpartitioning(__p" not in rows.select("k", "place")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert "Window" not in rows.select("k", "place")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    got = [(r.g, r.k) for r in rows.orderBy("place").collect()]
    assert got == sorted(got) and [r.place for r in rows.orderBy("place").collect()] == list(range(5000))
    assert sampling.placed(spark.range(0).select("id"), "id").count() == 0


@pytest.mark.parametrize("piece, short, at_hand", [(1 << 20, 0, 1 << 30), (1 << 20, 512, 2048), (700, 30, 20), (700, 0, 0)])
def test_minima_hash_a_shared_gram_once(monkeypatch, piece, short, at_hand):
    # Against plain integers, over texts cut into pieces; before, a gram was hashed again for every text that holds it.
    for name, n in (("PIECE", piece), ("SHORT", short), ("AT_HAND", at_hand)):
        monkeypatch.setattr(dedup, name, n)
    rng = random.Random(3)
    texts = ["a", "abcd", "\U0010ffff" * 9, "x" * 2000, *["".join(rng.choice("abé😀 ") for _ in range(rng.choice([3, 40, 900]))) for _ in range(40)]]
    taken, old = [], dedup.reduced
    hashes = [dedup.shingle_hashes(t, 5) for t in texts]
    monkeypatch.setattr(dedup, "reduced", lambda x: taken.append(x.size) or old(x))
    got = dedup.minima(hashes, 16).tolist()
    by_hand = []
    for t in texts:
        n, grams = min(5, len(t)), set()
        for i in range(len(t) - n + 1):
            h = ord(t[i])
            for c in t[i + 1 : i + n]:
                h = (h * dedup.BASE + ord(c)) % dedup.PRIME
            grams.add(h)
        by_hand.append([min((h * a + b) % dedup.PRIME for h in grams) for a, b in dedup.coefficients(16)])
    assert got == by_hand
    if at_hand == 1 << 30:
        # Now and then a text's own grams are hashed, where the least ones looked up first do not hold its minimum.
        distinct = len(set(np.concatenate(hashes).tolist()))
        assert sum(taken) <= 1.2 * 16 * distinct < 0.5 * 16 * sum(len(set(h.tolist())) for h in hashes)


def test_reduced_at_its_ends():
    p = dedup.PRIME
    x = [0, 1, p - 1, p, p + 1, 2 * p, p * (p - 1), p * (p - 1) + (1 << 21), (p - 1) ** 2 + p - 1, 1 << 61]
    assert dedup.reduced(np.array(x, np.uint64)).tolist() == [v % p for v in x]
