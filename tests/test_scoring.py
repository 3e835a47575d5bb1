"""Scores of CoNLL tokens with and without minimum spans, and the parts they are made of."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.operators import coref, metrics, parses, sampling, scoring, sentences
from linkloom.sources import tables

TOKENS = "doc string, sentence long, token long, word string, pos string, parse string, coref string"


def tokens(spark, rows, doc="d"):
    return spark.createDataFrame([(doc, 0, i, *r) for i, r in enumerate(rows)], TOKENS)


KEY = [("the", "DT", "(NP(NP*", "(1"), ("mill", "NN", "*)", "-"), ("by", "IN", "(PP*", "-"), ("water", "NN", "(NP*)))", "(2)|1)"), ("it", "PRP", "(NP*)", "(1)"), ("ran", "VBD", "(VP*", "(2"), ("dry", "JJ", "*)", "2)")]
SYSTEM = [*["(1", "1)", "-", "(2)", "(1)", "(2", "2)"]]


def scores(frame):
    return {r.metric: (r.precision, r.recall) for r in frame.collect() if r.metric != "conll"}


def test_minimum_spans_match_what_spans_miss(spark):
    key = tokens(spark, KEY)
    system = tokens(spark, [(*k[:3], c) for k, c in zip(KEY, SYSTEM)])
    # "the mill" has the same head as "the mill by water".
    exact, least = scores(scoring.conll_scores(key, system)), scores(scoring.conll_scores(key, system, min_spans=True))
    assert exact["mentions"] == (3 / 4, 3 / 4) and exact["muc"] == (1 / 2, 1 / 2)
    assert all(v == (1, 1) for v in least.values())
    whole = {r.metric: r.f1 for r in scoring.conll_scores(key, system, min_spans=True).collect()}
    assert whole["conll"] == 1
    # Chain 2 would keep one mention without its verb phrase.
    np = scoring.clusterings(key, system, noun_phrases=True)
    assert {(r.mention, r.cluster) for r in np[0].collect()} == {("0:3", "1"), ("4:4", "1")}


def test_singletons_and_nested_mentions(spark):
    key = tokens(spark, [(w, "NN", "*", c) for w, c in (("a", "(1|(1)"), ("b", "1)"), ("c", "(3)"), ("d", "(1)"))])
    assert {(r.start, r.end, r.cluster) for r in scoring.chains(key, keep_singletons=False).collect()} == {(0, 0, "1"), (0, 1, "1"), (3, 3, "1")}
    one = scoring.clusterings(key, key, nested=False)[0]
    assert {(r.mention, r.cluster) for r in one.collect()} == {("0:1", "1"), ("3:3", "1"), ("2:2", "3")}
    pair = tokens(spark, [("a", "NN", "*", "(1|(1)"), ("b", "NN", "*", "1)")])
    assert scoring.clusterings(pair, pair, nested=False)[0].count() == 2
    assert scoring.clusterings(pair, pair, nested=False, keep_singletons=False)[0].count() == 0


def test_files_are_read_and_scored(spark, tmp_path):
    for name, marks in (("key", [k[3] for k in KEY]), ("system", SYSTEM)):
        lines = ["#begin document (d); part 000", *["\t".join(("d", "0", str(i), *k[:3], m)) for i, (k, m) in enumerate(zip(KEY, marks))], "", "#end document"]
        (tmp_path / f"{name}.conll").write_text("\n".join(lines) + "\n")
    sides = [scoring.of_files(tables.read_conll(spark, str(tmp_path / f"{name}.conll"))) for name in ("key", "system")]
    assert all(v == (1, 1) for v in scores(scoring.conll_scores(*sides, min_spans=True)).values())
    assert scores(scoring.conll_scores(*sides, names=("mentions",)))["mentions"] == (3 / 4, 3 / 4)


def test_brackets_of_nested_and_crossing_chains(spark):
    rng = random.Random(3)
    rows, want = [], []
    for doc in ("a", "b"):
        spans = []
        for chain in "123":
            # Spans of one chain nest or lie apart, those of different chains may cross.
            stack = [(0, 60)]
            while stack:
                lo, hi = stack.pop()
                if hi - lo > 2 and rng.random() < 0.8:
                    s, e = sorted(rng.sample(range(lo, hi), 2))
                    spans.append((s, e, chain))
                    stack += [(lo, s), (s + 1, e), (e + 1, hi)]
        want += [(doc, *x) for x in spans]
        rows += [(doc, t) for t in range(60)]
    mentions = spark.createDataFrame(want, "doc string, start long, end long, cluster string")
    marked = coref.conll_column(spark.createDataFrame(rows, "doc string, pos long"), mentions, "doc", "pos")
    got = coref.read_mentions(marked, "doc", "pos", "coref")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 20
    for bad in ("(1", "1)"):
        broken = marked.withColumn("coref", F.when((F.col("doc") == "b") & (F.col("pos") == 59), bad).otherwise(F.lit("-")))
        with pytest.raises(ValueError):
            coref.read_mentions(broken, "doc", "pos", "coref")
    assert coref.read_mentions(marked.where("false"), "doc", "pos", "coref").count() == 0


def test_best_rows_of_groups(spark):
    rng = random.Random(9)
    rows = [(g, i, float(rng.choice([1, 1, 2, 3.5, rng.random()]))) for g, n in (("a", 400), ("b", 3), ("c", 1), ("e", 50)) for i in range(n)] + [("f", i, 2.0) for i in range(90)]
    limits = {"a": 37, "b": 3, "c": 0, "e": 99, "f": 40}
    got = sampling.best(spark.createDataFrame(rows, "g string, i long, s double"), spark.createDataFrame(list(limits.items()), "g string, k long"), "g", "s", "i")
    want = [r for g, k in limits.items() for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:k]]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_nested_mentions_and_pairs_by_hand(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), s := rng.randrange(30), s + rng.choice([0, 1, 2, 9, 25]), k) for k in range(80)]
    frame = spark.createDataFrame(rows, "doc string, s long, e long, k long")
    inside = lambda x, y: x[0] == y[0] and x[3] != y[3] and y[1] <= x[1] and x[2] <= y[2] and ((x[1], x[2]) != (y[1], y[2]) or y[3] < x[3])
    want = [x for x in rows if not any(inside(x, y) for y in rows)]
    assert sorted(tuple(r) for r in coref.without_nested(frame, "doc", "s", "e", "k").collect()) == sorted(want)
    vectors = spark.createDataFrame([(d, k, [float(s), float(e), 1.0]) for d, s, e, k in rows], "doc string, k long, v array<double>")
    pairs = {(d, *sorted((k, l))) for d, _, _, k in rows for c, _, _, l in rows if d == c and k != l}
    for block in (1024, 7):
        monkeypatch.setattr(coref, "BLOCK", block)
        assert sorted(tuple(r) for r in coref.mention_pairs(vectors, "doc", "k").collect()) == sorted(pairs)
        found = coref.scored_pairs(vectors, "doc", "k", "v").collect()
        assert sorted((r.doc, r.a, r.b) for r in found) == sorted(pairs)
        of = {k: (s, e, 1) for _, s, e, k in rows}
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        assert all(abs(r.score - dot(of[r.a], of[r.b]) / (dot(of[r.a], of[r.a]) * dot(of[r.b], of[r.b])) ** 0.5) < 1e-12 for r in found)


def test_report_is_one_layout(spark):
    rows = [(f"d{m % 3}", str(m), str(m % 4)) for m in range(40)]
    key = spark.createDataFrame(rows, "doc string, mention string, cluster string")
    system = key.where("mention % 7 != 0").withColumn("cluster", F.pmod(F.col("mention").cast("int"), F.lit(5)).cast("string"))
    got = {r.metric: r for r in metrics.report(key, system).collect()}
    assert got["conll"].f1 == pytest.approx(sum(got[m].f1 for m in metrics.CONLL) / 3)
    assert metrics.conll(key, system).first().conll == pytest.approx(100 * got["conll"].f1)
    for name in ("mentions", "muc", "b3", "lea"):
        assert metrics.summed(metrics.by_document(key, system, name)).first().f1 == got[name].f1


def test_marks_meet_chunks_of_tokens(spark):
    docs = spark.createDataFrame([(1, "One two. " * 40), (2, None), (3, " ")], "doc long, text string")
    chunks = sentences.token_chunks(docs, "doc", "text")
    assert [(r.chunk, len(r.tokens), r.total) for r in chunks.orderBy("chunk").collect()] == [(0, 32, 120), (1, 32, 120), (2, 32, 120), (3, 24, 120)]
    mentions = spark.createDataFrame([(1, 30, 33, "a"), (1, 119, 119, "b"), (1, 33, 33, "a")], "doc long, start long, end long, cluster string")
    rows = coref.conll_chunks(chunks, mentions, "doc").orderBy("token").collect()
    plain = [(r.doc, r.sentence, r.token, r.word) for r in rows]
    assert plain == [(1, i // 3, i, ("One", "two", ".")[i % 3]) for i in range(120)]
    assert {r.token: r.coref for r in rows if r.coref != "-"} == {30: "(a", 33: "(a)|a)", 119: "(b)"}


def test_brackets_across_partitions_and_spans_across_chunks(spark):
    # One chain opened over all partitions, others within them.
    marks = [("d", 0, "(a")] + [("d", i, "(a)|(b" if i % 2 else "b)") for i in range(1, 4001)] + [("d", 4001, "a)")]
    got = coref.read_mentions(spark.createDataFrame(marks, "doc string, token long, coref string").repartition(7), "doc", "token", "coref").collect()
    want = {(0, 4001, "a")} | {(i, i, "a") for i in range(1, 4001, 2)} | {(i, i + 1, "b") for i in range(1, 4001, 2)}
    assert len(got) == len(want) and {(r.start, r.end, r.cluster) for r in got} == want
    words = spark.createDataFrame([("d", i, f"w{i}", "NN", "(NP*" if i == 30 else "*)" if i == 33 else "*") for i in range(40)], "doc string, token long, word string, pos string, parse string")
    spans = spark.createDataFrame([("d", 30, 33, 0), ("d", 90, 91, 1)], "doc string, start long, end long, k long")
    found = {r.k: r.spans for r in parses.with_minimum_spans(spans, words, "doc", "token", "k").collect()}
    assert [(s.words, s.at) for s in found[0]] == [("w30 w31 w32 w33", 33)] and found[1] is None
    plan = parses.with_minimum_spans(spans, words, "doc", "token", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(sequence") == 1 and "sequence(start" not in plan


def test_shapes_instead_of_words(spark):
    """Mentions of other words are analysed once if their parses and kinds of words are the same, wherever runs repeat a
    text or close at one place; runs of tokens with gaps, repeats or none."""
    rng = random.Random(8)
    vocabulary = ["mill", "old", "U.S.", ",", "%", "-LRB-", "the", "and", "3", "x1"]
    bits = ["*", "(NP*", "*)", "(NP*)", "(VP*", "*))", "(NP(NP*", "(PP*)"]
    lists = []
    for _ in range(400):
        n = rng.randint(0, 5)
        lists.append([(rng.choice(vocabulary), rng.choice(["NN", "DT", "CC"]), rng.choice(bits)) for _ in range(n)])
    names = ("word", "pos", "parse")
    rows = pa.array([[dict(zip(names, t)) for t in x] for x in lists], pa.list_(pa.struct([(n, pa.string()) for n in names])))
    parses.shape.cache_clear()
    for x, got in zip(lists, parses.analyses(rows, [7] * len(lists)).to_pylist()):
        words, pos, parse = ([t[k] for t in x] for k in range(3))
        root = parses.tree(words, pos, parse, 7)
        runs = sorted({(" ".join(w for w, *_ in r.words), r.at) for r in parses.minimum(root)}, key=lambda s: (s[1], s[0]))
        assert got["root"] == (root.name if root else None)
        assert [(s["words"], s["at"]) for s in got["spans"] or []] == (runs or [(w, i) for i, w in enumerate(words)])
    rows = pa.array([[{"word": f"w{i}", "pos": "NN", "parse": "(NP*)"}] for i in range(1000)], rows.type)
    parses.shape.cache_clear()
    parses.analyses(rows, [0] * 1000)
    assert parses.shape.cache_info().misses == 1


def test_brackets_across_batches():
    rng = random.Random(2)
    rows = sorted(((rng.choice([None, "a", "b"]), rng.choice("12"), rng.randrange(40), rng.random() < 0.5) for _ in range(500)), key=lambda r: (str(r[0]), r[1], r[2], not r[3]))
    want, chain, opened = [], None, []
    for r in rows:
        if r[:2] != chain:
            want += [(*x, None) for x in opened]
            chain, opened = r[:2], []
        if r[3]:
            opened.append(r)
        else:
            want.append((*opened.pop(), r[2]) if opened else (*r, None))
    want += [(*x, None) for x in opened]
    names, kinds = ("doc", "chain", "token", "opens"), (pa.string(), pa.string(), pa.int64(), pa.bool_())
    for size in (1, 7, 500):
        got, held = [], None
        for k in range(0, len(rows), size):
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + size]), kinds)], names=names)
            out, held = coref.matched_brackets(batch if held is None else pa.concat_batches([held, batch]))
            got += [tuple(r.values()) for r in out.to_pylist()]
        got += [(*r.values(), None) for r in held.to_pylist()]
        assert sorted(got, key=str) == sorted(want, key=str)
