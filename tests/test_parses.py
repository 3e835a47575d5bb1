"""Minimum spans by hand-made parses, and the filters that read them."""

import pytest

from linkloom.operators import matching, parses
from linkloom.operators.sentences import packed

CASES = [
    # words, parts of speech, parse, tag of the whole, runs that are left
    ("the old mill", "DT JJ NN", "(NP* * *)", "NP", [("the old mill", 2)]),
    ("the mill by the river", "DT NN IN DT NN", "(NP(NP* *) (PP* (NP* *)))", "NP", [("the mill", 1)]),
    ("cats and dogs", "NNS CC NNS", "(NP(NP*) * (NP*))", "NP", [("cats", 0), ("dogs", 2)]),
    ("ran home", "VBD NN", "(VP* (NP*))", "VP", [("ran", 1)]),
    ("and", "CC", "*", "", [("and", 0)]),
    ("mill", "NN", "*", "", [("mill", 0)]),
    ("that he came", "IN PRP VBD", "(SBAR* (S(NP*) (VP*)))", "SBAR", [("he", 1)]),
    ("old mill and inn", "JJ NN CC NN", "(NP* *) * (NP*)", "NP", [("old mill", 1), ("inn", 3)]),
    ("the river (", "DT NN -LRB-", "(NP(NP* *) *", "NP", [("the river", 1)]),
    ("U.S. mill", "NNP NN", "(NP* (NP*))", "NP", [("mill", 1)]),
    (", mill", ", NN", "(NP* (NP*))", "NP", [("mill", 1)]),
]


@pytest.mark.parametrize("words,pos,parse,root,spans", CASES)
def test_minimum_span(words, pos, parse, root, spans):
    got = parses.analysed(words.split(), pos.split(), parse.split(), 0)
    assert (got["root"], [(s["words"], s["at"]) for s in got["spans"]]) == (root, spans)


def test_no_words():
    assert parses.analysed([], [], [], 0) == {"root": None, "spans": []}


def test_filters(spark):
    m = spark.createDataFrame([("d", 1, "NP"), ("d", 1, "VP"), ("d", 2, "NP"), ("d", 3, "NP"), ("d", 3, "NP"), ("d", 3, "VP"), ("d", 4, None)], "doc string, chain int, root string")
    kept = lambda **kw: sorted(r.chain for r in parses.without_verb_phrases(m, ["doc", "chain"], **kw).collect())
    assert kept() == [2, 3, 3, 4]
    assert kept(partial=False) == [2, 4]
    t = spark.createDataFrame([("a", 1, "-"), ("a", 2, "(NP*)"), ("b", 2, "-"), ("b", 1, "*"), ("c", 1, None)], "doc string, token int, parse string")
    assert {tuple(r) for r in parses.documents_with_parses(t, "doc", "token").collect()} == {("a", False), ("b", True), ("c", False)}


def test_places():
    assert matching.places_in("ab", "-a b.") == [None, 0, None, 1, None]
    assert matching.places_in("aab", "aaab") is not None
    assert matching.places_in("ab", "a") is None
    assert matching.places_in("", "x") == [None]
    assert matching.places_in(None, "x") is None


def test_matched_spans_brute_force(spark):
    """Greatest total overlap of random span lists against every assignment."""
    import itertools
    import random

    rng = random.Random(5)
    sides = {}
    for doc in range(40):
        for side in "ab":
            cuts = sorted(rng.sample(range(24), rng.choice([2, 4, 6, 8])))
            sides[doc, side] = list(zip(cuts[::2], cuts[1::2]))
    frame = lambda side: spark.createDataFrame([(d, i, s, e) for (d, x), v in sides.items() if x == side for i, (s, e) in enumerate(v)], "doc int, id int, start int, end int")
    got = {}
    for r in matching.matched_spans(frame("a"), frame("b"), ["doc"]).collect():
        got.setdefault(r.doc, []).append((r.a, r.b))
    for doc in range(40):
        a, b = sides[doc, "a"], sides[doc, "b"]
        width = lambda p, a=a, b=b: max(0, min(a[p[0]][1], b[p[1]][1]) - max(a[p[0]][0], b[p[1]][0]))
        best = max(sum(map(width, zip(range(len(a)), order))) for order in itertools.permutations(range(len(b)), len(a))) if len(a) <= len(b) else max(sum(map(width, zip(order, range(len(b))))) for order in itertools.permutations(range(len(a)), len(b)))
        pairs = got.get(doc, [])
        assert len({p for p, _ in pairs}) == len(pairs) == len({q for _, q in pairs})
        assert all(width(p) > 0 for p in pairs) and sum(map(width, pairs)) == best


def test_packed():
    import numpy as np

    pack = lambda s, n, limit: packed(np.array(s), np.array(n), limit).tolist()
    assert pack([0, 0, 1, 1], [2, 2, 2, 2], 4) == [0, 0, 1, 1]
    assert pack([0, 0, 0, 1], [2, 2, 2, 2], 4) == [0, 0, 1, 1]
    assert pack([0, 1, 1, 2], [1, 2, 2, 1], 4) == [0, 1, 1, 2]
    assert pack([0, 0], [9, 1], 4) == [0, 1]
    assert pack([], [], 4) == []
