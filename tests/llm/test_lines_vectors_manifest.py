"""Line dedup, whitening and the manifest against brute force, and their odd cases."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import line_dedup, manifest, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, block string, place string"
LINE = "This line is long enough to count, number {}"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y", "z") for i, t, lang in rows], DOCS)


def plain_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    gone = {k: max((i for i in at if i is not None), default=None) for k, at in holders.items() if len(at) >= min_docs}
    out = []
    for i, t in rows:
        split = (t or "").split("\n")
        stay = [x for x in split if key(x) not in gone or gone[key(x)] == i]
        out.append((i, None if t is None else "\n".join(stay), len(split), len(split) - len(stay)))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        lines = [rng.choice([LINE.format(rng.randrange(60)), f" \t{LINE.format(rng.randrange(8)).upper()}\r", "short", "", "ä" * 39, "Ä" * 40, "é" * 40 + " "]) for _ in range(rng.randrange(8))]
        rows.append((i if i % 50 else 7, "\n".join(lines)))
    rows += [(None, LINE.format(999))] * 6 + [(None, LINE.format(3)), (400, None), (401, ""), (402, "\n\n"), (403, "x" * 300_000 + "\n" + LINE.format(1))]
    docs = frame(spark, [(i, t, "en") for i, t in rows])
    want = plain_lines(rows)
    for block, probes in ((1 << 22, 1 << 17), (1 << 10, 50)):
        monkeypatch.setattr(line_dedup, "BLOCK_BYTES", block)
        monkeypatch.setattr(line_dedup, "SHARD_PROBES", probes)
        got = line_dedup.dedup_lines(docs)
        assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(r[3] for r in want) > 300
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_drops_a_line_that_all_share(spark):
    rows = [(i, f"{LINE.format(0)}\nonly {i}") for i in range(2000)]
    got = line_dedup.dedup_lines(frame(spark, [(*r, None) for r in rows]))
    assert got.where("n_dropped = 1").count() == 1999 and got.where("doc_id = 1999").first().text == rows[-1][1]


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 20_000):
        lo, hi = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
        sizes, bits = line_dedup.PerfectHash.of(lo, hi).packed()
        again = line_dedup.PerfectHash.unpacked(sizes, bits)
        assert sorted(again.numbers(lo, hi)) == list(range(n)) and len(bits) * 8 < 4.5 * n + 70
        other = again.numbers(lo + np.uint64(1), hi)
        assert other.min(initial=0) >= -1 and other.max(initial=-1) < n


@pytest.mark.parametrize("kind", ["random", "graded", "clustered", "deficient", "split"])
def test_singular_values_and_directions(kind):
    rng = np.random.default_rng(7)
    d = 40
    u, v = (np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(2))
    size = {"random": rng.random(d) + 0.1, "graded": 2.0 ** -np.arange(d), "clustered": np.repeat([3.0, 3.0 + 1e-12, 2.0, 1.0], 10), "deficient": np.where(np.arange(d) < 5, 5.0 - np.arange(d), 0.0), "split": np.ones(d)}[kind]
    m = np.diag(size[::-1]) if kind == "split" else u @ np.diag(size) @ v.T
    a, b, right = whitening.bidiagonal(m)
    assert np.abs(right.T @ right - np.eye(d)).max() < 1e-13
    squares = whitening.dqds(a, b)
    assert np.abs(np.sqrt(squares) - np.sort(size)[::-1]).max() < 1e-13 * size.max() * 10
    exact = whitening.dqds(np.ones(d), np.zeros(d - 1))
    assert np.array_equal(exact, np.ones(d))
    k = 8 if kind != "deficient" else 5
    z = right @ whitening.directions(a, b, squares[:k])
    assert np.abs(z.T @ z - np.eye(k)).max() < 1e-9
    assert np.abs(m.T @ (m @ z) - z * squares[:k]).max() < 1e-9 * size.max() ** 2


def test_dqds_is_accurate_for_tiny_values():
    # Singular values of a bidiagonal with a wide range, against exact rational bisection of its least one.
    a, b = np.array([1.0, 1e-4, 1e-9, 1e-12]), np.array([1.0, 1e-3, 1e-8])
    squares = whitening.dqds(a, b)
    assert math.isclose(math.prod(map(float, squares)), math.prod(map(float, a * a)), rel_tol=1e-12)


def test_whitening_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ENTRIES", 64 * 6)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(700, 6)) @ rng.normal(size=(6, 6))).astype(np.float32)
    rows = [(i, [float(c) for c in r], "e") for i, r in enumerate(x)] + [(5, [float(c) for c in x[5]], "e"), (None, [float(c) for c in x[0]], "e")]
    odd = [(800, None), (801, []), (802, [1.0]), (803, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (804, [math.nan] * 6), (805, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<float>, deviation string"
    vectors = spark.createDataFrame(rows + [(i, v, "e") for i, v in odd], schema).repartition(11)
    fit = whitening.train(vectors)
    whole = np.floor(1024 * np.array([r[1] for r in rows])).astype(int) + 100_000
    n, s = len(whole), whole.sum(axis=0)
    assert (fit.n, fit.sums) == (n, s.tolist())
    v = np.cov(whole.T, bias=True)
    e, z = np.linalg.eigh(v)
    assert np.allclose(fit.values, e[::-1], rtol=1e-12) and math.isclose(fit.total, np.trace(v), rel_tol=1e-12)
    assert fit.identity_error < 1e-10
    got = whitening.whiten(vectors, fit).collect()
    assert len(got) == n
    for r in got:
        at = 0 if r.vec_id is None else r.vec_id
        far = n * whole[at].astype(object) - s
        assert int(r.deviation) == int((far * far).sum())
        w = np.abs(z.T[::-1] @ (far.astype(float) / n)) / np.sqrt(e[::-1])
        assert np.allclose(np.abs(r.whitened), w, atol=1e-9)


def test_whitening_of_few_or_equal_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)]):
        vectors = spark.createDataFrame(rows, schema)
        fit = whitening.train(vectors)
        assert len(fit.values) == 0 and whitening.whiten(vectors, fit).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 3.0]), (2, [2.0, 0.0, 3.0])], schema)
    fit = whitening.train(vectors)
    assert len(fit.values) == 1 and sorted(round(r.whitened[0], 9) for r in whitening.whiten(vectors, fit).collect()) == [-1.0, 1.0]
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 0.0])], schema)
    fit = whitening.train(huge)
    assert whitening.whiten(huge, fit).count() == 2


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root, and each leaf's siblings as (left, right) by level."""
    paths, at, row = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(row) > 1:
        for path, k in zip(paths, at):
            run = k // 8 * 8
            path.append(("".join(row[run:k]), "".join(row[k + 1 : run + 8])))
        row = [h("".join(row[k : k + 8])) for k in range(0, len(row), 8)]
        at = [k // 8 for k in at]
    return row[0], paths


def plain_manifest(rows):
    """rows: (id, leaf, claim, lang)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = []
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        made.append((own, *plain_tree([r[1] for r in own])))
    root, tops = plain_tree([m[1] for m in made])
    out = []
    for (own, subroot, paths), top in zip(made, tops):
        for r, path in zip(own, paths):
            node = r[2]
            for left, right in path + top:
                node = h(left + node + right)
            out.append((r[0], r[1], subroot, root, "".join(a + b for a, b in path + top), node, node == root))
    return out


@pytest.mark.parametrize("rise", [1, 2, 4])
def test_manifest_against_a_plain_tree(spark, rise):
    rows = [(i, f"Text {i}", ("en", "de", None, "é", "z")[0 if i % 3 else i % 5]) for i in range(700)]
    rows += [(None, "no id", "en"), (None, None, "en"), (5, "again", "en"), (5, "Text 5", "en"), (5, "Text 5", "en"), (9999, None, "lone"), (9998, "", "-")]
    docs = frame(spark, rows)
    leaf = manifest.leaf_digest(F.col("doc_id"), F.col("source"), F.col("text"))
    claim = F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 64)).otherwise(leaf)
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    plain = [(i, h(part(i) + "1:s" + part(t)), lang) for i, t, lang in rows]
    want = plain_manifest([(i, d, "0" * 64 if i is not None and i % 7 == 0 else d, lang) for i, d, lang in plain])
    got = manifest.manifest(docs, leaf, claim, most=rise)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert 0 < got.where("verified").count() < len(rows)


def test_manifest_of_one_and_of_no_row(spark):
    docs = frame(spark, [(1, "a", "en")])
    leaf = manifest.leaf_digest(F.col("text"))
    r = manifest.manifest(docs, leaf, leaf).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == h("1:a") and r.proof == "" and r.verified
    assert manifest.manifest(docs.limit(0), leaf, leaf).count() == 0


def test_addresses_are_a_van_emde_boas_order():
    for levels in range(1, 6):
        every = np.concatenate([manifest.addresses(levels, d) for d in range(levels)])
        assert sorted(every.tolist()) == list(range(manifest.size(levels)))
    # Of four levels, the upper two come first, then each lower subtree of two levels as one run.
    assert manifest.addresses(4, 2)[:3].tolist() == [9, 18, 27] and manifest.addresses(4, 3)[:9].tolist() == [*range(10, 18), 19]
