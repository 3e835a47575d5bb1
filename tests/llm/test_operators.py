"""Edge cases and brute-force versions of the training-data operators."""

import math
import os
import random
import tracemalloc
from collections import Counter

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from linkloom.llm import decontamination, language_id, license_scan, mixing, near_dedup, quality_cnn, quality_rules, token_counts, toxicity, url_filter  # noqa: E402
from linkloom.operators import components  # noqa: E402
from linkloom.operators.components import connected_components  # noqa: E402
from linkloom.operators.materialize import Scratch  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
RNG = random.Random(11)
WORDS = ["the", "and", "house", "river", "walks", "green", "light", "morning", "idea", "never", "paper", "stone", "over", "under", "small"]


def prose(n, rng=RNG, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "   \n\t "), (None, "No id here at all."), (5, "Twice the same."), (5, "Twice the same."), (7, "x" * 50_000), (8, "é😀日本 ▁▁ <s> </s> \x00   end")]


def every_operator(spark):
    """Each operator as a function of documents alone."""
    net = quality_cnn.fit([prose(20), "### *** %%%"] * 3, [1, 0] * 3)
    fm = toxicity.fit([prose(20), prose(10) + " scum"] * 3, [0, 1] * 3)
    train = frame(spark, [(i, prose(30)) for i in range(5)])
    filters = language_id.train(train, F.lit(True))
    bench = spark.createDataFrame([(1, "twice the same"), (2, None), (3, ""), (None, "no id here at all")], "item_id long, text string")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    return {
        "tokens": lambda d: token_counts.count_tokens(d, MODEL),
        "language": lambda d: language_id.identify(d, filters),
        "licences": lambda d: license_scan.scan_licenses(d),
        "rules": lambda d: quality_rules.clean_lines(d, with_text=True),
        "leaks": lambda d: decontamination.find_leaks(d, bench),
        "clean": lambda d: decontamination.decontaminate(d, bench),
        "mix": lambda d: mixing.mix_sources(d, levels, {}, 0.7),
        "toxicity": lambda d: toxicity.score_toxicity(d, fm),
        "near": lambda d: near_dedup.near_duplicates(d),
        "near_drop": lambda d: near_dedup.drop_near_duplicates(d),
        "quality": lambda d: quality_cnn.score_quality(d, net),
        "keep": lambda d: quality_cnn.keep_quality(d, net, 0.0),
        "languages": lambda d: language_id.filter_languages(d, filters, ("en",), 0.0),
    }


ONE_FOR_ONE = ("tokens", "language", "licences", "rules", "toxicity", "near", "quality", "keep")


def test_odd_rows_empty_tables_and_extra_columns(spark):
    docs = frame(spark, ODD)
    extra = docs.withColumns({c: F.lit("clash") for c in ("score", "kept", "labels", "class_id", "n_words", "words", "node", "item_id", "h", "id", "key", "epoch", "rest")})
    for name, f in every_operator(spark).items():
        n = f(docs).count()
        assert f(extra).count() == n, name
        assert f(docs.limit(0)).count() == 0, name
        if name in ONE_FOR_ONE:
            assert n == len(ODD), name


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


MACHINE = token_counts.Transducer(open(MODEL, "rb").read())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁theinganrs0123.,<>é日😀"), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_token_counts_equal_the_library(texts):
    assert MACHINE.counts(texts).tolist() == [len(x) for x in library().encode(texts)]


def test_token_counts_across_chunks():
    rng = random.Random(5)
    texts = ["a" * 5000, " " * 2000, "".join(rng.choice("abcdefgh") for _ in range(9000)), "th" * 4000 + " " + "日" * 3000]
    assert MACHINE.counts(texts).tolist() == [len(x) for x in library().encode(texts)]


LANGS = {"aa": "bada gada kada lana mara".split(), "bb": "sito vito nipo tiro zilo".split(), "cc": "umuk trux pfunz klug".split()}


def test_language_held_out_accuracy(spark):
    rows = [(i, prose(30, random.Random(i), LANGS[k]), k, "s", 1) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    docs = spark.createDataFrame(rows, DOCS)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    got = language_id.identify(docs, language_id.train(docs, ~held)).collect()
    want = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == want[r.doc_id] and r.score > 0.5 for r in got)
    odd = language_id.identify(frame(spark, [(1, None), (2, "123 ..."), (3, "")]), language_id.train(docs, F.lit(True))).collect()
    assert [(r.lang_pred, r.score) for r in odd] == [("und", 0.0)] * 3
    nothing = language_id.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_more_languages_than_a_machine_word_has_bits(spark):
    names = [f"l{k:03d}" for k in range(70)]
    docs = spark.createDataFrame([(i, prose(25, random.Random(i), [f"{chr(97 + k // 26)}{chr(97 + k % 26)}{c}x" for c in "abcdef"]), n, "s", 1) for i, (k, n) in enumerate(enumerate(names))], DOCS)
    got = language_id.identify(docs, language_id.train(docs, F.lit(True))).collect()
    assert all(r.lang_pred == names[r.doc_id] for r in got)


def licence_by_hand(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [i for t in license_scan.BASE for i in range(len(words)) if words[i : i + len(t.sequence)] == t.sequence]
    return len(words), len(at), min(at, default=None), max(at, default=None)


def test_licence_places(spark):
    texts = ["MIT License, mit-license; the Apache license", "general public license " * 3, "mit", None, "GNU General Public License v3, licensed under CC BY-NC 4.0", "Kit license mıt license"]
    got = license_scan.scan_licenses(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == licence_by_hand(t)
    assert got[0].base_labels == "apache,mit" and got[4].labels == "cc-by-nc,gpl" and got[3].labels == ""


def test_line_rules(spark):
    good = "\n".join(prose(12, random.Random(i)) for i in range(6))
    nav = "\n".join(["Home | About | Contact | Shop | News | More | Help | Jobs"] * 1 + ["A | B | C | D | E | F | G | H | I | J | K"] * 3)
    short = prose(10)
    rows = [(1, good), (2, nav), (3, short), (4, good + "\nAll rights reserved."), (5, (prose(10, random.Random(3)) + " ") * 9)]
    got = {r.doc_id: r for r in quality_rules.clean_lines(frame(spark, rows), with_text=True).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4, 5)] == [True, False, False, True, False]
    assert got[3].base_failed and got[5].base_failed and not got[1].base_failed
    assert got[4].cleaned == good and got[2].n_dup_lines == 2


def leaks_by_hand(docs, items):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in items:
        w = words(t)
        k = min(5, len(w))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, x in docs:
            v = words(x)
            if s and len(s & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}) >= 0.8 * len(s) - 1e-9:
                out.add((d, i))
    return out


def test_decontamination_by_hand(spark):
    rng = random.Random(2)
    items = [(i, prose(rng.choice([2, 3, 4, 5, 8, 20, 40]), rng, [f"w{k}" for k in range(60)])) for i in range(25)]
    docs = []
    for d in range(60):
        body = prose(rng.choice([30, 300]), rng, [f"w{k}" for k in range(60)]).split()
        if d % 3:
            words = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 1, 3])):
                words[rng.randrange(len(words))] = "changed"
            body[5:5] = words
        docs.append((d, " ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = leaks_by_hand(docs, items)
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame(spark, docs), bench).collect()} == want
    kept = {r.doc_id for r in decontamination.decontaminate(frame(spark, docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want} and len(kept) > 10
    assert decontamination.decontaminate(frame(spark, docs), bench.limit(0)).count() == len(docs)


def test_decontamination_of_repeated_and_null_item_ids(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    for item in (7, None):
        short, long = "blue stone", prose(20, rng, words)
        bench = spark.createDataFrame([(item, short), (item, long)], "item_id long, text string")
        docs = frame(spark, [(1, prose(30, rng, words) + " " + short), (2, long + " " + prose(30, rng, words)), (3, short + " " + long), (4, "blue " + long + " stone")])
        got = sorted((r.doc_id, r.n_item) for r in decontamination.find_leaks(docs, bench).collect())
        assert got == [(1, 1), (2, 16), (3, 1), (3, 16), (4, 16)]
        assert decontamination.decontaminate(docs, bench).count() == 0


def test_url_rules(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/"), ("allow", "a.com", "/de/x")]
    rows = [(1, "http://X.example.ORG/es/1"), (2, "http://example.org"), (3, "http://a.com/de/xy?q"), (4, "http://b.com/de/x"), (5, None), (6, "nothing"), (7, "http://m.free-bets.example.net/"), (8, "http://notexample.org/es/"), (8, "http://notexample.org/es/")]
    got = sorted(url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect())
    assert [(r.page_id, r.rule, r.verdict) for r in got] == [
        (1, "example.org/es/", "block"), (2, None, "allow"), (3, "a.com/de/x", "allow"), (4, "com/de/", "block"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow"), (8, "org/", "allow"), (8, "org/", "allow"),
    ]
    assert got[4].host == "" and got[4].path == "" and got[0].host == "x.example.org"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    named = spark.createDataFrame([(1, "http://a.org/", 5), (None, "http://x.net", 6)], "id long, url string, digest int")
    got = url_filter.judge_urls(named, rules, "id", default="block")
    assert got.columns == ["id", "host", "path", "rule", "verdict"] and {(r.id, r.verdict) for r in got.collect()} == {(1, "allow"), (None, "block")}
    assert [r.verdict for r in url_filter.judge_urls(named, [], "id").collect()] == ["allow"] * 2
    # The join key is the short prefix alone; a long host has as many expressions as the rules have shapes.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join [short" in plan and "digest" not in plan.split("Join [short")[1].split("]")[0]
    long = spark.createDataFrame([(1, "http://" + "a." * 100_000 + "com/de/x" + "y" * 100_000)], "page_id long, url string")
    assert url_filter.judge_urls(long, rules).first().rule == "a.com/de/x"


def test_url_rules_that_share_a_short_prefix(spark, monkeypatch):
    # With a prefix of one digit most rules meet most expressions: digests alone decide.
    monkeypatch.setattr(url_filter, "hashed", lambda e, c: e.withColumn("digest", F.sha2(F.col(c), 256)).withColumn("short", F.substring("digest", 1, 1)))
    rules = [(("allow", "block")[k % 2], f"h{k}.com", "/") for k in range(100)]
    pages = spark.createDataFrame([(k, f"http://w.h{k}.com/p") for k in range(120)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {k: (f"h{k}.com/", ("allow", "block")[k % 2]) if k < 100 else (None, "allow") for k in range(120)}


def test_mix_redistributes_among_siblings_first(spark):
    # Domain x has languages p (scarce) and q; y is plentiful. What p lacks goes to q, not to y.
    rows = [(i, "w " * 10, lang, src, 1) for i, (lang, src) in enumerate([("p", "x")] * 2 + [("q", "x")] * 50 + [("r", "y")] * 100)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(docs, {"domain": F.col("source"), "lang": F.col("lang")}, {}, 400 / 1520, max_epochs=2)
    got = {(r.domain, r.lang): r.leaf_budget for r in out.select("domain", "lang", "leaf_budget").distinct().collect()}
    assert got == {("x", "p"): 40, ("x", "q"): 160, ("y", "r"): 200}
    taken = {r.lang: r.n for r in out.groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()}
    assert taken == {"p": 40, "q": 160, "r": 200}
    assert out.where("lang = 'p'").groupBy("doc_id").count().where("count = 2").count() == 2


def test_licenses_of_a_phrase_repeated_100000_times(spark):
    # Linear in the hits: this took minutes when every vote was counted against every other.
    import time

    docs = frame(spark, [(1, "mit license " * 100_000), (2, "general public license " * 50_000), (3, "x " * 200_000)])
    start = time.time()
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).drop("places").collect()}
    assert time.time() - start < 60
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words) == (100_000, 0, 199_998, 200_000)
    assert (got[2].n_base, got[2].labels, got[3].n_base) == (50_000, "gpl", 0)


@pytest.mark.parametrize("text", ["a" * 10**6, "ab " * 300_000, "é" * 200_000, "0123456789" * 50_000, "!" * 300_000])
def test_token_counts_of_long_runs(text):
    # State maps compose: passes grow with the logarithm of the number of chunks.
    with open(MODEL, "rb") as f:
        machine = token_counts.Transducer(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert machine.counts([text]).tolist() == [len(sp.encode(text))]
    assert machine.passes <= 4 + math.log2(len(text) / token_counts.CHUNK)


def test_state_maps_are_composed_in_order():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 100):
        enter = np.tile(np.arange(4), (n, 1))
        leave = rng.integers(0, 4, (n, 4))
        at = [0]
        for k in range(n - 1):
            at.append(leave[k, at[-1]])
        assert token_counts.composed(enter, leave).tolist() == at


def test_mix_weights_of_zero_and_seeds(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "p", "ab"[i % 2], 1) for i in range(200)], DOCS)
    level = {"source": F.col("source")}
    out = mixing.mix_sources(docs, level, {"source": {"a": 0}}, 0.3)
    assert {r.source for r in out.collect()} == {"b"}
    first, same, other = (sorted(r.doc_id for r in mixing.mix_sources(docs, level, {}, 0.4, seed=s).collect()) for s in (1, 1, 2))
    assert first == same != other


def test_toxicity_interactions():
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append(prose(12, rng, [f"w{k}" for k in range(400)]) + " dirt" * insult + " northerners" * group)
        labels.append(int(insult and group))
    m = toxicity.fit(texts[:900], labels[:900])
    import pyarrow as pa

    s = m.scores(pa.array(texts[900:], pa.large_string()))
    assert sum((x >= 0.7) == bool(y) for x, y in zip(s, labels[900:])) > 0.97 * 300
    assert toxicity.fit([], []).scores(pa.array(["x", None])).tolist() == pytest.approx([0, 0], abs=1e-9)
    assert toxicity.fit(["a", "b"], [1, 1]).scores(pa.array(["x"]))[0] > 0.99


@pytest.mark.parametrize("label", ["xor", "neutral"])
def test_toxicity_of_terms_without_marginal_effect(label):
    # Exactly one of two terms; or an insult that only weighs next to a group, which is neutral alone.
    import pyarrow as pa

    rng = random.Random(5)
    texts, labels = [], []
    for _ in range(3000):
        one, other = rng.random() < 0.5, rng.random() < 0.5
        texts.append(prose(12, rng, [f"w{k}" for k in range(400)]) + " dirt" * one + " northerners" * other)
        labels.append(int(one != other) if label == "xor" else int(one == other))
    m = toxicity.fit(texts[:2500], labels[:2500])
    s = m.scores(pa.array(texts[2500:], pa.large_string()))
    assert sum((x >= 0.5) == bool(y) for x, y in zip(s, labels[2500:])) > 0.95 * 500


def test_toxicity_equals_the_sum_over_pairs():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    g = np.random.default_rng(2)
    m = toxicity.Machine(0.3, g.normal(0, 0.5, 1 << toxicity.DIM_BITS), g.normal(0, 0.4, (1 << toxicity.DIM_BITS, toxicity.FACTORS)), 0.8, -0.1)
    texts = [prose(rng.choice([1, 5, 30]), rng) for _ in range(40)] + ["", None, "Twice twice TWICE", "é é ß"]
    got = m.scores(pa.array(texts, pa.large_string()))
    for text, score in zip(texts, got):
        _, ids = toxicity.terms(pa.array([text], pa.large_string()))
        z = m.bias + sum(m.weight[i] for i in ids)
        for a in range(len(ids)):
            for b in range(a):
                z += float(m.factor[ids[a]] @ m.factor[ids[b]])
        assert score == pytest.approx(1 / (1 + np.exp(-(m.slope * z + m.shift))), abs=1e-9)
    assert len(toxicity.terms(pa.array(["Twice twice TWICE"], pa.large_string()))[1]) == 1


def test_quality_network_covers_whole_texts():
    import pyarrow as pa

    rng = random.Random(6)
    texts = [prose(rng.choice([5, 40, 200]), rng) if i % 2 else " ".join(w + "***" for w in prose(rng.choice([5, 40, 200]), rng).split()) for i in range(400)]
    net = quality_cnn.fit(texts[:300], [i % 2 for i in range(300)])
    s = net.scores(pa.array(texts[300:], pa.large_string()))
    assert sum((x >= 0.5) == bool(i % 2) for i, x in enumerate(s)) >= 97
    # Scores don't depend on what shares the slice, and the end of a long text counts.
    one = net.scores(pa.array([texts[301]], pa.large_string()))[0]
    assert one == pytest.approx(s[1], abs=1e-6)
    long = prose(2000, rng)
    assert net.scores(pa.array([long + " x***y%%%" * 3000], pa.large_string()))[0] < net.scores(pa.array([long], pa.large_string()))[0] - 0.1


def quality_by_hand(net, text):
    import numpy as np

    raw = text.encode()
    blocks = -(-(len(raw) + quality_cnn.WIDTH - quality_cnn.STRIDE) // quality_cnn.BLOCK_BYTES)
    data = raw + bytes(blocks * quality_cnn.BLOCK_BYTES + quality_cnn.WIDTH - len(raw))
    best = np.zeros((blocks, quality_cnn.FILTERS))
    for start in range(0, max(len(raw), 1), quality_cnn.STRIDE):
        response = net.bias + sum(net.embed[data[start + j]] @ net.kernel[j] for j in range(quality_cnn.WIDTH))
        k = start // quality_cnn.BLOCK_BYTES
        best[k] = np.maximum(best[k], response)
    chunks = best if blocks == 1 else np.maximum(best[:-1], best[1:])
    z = np.concatenate((chunks.mean(axis=0), best.max(axis=0), [1])) @ net.head
    return 1 / (1 + np.exp(-z))


def test_quality_scores_window_by_window():
    import pyarrow as pa

    rng = random.Random(12)
    net = quality_cnn.fit([prose(30, rng) if i % 2 else "### *** %%% é" * (i + 1) for i in range(30)], [i % 2 for i in range(30)])
    texts = ["", "x", "été ß 日本", prose(3, rng), prose(60, rng), prose(400, rng), "*" * 255, "*" * 256, "a" * 257, prose(90, rng) + " ### " * 70]
    got = net.scores(pa.array(texts, pa.large_string()))
    assert got.tolist() == pytest.approx([quality_by_hand(net, t) for t in texts], abs=1e-4)


@pytest.mark.parametrize("length", [*range(250, 258), *range(506, 514)])
def test_quality_scores_ignore_neighbours(length):
    import pyarrow as pa

    net = quality_cnn.fit([prose(20, random.Random(i)) if i % 2 else "### *** %%%" * (i + 1) for i in range(12)], [i % 2 for i in range(12)])
    text = (prose(200, random.Random(3)))[:length]
    layouts = [[text], [text, "%%%***###"], [text, "zzzzzzzz"], ["x", text, "\x7f~}|{`_^"]]
    parts = [quality_cnn.lay_out(pa.array(t, pa.large_string())) for t in layouts]
    seen = [net.features(b)[0][t.index(text)] for b, t in zip(parts, layouts)]
    assert all((x == seen[0]).all() for x in seen)
    for b, t in zip(parts, layouts):
        at = b.first[t.index(text)] * quality_cnn.BLOCK_BYTES + length
        assert not b.data[at : at + quality_cnn.WIDTH - quality_cnn.STRIDE].any()


def distance_by_hand(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 16))
def test_banded_distance(a, b, limit):
    assert near_dedup.edit_distance(a, b, limit) == min(distance_by_hand(a, b), limit + 1)


def test_distance_of_very_long_texts():
    # Half a million distinct words: bounded time and memory (a bit for each pair of places took 30 GB).
    a = list(range(500_000))
    b = [x for x in a if x % 5000] + [-1] * 7
    assert near_dedup.edit_distance(a, b, 100_000) == 107
    tracemalloc.start()
    places = near_dedup.Places(a)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    assert places.within(5000, 4990, 64) == 1 << 10 and places.within(2048, 2040, 9) & 0x1FF == 1 << 8


def test_quality_of_a_long_text_in_bounded_memory(monkeypatch):
    import pyarrow as pa

    net = quality_cnn.fit([prose(20), "### *** %%%"] * 3, [1, 0] * 3)
    texts = pa.array([prose(50), None, "", prose(3000), "x" * 40_000])
    whole = net.scores(texts)
    monkeypatch.setattr(quality_cnn, "PART_BLOCKS", 3)
    assert (net.scores(texts) == whole).all()
    monkeypatch.undo()
    long = pa.array(["A sentence that comes again and again. " * 500_000])
    tracemalloc.start()
    score = net.scores(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 7 * long.nbytes + (64 << 20) and 0 <= score[0] <= 1


def test_distance_across_blocks(monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BAND", 1)
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(30))]
        b = [x for x in a if rng.random() < 0.8] if rng.random() < 0.7 else [rng.randrange(4) for _ in range(rng.randrange(30))]
        limit = rng.randrange(20)
        assert near_dedup.edit_distance(a, b, limit) == min(distance_by_hand(a, b), limit + 1)


def test_words_in_common_are_counted_at_once():
    # Repeated words count as often as both texts have them; texts are told apart by their own words alone.
    rng = random.Random(29)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))] for _ in range(40)] + [["z"]]
    bags = near_dedup.Bags(texts)
    for x in range(len(texts)):
        others = near_dedup.np.array([y for y in range(len(texts)) if (x + y) % 3])
        assert bags.common(x, others).tolist() == [(Counter(texts[x]) & Counter(texts[y])).total() for y in others]


def test_near_duplicates_against_all_pairs(spark):
    # All pairs by edit distance and their closure: what is linked is linked rightly, and at least nine
    # tenths of the similar pairs end in one class, although sketches may miss some (of pairs with an
    # edit in every seventh word or so, which share few runs of five words, they miss many).
    rng = random.Random(17)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(60):
        base = prose(rng.choice([3, 8, 30, 90]), rng, words).split()
        for _ in range(5):
            copy = [w if rng.random() > rate else rng.choice(words) for rate in [rng.choice([0, 0.02, 0.05, 0.1])] for w in base]
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    lists = {i: near_dedup.words_of(t)[0] for i, t in rows}
    root = {i: i for i in lists}
    similar = []
    for i in lists:
        for j in range(i):
            longest = max(len(lists[i]), len(lists[j]))
            if abs(len(lists[i]) - len(lists[j])) <= 0.2 * longest and distance_by_hand(lists[i], lists[j]) <= int(0.2 * longest + 1e-9):
                similar.append((i, j))
                old, new = root[i], root[j]
                root = {k: new if r == old else r for k, r in root.items()}
    assert all(root[i] == root[j] for i in got for j in got if got[i] == got[j])
    assert len(similar) > 200 and sum(got[i] == got[j] for i, j in similar) >= 0.9 * len(similar)


def test_near_duplicates_by_hand(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    shared = prose(60, rng, words)
    rows, group = [], {}
    for g in range(30):
        base = prose(rng.choice([4, 6, 40, 120, 300]), rng, words).split()
        if g % 3 == 0 and len(base) >= 120:
            base += shared.split()
        for c in range(rng.choice([1, 2, 3, 40])):
            copy = list(base)
            if len(base) > 30:
                for _ in range(rng.choice([0, 1, 2])):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
            i = len(rows) * 3 + 1
            rows.append((i, " ".join(copy)))
            group[i] = g
    rng.shuffle(rows)
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    least = {}
    for i, g in group.items():
        least[g] = min(i, least.get(g, i))
    assert {i: r.class_id for i, r in got.items()} == {i: least[g] for i, g in group.items()}
    assert {r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()} == set(least.values())


@pytest.mark.parametrize("size", [2000, 1 << 21])
def test_near_duplicates_in_a_hot_bucket(spark, monkeypatch, size):
    # One bucket of many parts, in many cells or in one: pairs of similar texts that miss all
    # representatives are linked too.
    monkeypatch.setattr(near_dedup, "CELL_BYTES", size)
    rng = random.Random(13)
    words = [f"w{k}" for k in range(60)]
    passage = prose(12, rng, words)
    rows = []
    for g in range(60):
        own = prose(rng.choice([2, 20, 28]), rng, words).split()
        rows.append((2 * g, " ".join(own) + " " + passage))
        own[rng.randrange(len(own))] = "changed"
        rows.append((2 * g + 1, " ".join(own) + " " + passage))
    docs = frame(spark, rows)
    nodes = docs.select(F.xxhash64("text").alias("node"), F.col("doc_id").alias("id"), F.octet_length("text").alias("bytes"), F.size(F.split("text", " ")).alias("words"), F.array(F.lit(7).cast("long")).alias("sketch"))
    scratch = Scratch(spark)
    parts = near_dedup.components(near_dedup.Texts(docs, nodes, "doc_id", "text"), 0.8, scratch)
    got = {r.id: r.part for r in nodes.join(parts, "node", "left").select("id", F.coalesce("component", "node").alias("part")).collect()}
    scratch.clear()
    lists = {i: near_dedup.words_of(t)[0] for i, t in rows}
    root = {i: i for i in lists}
    for i in lists:
        for j in lists:
            longest = max(len(lists[i]), len(lists[j]))
            if i < j and root[i] != root[j] and distance_by_hand(lists[i], lists[j]) <= int(0.2 * longest + 1e-9):
                old = root[j]
                root = {k: root[i] if r == old else r for k, r in root.items()}
    classes = lambda of: {frozenset(i for i in of if of[i] == c) for c in of.values()}
    assert classes(got) == classes(root) and 20 < len(classes(root)) < 110


def test_near_duplicates_contract_about_a_link_a_text(spark, monkeypatch):
    # Near copies meet many heads, and a passage puts them into large buckets: components got every such link, again in each step.
    monkeypatch.setattr(near_dedup, "CELL_BYTES", 2000)
    rng = random.Random(29)
    words = [f"w{k}" for k in range(400)]
    base, passage = prose(150, rng, words).split(), prose(40, rng, words)
    rows = []
    for i in range(300):
        copy = list(base) if i % 2 else prose(60, rng, words).split() + passage.split()
        for _ in range(3 * (i % 2)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    counts = []
    for module in (near_dedup, components):
        monkeypatch.setattr(module, "connected_components", lambda e, *rest: counts.append(e.count()) or connected_components(e, *rest))
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (1, 150) if i % 2 else (i, 1) for i in range(300)}
    assert len(counts) > 1 and sum(counts) <= 2 * len(rows)


def test_near_duplicates_of_repeated_rows_and_nulls(spark):
    docs = frame(spark, [(3, "Same text."), (3, "Same text."), (None, "Same text."), (4, None), (6, None), (7, "")])
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 3, 3), (3, 3, 3), (None, 3, 3), (4, 4, 1), (6, 6, 1), (7, 7, 1)], key=str)
    kept = sorted((r.doc_id for r in near_dedup.drop_near_duplicates(docs).collect()))
    assert kept == [3, 4, 6, 7]


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (prose(60, random.Random(k), [f"w{k}{j}" for j in range(40)]) for k in range(3))
    # Two classes whose smallest id is 5, two without any id, and one id with two texts of one class.
    rows = [(5, a), (6, a), (5, b), (7, b), (None, c), (None, c), (None, c[:-30]), (None, "Alone here."), (None, "Alone here."), (9, a + " more"), (9, a + " other")]
    docs = frame(spark, rows)
    of = {(r.doc_id, r.class_size, r.class_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert len({x[2] for x in of}) == 4 and sorted(n for _, n in {(x[2], x[1]) for x in of}) == [2, 2, 3, 4]
    assert 5 in {x[2] for x in of} and all(x[2] is not None for x in of)
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(docs).collect()), key=str)
    assert [k for k in kept if k[0] is not None] == sorted([(5, a), (5, b)]) and len(kept) == 4 and (None, "Alone here.") in kept


def test_near_duplicates_are_linear_in_repeated_rows(spark):
    a = prose(200)
    for n in (200, 20_000):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, a).otherwise(a + " and more").alias("text"))
        docs = spark.createDataFrame([(2, "Something else.")], "doc_id long, text string").unionByName(rows)
        texts = near_dedup.Texts(docs, near_dedup.fingerprints(docs, "doc_id", "text").groupBy("node").agg(F.min("id").alias("id")), "doc_id", "text")
        assert texts.of(docs.select(F.xxhash64("text").alias("node")).distinct()).count() == 3
        got = near_dedup.near_duplicates(docs)
        assert got.groupBy("class_id", "class_size").count().count() == 2 and near_dedup.drop_near_duplicates(docs).count() == 2


def test_odd_rows_have_defined_values(spark):
    docs = frame(spark, ODD)
    run = every_operator(spark)
    rows = {name: run[name](docs).collect() for name in ("tokens", "language", "licences", "toxicity", "quality", "near")}
    of = lambda name, i: [r for r in rows[name] if r.doc_id == i]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in ODD:
        assert all(r.n_tokens == len(sp.encode(t or "")) and r.n_bytes == len((t or "").encode()) for r in of("tokens", i))
    assert [(r.lang_pred, r.score) for i in (1, 2, 3) for r in of("language", i)] == [("und", 0.0)] * 3
    assert all((r.n_base, r.first_word, r.labels, r.score) == (0, None, "", 0.0) for r in rows["licences"])
    for name in ("toxicity", "quality"):
        # Null and empty texts score alike, repeated rows too.
        assert of(name, 1)[0].score == of(name, 2)[0].score and len({r.score for r in of(name, 5)}) == 1
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows[name])
    named = {(r.doc_id, r.class_id, r.class_size) for r in rows["near"] if r.doc_id is not None}
    assert named == {(1, 1, 1), (2, 2, 1), (3, 3, 1), (5, 5, 2), (7, 7, 1), (8, 8, 1)} and len({r.class_id for r in rows["near"]}) == 7
    pages = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "http://a.org/x", 1), (3, "", 2), (4, "://", 3), (5, "http://" + "x" * 100_000 + ".org/" + "y" * 100_000, 4)], "page_id long, url string, host int")
    got = [(r.page_id, r.rule, r.verdict) for r in url_filter.judge_urls(pages, [("block", "org", "/")]).collect()]
    assert sorted(got, key=str) == sorted([(1, None, "allow"), (1, None, "allow"), (None, "org/", "block"), (3, None, "allow"), (4, None, "allow"), (5, "org/", "block")], key=str)


def test_stages_pass_columns_of_any_name(spark):
    # Rows with names that the operators use themselves, nulls in them too.
    names = ["__key", "own", "leak", "node", "class_id", "name", "row", "part", "bucket"]
    rows = [(1, "One two three four five six seven.", "en", None, *range(9)), (2, "One two three four five six seven.", "en", "s", *range(9)), (3, "Leaked words stand here at the end.", "en", "s", *[None] * 9), (None, None, None, None, *range(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    bench = spark.createDataFrame([(1, "leaked words stand here at the end")], "item_id long, text string")
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, [r for r in docs.collect() if r.doc_id != 2]))
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, [r for r in docs.collect() if r.doc_id != 3]))
    assert {r.doc_id for r in decontamination.find_leaks(docs, bench).collect()} == {3}


def grams_by_hand(text):
    letters = "".join(c if c.isalpha() or 0x300 <= ord(c) < 0x370 else "\0" for c in text.lower())
    padded = f"\0{letters}\0"
    for n in language_id.ORDERS:
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if "\0" not in g[1:-1] and g.strip("\0") and not (g[0] == g[-1] == "\0"):
                yield g


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_language_filters_against_sets(spark):
    # The same n-grams in plain sets: filters hold all of them and few others, and decide alike.
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    filters = language_id.train(docs, F.lit(True))
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect() if r.text and r.lang]
    counts = {k: Counter(g for t, lang in rows if lang == k for g in grams_by_hand(t)) for k in filters.languages}
    share = {k: {g: n / c.total() for g, n in c.items() if n / c.total() >= language_id.MIN_SHARE} for k, c in counts.items()}
    most = Counter()
    for found in share.values():
        for g, x in found.items():
            most[g] = max(most[g], x)
    sets = [{g for g, x in share[k].items() if x * language_id.RATIO >= most[g]} for k in filters.languages]
    texts = [t for t, _ in rows][:120] + ["Zzz qqq xxjj", "word"]
    total, held = filters.hits(texts)
    names, _ = filters.decide(texts)
    for i, t in enumerate(texts):
        grams = list(grams_by_hand(t))
        exact = [sum(g in known for g in grams) for known in sets]
        assert total[i] == len(grams)
        assert all(e <= h <= e + 2 + 0.001 * len(grams) for e, h in zip(exact, held[i].tolist()))
        if sorted(exact)[-1] > sorted(exact)[-2] + 2 + 0.001 * len(grams):
            assert names[i] == filters.languages[exact.index(max(exact))]


def test_language_filter_by_statement(spark):
    rng = random.Random(9)
    words = {"en": [f"the{k}" for k in range(80)], "de": [f"der{k}ung" for k in range(80)]}
    train = spark.createDataFrame([(i, prose(30, rng, words[("en", "de")[i % 2]]), ("en", "de")[i % 2], "s", 1) for i in range(40)], DOCS)
    filters = language_id.train(train, F.lit(True))
    rows = [(1, prose(20, rng, words["en"]), "en"), (2, prose(20, rng, words["en"]), "de"), (3, prose(20, rng, words["de"]), None), (4, "12 34", "en"), (5, None, "en"), (6, "", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], DOCS)
    ids = lambda **how: {r.doc_id for r in language_id.filter_languages(docs, filters, ("en", "de"), 0.5, **how).collect()}
    assert ids() == {1, 2, 3} and ids(declared="lang") == {1, 3}


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(21)
    words = {"en": [f"the{k}" for k in range(80)], "de": [f"der{k}ung" for k in range(80)]}
    item = prose(30, rng, words["en"])
    rows, bad, leaky, copies, misled = [], set(), set(), set(), set()
    for i in range(240):
        lang = "en" if i % 3 else "de"
        body = prose(rng.choice([30, 80]), rng, words[lang])
        if i % 8 == 5:
            body, _ = " ".join(w + "***" for w in body.split()), bad.add(i)
        elif i % 40 == 6:
            body, _ = body + " " + item + " " + body, leaky.add(i)
        elif i % 20 == 7 and i > 20:
            body, lang, _ = *rows[i - 20][1:3], copies.add(i)
        elif i % 40 == 8:
            lang, _ = "de" if lang == "en" else "en", misled.add(i)
        rows.append((i, body, lang, f"src{i % 4}", len(body)))
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(240) if i % 3 != 1], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = {i for i, *_ in rows}
    want = [ids - bad, ids - bad - misled, ids - bad - misled - copies, ids - bad - misled - copies - leaky]
    for (name, stage), left in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.select("doc_id").collect()} == left, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} <= want[-1] and final.count() > 0
