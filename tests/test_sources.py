"""Readers and writers on small files of their own."""

import gzip
import os

from pyspark.sql import functions as F

from linkloom.operators import ecb
from linkloom.sources import tables, warc

XML = """<?xml version="1.0" encoding="UTF-8"?>
<Document doc_name="3_2ecbplus.xml" doc_id="D1">
<token t_id="1" sentence="0" number="0">Rain</token>
<token t_id="2" sentence="0" number="1">fell</token>
<token t_id="3" sentence="1" number="0">Flood</token>
<Markables>
<ACTION_OCCURRENCE m_id="11"><token_anchor t_id="2"/></ACTION_OCCURRENCE>
<LOC_OTHER m_id="12"><token_anchor t_id="1"/></LOC_OTHER>
<ACTION_OCCURRENCE m_id="13"><token_anchor t_id="3"/></ACTION_OCCURRENCE>
<ACTION_OCCURRENCE m_id="20" RELATED_TO="" TAG_DESCRIPTOR="t20_rain" instance_id="ACT777"/>
<LOC_OTHER m_id="21" RELATED_TO="" TAG_DESCRIPTOR="t21_place"/>
</Markables>
<Relations>
<CROSS_DOC_COREF r_id="501" note="ACT777"><source m_id="11"/><target m_id="20"/></CROSS_DOC_COREF>
<INTRA_DOC_COREF r_id="502"><source m_id="12"/><target m_id="21"/></INTRA_DOC_COREF>
</Relations>
</Document>
"""


def lines_of(path):
    names = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return [line for n in names for line in open(os.path.join(path, n)).read().splitlines()]


def test_ecb(spark, tmp_path):
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a.xml").write_text(XML)
    (tmp_path / "listed.csv").write_text("Topic,File,Sentence Number\n3,2ecbplus,0\n3,2ecbplus,0\n9,1ecb,4\n")
    tokens, mentions = tables.read_ecb(spark, str(tmp_path / "xml"))
    assert [(r.sent_id, r.t) for r in tokens.select("sent_id", F.col("token").alias("t")).orderBy("token_id").collect()] == [(0, "Rain"), (0, "fell"), (1, "Flood")]
    relations, targets = tables.read_ecb_relations(spark, str(tmp_path / "xml"))
    assert {tuple(r) for r in relations.collect()} == {("3_2ecbplus.xml", 501, "CROSS_DOC_COREF", 11, 20), ("3_2ecbplus.xml", 502, "INTRA_DOC_COREF", 12, 21)}
    got = ecb.with_clusters(mentions.select("doc", "m_id", "is_event"), relations, targets)
    assert {(r.m_id, r.cluster_id, r.cluster_desc) for r in got.collect()} == {(11, 777, "t20_rain"), (12, 5020, "t21_place"), (13, 100_000_000, "")}
    listed = tables.read_validated_sentences(spark, str(tmp_path / "listed.csv"))
    kept = ecb.of_listed_sentences(tokens, listed, "doc", "sent_id")
    assert {r.token_id for r in kept.collect()} == {1, 2}


def test_conll_round_trip(spark, tmp_path):
    rows = [("t1", "d", i, f"w{i}", "(7)" if i == 2 else "-") for i in range(40)] + [("t2", "e", i, f"v{i}", "-") for i in range(3)]
    tokens = spark.createDataFrame(rows, "topic string, doc string, i int, token string, coref string")
    tables.write_conll(tokens, str(tmp_path / "one"), "corpus", ["doc", "i"], ["doc", "i", "token", "coref"])
    lines = lines_of(tmp_path / "one")
    assert lines[0] == "#begin document (corpus); part 000" and lines[-1] == "#end document"
    assert [x.split("\t")[2] for x in lines[1:-1]] == [f"w{i}" for i in range(40)] + [f"v{i}" for i in range(3)]
    tables.write_conll(tokens, str(tmp_path / "topics"), "corpus", ["doc", "i"], ["doc", "i", "token", "coref"], topic="topic")
    back = tables.read_conll(spark, str(tmp_path / "topics")).collect()
    assert sorted((r.document, r.token_id, r.columns[2]) for r in back) == sorted((f"(corpus_{t}); part 000", i, w) for t, _, i, w, _ in rows)


def test_empty_conll(spark, tmp_path):
    tokens = spark.createDataFrame([], "doc string, i int, token string")
    tables.write_conll(tokens, str(tmp_path / "x"), "none", ["doc", "i"], ["token"])
    assert lines_of(tmp_path / "x") == ["#begin document (none); part 000", "#end document"]


def test_reports(spark, tmp_path):
    counts = spark.createDataFrame([("b.com", 3), ("a.com", 3), ("c.com", 9), (None, 1)], "host string, n long")
    tables.write_report(counts, str(tmp_path / "hosts"), "host")
    assert [x.split()[0] for x in lines_of(tmp_path / "hosts")] == ["c.com", "a.com", "b.com", "1"]
    tables.write_prefix_tree(counts, str(tmp_path / "tree"))
    assert sorted(lines_of(tmp_path / "tree"))[0] == '{"host":"a.com","n":3}'
    scores = spark.createDataFrame([("x", "1.0+-0.1", None), ("a", "2.0+-0.2", "3.0+-0.0")], "name string, muc string, lea string")
    tables.write_score_tables(scores, str(tmp_path / "scores"), "name", ["muc", "lea"])
    assert lines_of(tmp_path / "scores" / "latex") == [r"a & 2.0+-0.2 & 3.0+-0.0 \\", r"x & 1.0+-0.1 & -- \\"]
    assert tables.read_scores(spark, str(tmp_path / "scores" / "csv"), "name string, muc string, lea string").count() == 2
    for place in ("gg/lemma/x/ecbp_gvc/closure", "ss/ss_train_abc_1/y/ecbp_fcct/predicted", "gg/train/z/bbc_gvc/closure"):
        (tmp_path / "all" / place).mkdir(parents=True)
        (tmp_path / "all" / place / "scores.csv").write_text("seed,measure,metric,value\n0,muc,f1,0.5\n")
    (tmp_path / "all" / "short.csv").write_text("seed,measure,metric,value\n1,muc,f1,0.25\n")
    got = tables.read_scores(spark, str(tmp_path / "all")).select("scenario", "experiment", "dev_corpus", "test_corpus", "topics", "seed", "value")
    want = {("gg", "lemma", "n/a", "gvc", "closure", 0, 0.5), ("ss", "ss_train_abc_1", "abc", "fcct", "predicted", 0, 0.5), ("gg", "train", "bbc", "gvc", "closure", 0, 0.5), (None, None, None, None, None, 1, 0.25)}
    assert {tuple(r) for r in got.collect()} == want


def test_each_text_in_a_file(spark, tmp_path):
    texts = spark.createDataFrame([(0, "first"), (12, "second\nline")], "place long, body string")
    tables.write_each(texts, str(tmp_path / "t"), "place", "body")
    folders = sorted(x for x in os.listdir(tmp_path / "t") if x.startswith("file="))
    assert [f[:13] for f in folders] == ["file=000000_" + "8", "file=000012_" + folders[1][12]]
    assert lines_of(tmp_path / "t" / folders[1]) == ["second", "line"]


def record(uri, html, charset="utf-8"):
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n".encode() + html.encode(charset)
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    return head + http + b"\r\n\r\n"


def test_archive_records(spark, tmp_path):
    pages = [("http://a.org/1", "<p>eins</p>", "utf-8"), ("http://a.org/2", "<p>zwölf</p>", "iso-8859-1"), ("http://a.org/3", "", "utf-8")]
    rows, blob = [], b""
    for n, page in enumerate(pages):
        packed = gzip.compress(record(*page))
        rows.append(("a.warc.gz", len(blob), len(packed), n))
        blob += packed
    (tmp_path / "a.warc.gz").write_bytes(blob)
    (tmp_path / "b.warc").write_bytes(b"junk" + record("http://b.org/", "plain"))
    plain = ("b.warc", 4, len(record("http://b.org/", "plain")), 3)
    broken = [("b.warc", 0, 9, 4), ("missing.warc.gz", 0, 10, 5), ("a.warc.gz", 1, 5, 6), (None, None, None, 7)]
    index = spark.createDataFrame([*rows, plain, *broken], "filename string, offset bigint, length bigint, n int")
    got = {r.n: (r.uri, r.status, r.html) for r in warc.read_records(index, f"file://{tmp_path}").collect()}
    assert got == {**{n: (u, 200, h) for n, (u, h, _) in enumerate(pages)}, 3: ("http://b.org/", 200, "plain"), **{n: (None, None, None) for n in (4, 5, 6, 7)}}
    assert warc.read_records(index.limit(0), f"file://{tmp_path}").count() == 0


def test_conll_in_many_splits(spark, tmp_path):
    """One file read in splits of some bytes equals the file in one piece, and by hand."""
    lines, want = ["stray line"], []
    for d in range(6):
        lines.append(f"#begin document (d{d}); part 000")
        sentence, token, fresh = -1, 0, True
        for i in range(d * 13):
            if (i * 7 + d) % 5 == 0:
                lines += [""] * (1 + i % 2)
                fresh = True
            if i % 11 == 3:
                lines.append("# a comment")
            lines.append(f"d{d}\t{i}\tw{i}\t-")
            sentence, fresh = sentence + fresh, False
            want.append((f"(d{d}); part 000", sentence, token, f"w{i}"))
            token += 1
        lines += ["#end document", "outside"]
    (tmp_path / "x.conll").write_text("\n".join(lines) + "\n")
    conf = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(conf), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (before, "97b", "400b"):
            spark.conf.set(conf, size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            rows = tables.read_conll(spark, str(tmp_path / "x.conll"))
            assert sorted((r.document, r.sentence, r.token_id, r.columns[2]) for r in rows.collect()) == sorted(want)
    finally:
        spark.conf.set(conf, before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
