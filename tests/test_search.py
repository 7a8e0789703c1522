"""Search against plain readings of small graphs."""

import math
import random
import re

from graphlens.operators import search

NODES = "id string, kind string, name string, qualname string, docstring string, summary string, is_exported boolean"


def node(name, kind="function", qualname=None, docstring=None, summary=None, exported=False):
    return (f"m.py#{name}#{kind}", kind, name, qualname or f"m.{name}", docstring, summary, exported)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(nodes, query, limit):
    """BM25 by counting every phrase in every field of every node."""
    phrases = {tuple(words(w)) for w in re.findall(r"\w+", query.lower()) if len(w) > 1 or not w.isascii()} - {()}
    fields = [{f: words(t) for f, t in zip(("name", "qualname", "docstring", "summary"), n[2:6])} for n in nodes]
    sizes = [sum(map(len, f.values())) for f in fields]
    docs, average = sum(s > 0 for s in sizes), sum(sizes) / max(1, sum(s > 0 for s in sizes))
    scores = dict.fromkeys((n[0] for n in nodes), 0.0)
    for p in phrases:
        tf = {}
        for n, f in zip(nodes, fields):
            for name, tokens in f.items():
                hits = sum(tokens[i : i + len(p) - 1] == list(p[:-1]) and tokens[i + len(p) - 1].startswith(p[-1]) for i in range(len(tokens) - len(p) + 1))
                tf[n[0]] = tf.get(n[0], 0) + hits * search.FIELD_WEIGHTS[name]
        df = sum(x > 0 for x in tf.values())
        idf = max(math.log((docs - df + 0.5) / (df + 0.5)), search.LEAST_IDF)
        for n, size in zip(nodes, sizes):
            x = tf[n[0]]
            scores[n[0]] += idf * x * (search.K1 + 1) / (x + search.K1 * (1 - search.B + search.B * size / average)) if x else 0
    found = sorted(((-round(s, 6), k) for k, s in scores.items() if s > 0))
    return [(k, -s) for s, k in found[:limit]]


def test_phrases_and_prefixes_by_plain_counts(spark):
    rng = random.Random(3)
    vocabulary = ["read", "frame", "reader", "frames", "read_frame", "a_b", "Ünïcode", "径向分布函数", "x", "re_ad", "__", "write"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    nodes = [node(f"n{k}_{rng.choice(vocabulary)}", docstring=text(rng.randrange(12)), summary=None if k % 4 else text(3)) for k in range(40)]
    asked = ["read_frame", "frame", "re x", "read_fr write", "径向", "a_b", "_ __", "rea_frame", "read_frame_a", "READ read", "ünï"]
    df = spark.createDataFrame(nodes, NODES)
    got = {}
    for r in search.bm25(df, spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), 15).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for k, q in enumerate(asked):
        want = plain(nodes, q, 15)
        assert [(i, round(s, 4)) for i, s in got.get(k, [])] == [(i, round(s, 4)) for i, s in want], q
    assert any(len(plain(nodes, q, 15)) for q in asked)


def test_a_phrase_begins_a_name_and_needs_its_parts_side_by_side(spark):
    nodes = [node("read_frame_zzz"), node("frame_read"), node("other", docstring="read the frame"), node("more", docstring="read, frame by frame"), node("split", qualname="read", summary="frame")]
    df = spark.createDataFrame(nodes, NODES)
    found = search.bm25(df, spark.createDataFrame([(1, "read_frame")], "query_id int, text string"), 10)
    assert {r.id for r in found.collect()} == {"m.py#read_frame_zzz#function", "m.py#more#function"}


def test_signals_overtake_a_lexical_lead(spark):
    nodes = [node("read_frame_aaa"), node("read_frame_zzz", exported=True), node("ex", "example"), node("test_rich", "test")]
    edges = [("m.py#ex#example", "m.py#read_frame_zzz#function", "exemplifies", "heuristic"), ("m.py#test_rich#test", "m.py#read_frame_zzz#function", "tests", "heuristic")]
    df, links = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "source string, target string, kind string, provenance string")
    out = search.search(df, links, spark.createDataFrame([(1, "read_frame"), (2, "zzz%"), (3, "e_zz")], "query_id int, text string"), 2).collect()
    first = {r.query_id: r.id for r in out if r.rank == 0}
    assert first == {1: "m.py#read_frame_zzz#function", 2: "m.py#read_frame_zzz#function", 3: "m.py#read_frame_zzz#function"}


def test_queries_of_one_text_share_its_first_nodes(spark):
    """Equal names and equal texts are cut to the limit before they meet, so that few rows are written however many there are."""
    nodes = [(f"n{k:04}", "function", "read frame", "read frame", None, "other", False) for k in range(3000)] + [("a", "function", "x", "a read frames", None, None, False)]
    df, asked = spark.createDataFrame(nodes, NODES), spark.range(500).selectExpr("id AS query_id", "'read%frame' AS text")
    found = search.contains(df, asked, 3)
    assert found.inputFiles() and spark.read.parquet(*[f for f in found.inputFiles() if "contains-" in f]).count() <= 6
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert len(got) == 500 and set(map(tuple, got.values())) == {("a", "n0000", "n0001")}


def test_words_and_phrases_store_no_row_for_each_completion(spark, monkeypatch):
    """What is stored beside the matches is as many rows as were asked for, however many words of the nodes they begin."""
    nodes = [node(f"n{k}", docstring=f"the r{k} the r{k}x the", summary="r") for k in range(60)]
    kept, real = {}, search.stored

    def counted(df, label):
        out = real(df, label)
        kept[label] = out.count()
        return out

    monkeypatch.setattr(search, "stored", counted)
    df = spark.createDataFrame(nodes, NODES)
    got = search.bm25(df, spark.createDataFrame([(1, "the_r"), (2, "r1")], "query_id int, text string"), 60).collect()
    assert {(r.query_id, r.id) for r in got} == {(q, i) for q, text in ((1, "the_r"), (2, "r1")) for i, _ in plain(nodes, text, 60)}
    assert max(n for label, n in kept.items() if label != "matches") <= 2
