import hashlib

import pytest

from graphlens.llm import exact_dedup, licenses, queries
from tests.oracle import compare

DOCS = "doc_id long, text string, h string, sha int"
ROWS = [(1, "a", "x", 1), (5, "a", "y", 2), (2, "a ", None, 3), (3, None, "x", 4), (4, "", "x", 5), (None, "b", "x", 6), (7, "c" * 5000, "x", 7), (7, "c" * 5000, "x", 7), (None, "a", "z", 8)]


@pytest.mark.parametrize("bits", [64, 2, 1])
def test_exact_groups(spark, bits):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = sorted(map(tuple, exact_dedup.report(docs, bits=bits, capacity=1).collect()), key=repr)
    want = []
    for doc_id, text, *_ in ROWS:
        group = [r[0] for r in ROWS if (r[1] or "") == (text or "")]
        keep = max((x for x in group if x is not None), default=None)
        want.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    kept = exact_dedup.drop_copies(docs, bits=bits, capacity=1)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([ROWS[1], ROWS[2], ROWS[4], ROWS[5], ROWS[6]], key=repr)
    assert exact_dedup.report(docs.limit(0)).count() == 0


def test_directory_doubles():
    slots = exact_dedup.directory({0: 10, 1: 1, 2**15: 3}, 4, 16)
    assert slots[0][1] == 16 and [s[0] for s in slots] == list(range(2**16))
    assert {s[2] for s in slots if s[0] >= 2**15} == {max(s[2] for s in slots)}
    assert exact_dedup.directory({}, 4) == [(0, 0, 0, 0)]


def test_license_places(spark):
    rows = [
        (1, "Released UNDER the MIT license; under the mit, license. cc by nc"),
        (2, None),
        (3, "Licensed under the Apache License, Version 2.0 (the 'License'); you may really not use this file except in compliance with the License"),
        (4, "Permission is hereby freely granted free of charge to every person obtaining a copy of this software and associated documentation files (the software) to deal in the software without any restriction"),
        (5, "cc by nc cc by nc by nc"),
        (5, "cc by nc cc by nc by nc"),
        (6, "éunder the mit license"),
        (None, "under the mit license"),
        (8, "cc by"),
    ]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_words, out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (12, 3, 1, 9, "cc-by-nc,mit")
    assert (out[2].n_words, out[2].n_base, out[2].first_word, out[2].labels, out[2].score) == (0, 0, None, "", 0.0)
    assert out[3].base_labels == "apache-2" and out[3].labels == "apache-2" and out[3].score == 1.0
    assert out[4].base_labels == "" and out[4].labels == "mit" and 0.6 <= out[4].score < 1
    assert (out[5].n_base, out[5].first_word, out[5].last_word) == (2, 0, 3)
    assert out[6].n_base == 0 and out[None].n_base == 1 and out[8].n_base == 0
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01")
