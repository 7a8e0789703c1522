"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows, clashing names and an empty table."""

import corpus_pipeline
from graphlens.llm import packing

SF = "/root/testdata/sf0.001"
CLASHING = ["lang", "source", "n_chars", "k", "th", "row", "spans", "dk", "rid", "h", "t", "hot", "place", "id", "class", "cut", "length"]
LONG = " ".join(f"word{k % 5000} of" for k in range(60_000))
SHARED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 3
ROWS = [
    (1, None), (2, ""), (None, None), (3, LONG), (4, LONG), (5, "short text"), (5, "short text"), (5, "another text of this id"), (None, "a text without an id"),
    (6, "first document begins so " + SHARED + " and ends here"), (7, "the second one starts another way " + SHARED + " and stops there for good"), (8, "é" * 400),
]


def frame(spark, rows):
    values = [(i, t, *[f"{c}{k}" if c != "n_chars" else k for c in CLASHING]) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(values, "doc_id long, text string, " + ", ".join(f"{c} string" if c != "n_chars" else "n_chars long" for c in CLASHING))


def test_stages_on_odd_rows(spark):
    docs = frame(spark, ROWS)
    count = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    every = sorted(ROWS, key=repr)
    want = {
        "toxicity": every,
        "exact dedup": sorted([(2, ""), (4, LONG), (5, "short text"), *ROWS[7:]], key=repr),
        "MinHash near-dedup": sorted([*ROWS[:4], *ROWS[5:6], *ROWS[7:]], key=repr),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name in want:
            assert count(out) == want[name], name
            continue
        cut = out.collect()  # the strings that stand twice go, and rows stay
        assert len(cut) == len(ROWS) and {r.lang for r in cut} == {f"lang{k}" for k in range(len(ROWS))}
        by = {int(r.lang[4:]): r for r in cut}
        assert by[0].text is None and by[2].text is None and by[1].text == "" and by[3].text == "" == by[4].text
        assert by[5].text == by[6].text == "short text" and by[8].text == ROWS[8][1] and by[3].n_chars == 0
        assert by[9].text.startswith("first document begins") and by[9].text.endswith("ends here") and len(by[9].text) < 120
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.filter("doc_id = 2").select("length").first().length == 1 and corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0
    assert packed.groupBy("sequence_id").sum("length").toDF("s", "n").filter("n > 2048").count() == 0


def test_search_goes_on_until_no_step_helps():
    """Two-for-one steps from any bin: no move, exchange or pair exchange is left that would raise the sum of squared fills."""
    lengths = [7, 7, 6, 5, 5, 4, 3, 3, 9, 8, 2, 6, 7, 5]
    bins = packing.local_search(packing.best_fit(lengths, 13), lengths, 13)
    fill = [sum(lengths[i] for i in b) for b in bins]
    for a in range(len(bins)):
        for b in range(len(bins)):
            if a != b and fill[a] >= fill[b] and 0 < fill[a] < 13:
                gives = [(lengths[i],) for i in bins[b]] + [(lengths[i], lengths[j]) for n, i in enumerate(bins[b]) for j in bins[b][n + 1 :]]
                for out in [0, *[lengths[i] for i in bins[a]]]:
                    for into in gives:
                        gain = sum(into) - out
                        assert not (0 < gain <= 13 - fill[a] and (out or len(into) == 1)), (bins, out, into)
