import numpy as np

from graphlens.llm import quality


def test_distinct_counts_all_words():
    text = " ".join(["n%dx" % k for k in range(200)] + ["w%dx" % (k % 20) for k in range(10_000)]).encode()
    part = np.frombuffer(text, np.uint8)
    found = quality.measures(part, np.array([0, len(part)]))["distinct"][0]
    assert abs(found - (200 + 50 * 20) / 10_200) < 1e-9


def test_lesson_is_of_whole_texts(spark, monkeypatch):
    """Texts that are clean for 20 000 characters and junk after are taught with the label of the whole text."""
    clean = "the cat sat on the mat and a dog ran to the house in a big town by the sea " * 300
    rows = [(k, clean[: 22_000 - k] + "| #$% ||| !!! 99 " * 3_000) for k in range(20)] + [(100 + k, clean[: 9_000 - k]) for k in range(20)]
    seen, fit = [], quality.fit

    def spy(bounds, features, *rest):
        seen.extend(rest[-1].tolist())
        return fit(bounds, features, *rest)

    monkeypatch.setattr(quality, "fit", spy)
    weak = [r.weak for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert np.allclose(sorted(seen), sorted(weak)) and len(seen) == len(rows)


def test_counted_features_fit_as_repeated_ones():
    features, bounds = np.array([5, 5, 9, 5, 7, 7, 7]), np.array([0, 4, 4, 7])
    found, times, at = quality.counted(features, bounds)
    assert found.tolist() == [5, 9, 7] and times.tolist() == [3, 1, 3] and at.tolist() == [0, 2, 2, 3]
    target = np.array([1.0, 0.5, 0.0])
    assert np.allclose(quality.fit(at, found, times, target), quality.fit(bounds, features, np.ones(7), target))
