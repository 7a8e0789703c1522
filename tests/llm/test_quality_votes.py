import numpy as np

from graphlens.llm import quality

SF = "/root/testdata/sf0.01"


def pattern(text):
    part = np.frombuffer(text.encode(), np.uint8)
    return quality.digits(quality.votes(quality.measures(part, np.array([0, len(part)]))))[0].tolist()


def test_votes_by_plain_counts():
    """Each labeller's vote from the text's own counts."""
    prose = "The cat sat on the mat and the dog ran to a house in the town by the sea with all of its friends. "
    assert pattern(prose) == [0, 0, 0, 0, 0, 0, 2, 2, 2]
    assert pattern(prose + "$%&" * 20) == [1, 0, 0, 0, 0, 0, 2, 2, 0]
    assert pattern(prose.upper() + "!!!!!!") == [0, 0, 1, 1, 0, 0, 2, 2, 0]
    assert pattern((prose + "\n") * 8)[5:] == [1, 2, 1, 0]
    assert pattern("zxq vbn qwp jkl mnb rty fgh")[6:] == [1, 2, 0]


def test_most_bad_rows_go_and_good_ones_stay(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    found = quality.classify(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").toPandas()
    assert found[found.quality == 0].kept.mean() <= 0.2 and found[found.quality == 1].kept.mean() >= 0.97


def test_fit_takes_the_gradient_steps_of_a_plain_loop():
    rng = np.random.default_rng(4)
    texts = [rng.choice(quality.FEATURES, rng.integers(1, 30)) for _ in range(25)]
    target = rng.random(25)
    w, speed = np.zeros(quality.FEATURES + 1), np.zeros(quality.FEATURES + 1)
    for _ in range(12):
        step = np.zeros(quality.FEATURES + 1)
        for t, y in zip(texts, target):
            error = y - 1 / (1 + np.exp(-(np.mean([w[f] for f in t]) + w[-1])))
            for f in t:
                step[f] += 20.0 * error / len(t)
            step[-1] += error
        speed = 0.9 * speed + step / len(texts) - 1e-4 * w
        w = w + speed
    found = [np.unique(t, return_counts=True) for t in texts]
    bounds = np.cumsum([0] + [len(f) for f, _ in found])
    assert np.allclose(quality.fit(bounds, np.concatenate([f for f, _ in found]), np.concatenate([c for _, c in found]), target, epochs=12), w)
