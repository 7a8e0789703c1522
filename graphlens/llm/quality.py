"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or not at all on each document. Their votes are counted by pattern
over all documents; expectation-maximisation estimates from the counts how often each labeller is
right and gives each pattern the probability of good. A linear scorer over hashed word and shape
features learns these from a bounded sample and scores all documents; a document's score is the
mean of the scorer's and of the probability by its own votes, so that either can save or fail it.

Most labellers see one kind of junk: they vote bad or not at all, as the lack of one kind says little.
Only common words, variety and the last one, which sees no junk of any kind, vote good.

Defined results: null and empty texts score 0 and aren't kept; repeated rows give repeated results;
an empty table gives no rows; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ASCII_LOWER, sums, word_ranges
from .common import U64, blocks, range_hashes, text_buffers, texts
from .spotsigs import _ANTECEDENTS

#: Rows that the scorer learns from at most, its number of hashed features, and the score from which a document is kept.
TRAIN_ROWS, FEATURES, KEEP = 6_000, 1 << 14, 0.42
BLOCK = 1_000_000
#: Words in a row among which the share of distinct ones is taken; a text's share is the mean of its windows by their words.
WINDOW = 200

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = _LOWER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~"))
_PIPE, _SHOUT, _LINE = (np.arange(256) == ord(c) for c in "|!\n")
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_UPPER], _SHAPE[_LOWER], _SHAPE[_DIGIT] = ord("A"), ord("a"), ord("0")
#: measure, bad from, good up to (or the other way round where bad lies below): fixed limits of the labellers.
LABELLERS = [
    ("symbols", 0.02, 0.004),
    ("pipes", 0.004, 0.0005),
    ("capitals", 0.3, 0.12),
    ("shouts", 0.01, 0.002),
    ("digits", 0.2, 0.05),
    ("repeats", 0.3, 0.1),
    ("common", 0.04, 0.1),
    ("distinct", 0.25, 0.4),
    ("clean", None, None),  # good where all measures above are
]
TWO_SIDED = ["common", "distinct"]


def measures(part: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The labellers' measures of each text of a block."""
    size = np.maximum(np.diff(at), 1)
    start, end, firsts = word_ranges(part, at)
    low = ASCII_LOWER[part]
    words = range_hashes(low, start, end)
    n_words = np.maximum(np.diff(firsts), 1)
    letters = np.maximum(sums(_UPPER[part] | _LOWER[part], at), 1)
    distinct, repeats = np.zeros(len(size)), np.zeros(len(size))
    breaks = np.flatnonzero(_LINE[part])
    for k in range(len(size)):
        own = words[firsts[k] : firsts[k + 1]]
        full = len(own) // WINDOW
        windows = np.sort(own[: full * WINDOW].reshape(full, WINDOW), axis=1)
        kinds = full + (windows[:, 1:] != windows[:, :-1]).sum() + len(np.unique(own[full * WINDOW :]))
        distinct[k] = kinds / max(1, len(own))
        inner = breaks[np.searchsorted(breaks, at[k]) : np.searchsorted(breaks, at[k + 1])]
        a, b = np.append(at[k], inner + 1), np.append(inner, at[k + 1])
        a, b = a[b > a], b[b > a]
        if len(a):
            repeats[k] = 1 - len(np.unique(range_hashes(part[at[k] : at[k + 1]], a - at[k], b - at[k]))) / len(a)
    share = lambda kind: sums(kind[part], at) / size
    return {
        "symbols": share(_SYMBOL),
        "pipes": share(_PIPE),
        "capitals": sums(_UPPER[part], at) / letters,
        "shouts": share(_SHOUT),
        "digits": share(_DIGIT),
        "repeats": repeats,
        "common": sums(np.isin(words, _ANTECEDENTS), firsts) / n_words,
        "distinct": distinct,
    }


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """A number of base 3 for each text; a digit is 0 (no vote), 1 (bad) or 2 (good)."""
    pattern, clean = 0, True
    for name, bad, good in LABELLERS[:-1]:
        sign = 1 if bad > good else -1
        wrong, fine = sign * found[name] >= sign * bad, sign * found[name] <= sign * good
        clean = clean & fine
        pattern = 3 * pattern + np.where(wrong, 1, np.where(fine & (name in TWO_SIDED), 2, 0))
    return 3 * pattern + np.where(clean, 2, 0)


def digits(patterns: np.ndarray) -> np.ndarray:
    """Votes of each labeller (columns) in each pattern (rows)."""
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS) - 1, -1, -1) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each pattern, and each labeller's accuracy, by expectation-maximisation.

    Starts from the share of good among the votes, a bad vote counting three times: labellers rarely call good text bad.
    """
    seen = digits(patterns)
    good, bad = (seen == 2).sum(axis=1), (seen == 1).sum(axis=1)
    p = (good + 1) / (good + 3 * bad + 2)
    accuracy = np.zeros(seen.shape[1])
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        log = np.log(prior)[:, None] + np.zeros((2, len(p)))
        for k in range(seen.shape[1]):
            told = np.array([[w[seen[:, k] == v].sum() + 1 for v in range(3)] for w in weight])
            told /= told.sum(axis=1, keepdims=True)
            log += np.log(told[:, seen[:, k]])
            voted = seen[:, k] > 0
            right = (weight[0] * (seen[:, k] == 1) + weight[1] * (seen[:, k] == 2)).sum()
            accuracy[k] = (right + 1) / ((weight.sum(axis=0) * voted).sum() + 2)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return p, accuracy


def hashed(part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each white-space word and of its shape, in a row, and the bounds of each text."""
    dark = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    start, end, firsts = word_ranges(part, at, dark)
    word = range_hashes(ASCII_LOWER[part], start, end)
    shapes = _SHAPE[part]
    shape = range_hashes(shapes, start, np.minimum(end, start + 3))
    tail = range_hashes(shapes, np.maximum(start, end - 3), end)
    half = U64(FEATURES // 4)
    out = np.stack([word % half, shape % half + half, tail % half + half * U64(2)], axis=1).astype(np.int64)
    return out.ravel(), 3 * firsts


def counted(features: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text in a row, how often each stands there, and the bounds of each text: FEATURES a text at most."""
    found = [np.unique(features[a:b], return_counts=True) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    ends = np.cumsum([0, *[len(f) for f, _ in found]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[f for f, _ in found]]), np.concatenate([none, *[c for _, c in found]]), ends


def fit(bounds: np.ndarray, features: np.ndarray, times: np.ndarray, target: np.ndarray, epochs: int = 80, rate: float = 20.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model of mean feature weights, by gradient steps with momentum."""
    w, speed = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    n = np.maximum(sums(times, bounds), 1)
    row = np.repeat(np.arange(len(n)), np.diff(bounds))
    for _ in range(epochs):
        z = sums(w[features] * times, bounds) / n + w[-1]
        error = target - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        step = np.append(np.bincount(features, (error / n)[row] * times, FEATURES) * rate, error.sum()) / max(1, len(n)) - decay * w
        speed = 0.9 * speed + step
        w += speed
    return w


def _blocks(batch: pa.RecordBatch):
    data, offsets = text_buffers(batch.column("text"))
    for first, last in blocks(offsets, BLOCK):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, weak (probability by its votes), score (0 to 1), kept."""

    def vote(batches):
        for batch in batches:
            for first, last, part, at in _blocks(batch):
                pattern = votes(measures(part, at)) if len(part) else np.zeros(last - first, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(np.asarray(pattern, dtype=np.int32)), pa.array(np.diff(at) > 0)], ["doc_id", "pattern", "real"])

    rows = texts(docs)
    counts = rows.mapInArrow(vote, "doc_id long, pattern int, real boolean").filter("real").groupBy("pattern").count().collect()  # 3 ** labellers at most
    patterns = np.array([r.pattern for r in counts], dtype=np.int64)
    p, _ = estimate(patterns, np.array([r["count"] for r in counts], dtype=np.float64)) if counts else (np.zeros(0), None)
    weak = np.zeros(3 ** len(LABELLERS))
    weak[patterns] = p

    def sampled(batches):
        for batch in batches:
            for first, last, part, at in _blocks(batch):
                if len(part):
                    features, times, bounds = counted(*hashed(part, at))
                    target = weak[votes(measures(part, at))]
                    lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (features, times)]
                    yield pa.RecordBatch.from_arrays([batch.column("order").slice(first, last - first), *lists, pa.array(target)], ["order", "features", "times", "target"])

    total = sum(r["count"] for r in counts)
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    some = rows.filter(F.length("text") > 0).filter(order < int((1 << 30) * min(1.0, 1.5 * train_rows / max(1, total)))).select("text", order.alias("order"))
    taught = some.mapInArrow(sampled, "order long, features array<int>, times array<int>, target double").orderBy("order").limit(train_rows)
    lesson = taught.select("features", "times", "target").toArrow()  # train_rows rows of FEATURES numbers at most
    lists, times = lesson["features"].combine_chunks(), lesson["times"].combine_chunks()
    weights = fit(lists.offsets.to_numpy(), lists.values.to_numpy(), times.values.to_numpy(), lesson["target"].to_numpy()) if len(lesson) else np.zeros(FEATURES + 1)

    def score(batches):
        for batch in batches:
            for first, last, part, at in _blocks(batch):
                if len(part):
                    features, bounds = hashed(part, at)
                    z = sums(weights[features], bounds) / np.maximum(np.diff(bounds), 1) + weights[-1]
                    guess = np.where(np.diff(at) > 0, weak[votes(measures(part, at))], 0.0)
                    out = np.where(np.diff(at) > 0, (1 / (1 + np.exp(-np.clip(z, -30, 30))) + guess) / 2, 0.0)
                else:
                    out = guess = np.zeros(last - first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(guess), pa.array(out), pa.array(out >= KEEP)], ["doc_id", "weak", "score", "kept"])

    return rows.mapInArrow(score, "doc_id long, weak double, score double, kept boolean")
