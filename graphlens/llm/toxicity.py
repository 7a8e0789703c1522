"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is a fixed list of insults and what is learned beside it: words, and beginnings of words, that
stand in many more toxic than other documents of a bounded sample of labelled rows. Features are densities of lexicon words and of their
weights, their nearness to the second person, capitals, punctuation and obfuscated spellings.
Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from; those of 3 calibrate.

Defined results: null and empty texts have all features 0 and a score as others; repeated rows give
repeated results; without labels of both kinds every score is 0; a null ``doc_id`` isn't held out; an
empty table gives no rows; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import ASCII_LOWER, IN_WORD, sums, word_ranges
from .common import U64, blocks, partitions, range_hashes, staged, text_buffers, texts
from .spotsigs import _hashes

#: Labelled rows that are learned from at most, learned entries of the lexicon at most, toxic documents that
#: an entry needs (and their share), its least log odds.
TRAIN_ROWS, LEXICON, LEAST_DOCUMENTS, LEAST_SHARE, LEAST_ODDS = 24_000, 1_000, 3, 0.01, 2.5
#: Bytes of the beginnings of words, boosting rounds, depth of trees, share of each tree, and bins of a feature.
STEMS, ROUNDS, DEPTH, RATE, BINS = (4, 5, 6), 40, 3, 0.2, 48
THRESHOLD, BLOCK = 0.3, 1_000_000
# Insults of the base lexicon and their weight, second-person words, and digits and signs that stand for letters.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns dumb dumbass imbecile filth vermin bastard bitch asshole".split()
INSULT_WEIGHT = 6.0
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split()
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_SECOND = _hashes(SECOND_PERSON)
_PLAIN = ASCII_LOWER.copy()
for _sign, _letter in STANDS_FOR.items():
    _PLAIN[ord(_sign)] = ord(_letter)
_WORD = IN_WORD.copy()
_WORD[[ord("@"), ord("$")]] = True
_SIGN = np.isin(np.arange(256), [ord(c) for c in STANDS_FOR])
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def _terms(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings (0 where a word is no longer)."""
    plain = _PLAIN[part]
    out = [range_hashes(plain, start, end)]
    for k in STEMS:
        stem = range_hashes(plain, start, np.minimum(end, start + k)) ^ U64(k)
        out.append(np.where(end - start > k, stem, U64(0)))
    return out


def lesson_terms(batches):
    """(term, toxic documents, documents) of each batch of (text, toxic); a term counts once in a document."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        toxic = batch.column(1).to_numpy()
        for first, last in blocks(offsets, BLOCK):
            part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            start, end, firsts = word_ranges(part, at, _WORD)
            if not len(start):
                continue
            text = np.repeat(np.arange(first, last), np.diff(firsts))
            terms = np.concatenate(_terms(part, start, end))
            pairs = np.unique(np.stack([terms, np.tile(text, 1 + len(STEMS)).astype(U64)], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != 0]
            term, back = np.unique(pairs[:, 0], return_inverse=True)
            bad = np.bincount(back, toxic[pairs[:, 1].astype(np.int64)], len(term)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(bad), pa.array(np.bincount(back))], ["term", "bad", "n"])


def features(part: np.ndarray, at: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Dense features of each text of a block; ``terms`` sorted, with their ``weights``."""
    size = np.maximum(np.diff(at), 1)
    start, end, firsts = word_ranges(part, at, _WORD)
    n = np.maximum(np.diff(firsts), 1)
    hashes = _terms(part, start, end)
    weight = np.zeros(len(start))
    if len(terms):
        for h in hashes:
            k = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
            weight = np.maximum(weight, np.where(terms[k] == h, weights[k], 0.0))
    hit = weight > 0
    second = np.isin(hashes[0], _SECOND)
    near = np.zeros(len(start), bool)
    text = np.repeat(np.arange(len(size)), np.diff(firsts))
    for d in range(1, 5):
        if len(start) > d:
            same = text[d:] == text[:-d]
            near[d:] |= second[:-d] & same
            near[:-d] |= second[d:] & same
    signs = np.append(0, np.cumsum(_SIGN[part]))
    letters = np.append(0, np.cumsum(_LETTER[part]))
    disguised = (signs[end] > signs[start]) & (letters[end] > letters[start])
    strongest = np.zeros(len(size))
    np.maximum.at(strongest, text, weight)
    hits = sums(hit, firsts)
    share = lambda c: sums(part == ord(c), at) / size
    columns = [
        hits,
        hits / n,
        sums(weight, firsts) / n,
        strongest,
        sums(weight > 4, firsts),
        sums(hit & near, firsts),
        sums(second, firsts) / n,
        sums(disguised, firsts) / n,
        sums(disguised & hit, firsts),
        sums(_CAPITAL[part], at) / size,
        share("!"),
        share("?"),
        share("*"),
        np.log1p(n),
    ]
    return np.stack(columns, axis=1)


def grow(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> list:
    """Boosted trees for log odds: the start and, for each tree, (feature, limit) by node and values of the leaves."""
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    for k, c in enumerate(x.T):  # rare values too
        cuts[k] = np.unique(np.concatenate([cuts[k], np.quantile(c[c > c.min()], np.linspace(0, 1, 9)[:-1]) - 1e-12])) if (c > c.min()).any() else cuts[k]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    z, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node, splits = np.zeros(len(y), np.int64), []
        for depth in range(DEPTH):
            nodes = 1 << depth
            best = np.full(nodes, 1e-6)
            choice = [(0, np.inf, len(cuts[0]))] * nodes
            for f, own in enumerate(cuts):
                if not len(own):
                    continue
                key, width = node * (len(own) + 1) + binned[:, f], len(own) + 1
                left_g = np.cumsum(np.bincount(key, g, nodes * width).reshape(nodes, width), axis=1)
                left_h = np.cumsum(np.bincount(key, h, nodes * width).reshape(nodes, width), axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                gain[(left_h < 1) | (all_h - left_h < 1)] = 0
                at = gain[:, :-1].argmax(axis=1)
                for k in range(nodes):
                    if gain[k, at[k]] > best[k]:
                        best[k], choice[k] = gain[k, at[k]], (f, float(own[at[k]]), int(at[k]))
            splits.append([(f, limit) for f, limit, _ in choice])
            f, place = np.array([c[0] for c in choice]), np.array([c[2] for c in choice])
            node = 2 * node + (binned[np.arange(len(y)), f[node]] > place[node])
        leaves = 1 << DEPTH
        value = RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        z += value[node]
        trees.append((splits, value))
    return [start, trees]


def log_odds(x: np.ndarray, model: list) -> np.ndarray:
    z = np.full(len(x), model[0])
    for splits, value in model[1]:
        node = np.zeros(len(x), np.int64)
        for level in splits:
            f, limit = np.array([s[0] for s in level]), np.array([s[1] for s in level])
            node = 2 * node + (x[np.arange(len(x)), f[node]] > limit[node])
        z += value[node]
    return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (z, share) of the rising step function nearest to y, by pooling adjacent violators; equal z are one point."""
    kinds, back = np.unique(z, return_inverse=True)
    pools: list[list[float]] = []  # sum, number, least z, greatest z
    for a, total, n in zip(kinds.tolist(), np.bincount(back, y).tolist(), np.bincount(back).tolist()):
        pools.append([total, n, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, high = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = high
    at = np.array([e for p in pools for e in (p[2], p[3])])
    value = np.array([e for p in pools for e in [p[0] / p[1]] * 2])
    return at, value


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)).cast("int")


class Model:
    """Lexicon, trees and calibration; small, and sent to the tasks whole."""

    def __init__(self, terms=None, weights=None, trees=None, points=None):
        self.terms, self.weights, self.trees, self.points = terms, weights, trees, points

    def scores(self, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(at) - 1)
        z = log_odds(features(part, at, self.terms, self.weights), self.trees)
        raw = np.interp(z, *self.points)
        return np.clip(raw + 1e-6 / (1 + np.exp(-z)), 0.0, 1.0)  # keeps the order within a step


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from ``train_rows`` labelled rows at most, the first by a hash of their doc_id; never from fold 2."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(fold(F.col("doc_id")) != 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    picked = F.broadcast(staged(known, "lesson-ids"))  # at most train_rows rows of two numbers
    rows = staged(texts(docs).join(picked, "doc_id").select("text", "toxic", fold(F.col("doc_id")).alias("fold")), "lesson").repartition(partitions(docs.sparkSession))
    taught = rows.filter("fold <> 3")
    totals = taught.agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    if not totals.n or not totals.bad or totals.bad == totals.n:
        return Model()
    counted = taught.select("text", "toxic").mapInArrow(lesson_terms, "term long, bad long, n long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    fine = totals.n - totals.bad
    odds = F.log((F.col("bad") + 0.5) / (totals.bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (fine + 1.0))
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * totals.bad)
    entries = counted.filter(F.col("bad") >= least).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term").limit(LEXICON).collect()
    found = dict.fromkeys(_hashes(INSULTS).tolist(), INSULT_WEIGHT) | {int(np.int64(r.term).view(U64)): r.odds for r in entries}
    terms = np.array(sorted(found), dtype=U64)
    weights = np.array([found[t] for t in sorted(found)])

    def measured(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for first, last in blocks(offsets, BLOCK):
                x = features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], terms, weights)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([lists, *[batch.column(k).slice(first, last - first) for k in (1, 2)]], ["x", "toxic", "fold"])

    table = rows.mapInArrow(measured, "x array<double>, toxic int, fold int").toArrow()  # at most train_rows rows of numbers
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    y, own = table["toxic"].to_numpy().astype(float), table["fold"].to_numpy()
    order = np.lexsort([*x.T, y, own])
    x, y, own = x[order], y[order], own[order]
    trees = grow(x[own != 3], y[own != 3])
    held = own == 3 if (own == 3).sum() >= 50 else np.ones(len(own), bool)
    return Model(terms, weights, trees, isotonic(log_odds(x[held], trees), y[held]))


def _scored(batch: pa.RecordBatch, column, model: Model) -> np.ndarray:
    data, offsets = text_buffers(column)
    out = [model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets, BLOCK)]
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            found = _scored(batch, batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with its columns, whatever their names.

    Null and empty texts are judged as all others and stay null or empty, repeated rows alike; without a model of both kinds all rows stay.
    """
    place = docs.columns.index("text")

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            found = _scored(batch, pc.fill_null(batch.column(place), ""), model)
            yield batch.filter(pa.array(found < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
