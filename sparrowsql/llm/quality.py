"""Quality classifier by weak labels.

Eight overlapping heuristic labellers vote good, bad or nothing on each text,
from counts over the whole text. All documents' votes are counted by pattern
(at most 3^8 patterns, whatever the input's size), and expectation-maximisation
over those counts estimates each labeller's rates for both classes and each
pattern's posterior. A linear scorer on hashed features is then trained on the
posteriors of at most SAMPLE documents (a documented bound: only this fit uses a
sample) and scores every document. The sample holds the SAMPLE distinct texts of
least hash in the whole table: every task passes on its least hashes, so however
the rows are dealt out it is the same, and a text on many rows counts once.

Features are runs of one to four character classes (lower case, upper case,
digits, space, line ends, each mark itself), hashed into DIMENSIONS buckets,
and the labellers' own ratios.

Null and empty texts and texts without any word have no votes and are rejected
with a score of 0, as they hold nothing. A score of exactly KEEP stays. A text of
any length is read whole, in memory in proportion to it. A repeated row gets a
repeated result. An empty table gives an empty result. Columns of other names
don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowsql.llm.common import materialize, mix, slices, utf8, words

#: At most so many documents train the scorer.
SAMPLE = 2_000
DIMENSIONS = 2_048
#: Share of good documents that the estimate starts from.
PRIOR = 0.8
KEEP = 0.5
#: Rates of the vote bad that the estimate starts from, for bad and for good texts, and how many documents they stand for.
BELIEF, WEIGHT = (0.25, 0.01), 50

# name, (bad above or below, threshold), (good above or below, threshold) of a ratio; between them no vote.
LABELLERS = [
    ("symbols", "high", 0.08, 0.03),  # marks other than . , ; : ' " ! ? - ( ) | to all bytes
    ("capitals", "high", 0.50, 0.15),  # upper case to ASCII letters
    ("bars", "high", 0.25, 0.02),  # | to words
    ("exclaims", "high", 0.30, 0.05),  # ! to words
    ("stutter", "high", 0.20, 0.02),  # words equal to the word before
    ("variety", "low", 0.25, 0.40),  # distinct words to the square-root-corrected count of words
    ("lines", "high", 0.40, 0.05),  # words of lines that stood before in the text
    ("marks", "high", 0.70, 0.45),  # all marks to words
]
RATIOS = len(LABELLERS)

_CLASS = np.zeros(256, np.uint64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if "a" <= _c <= "z" or _b >= 128 else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t" else 5 if _c in "\r\n" else _b
_LETTER = np.isin(_CLASS, [1, 2])
_UPPER = _CLASS == 2
_MARK = (_CLASS > 5)
_ODD = _MARK & ~np.isin(np.arange(256), [ord(c) for c in ".,;:'\"!?-()|"])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def ratios(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labellers' ratios of each text, and its count of words."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    starts, _, hashes, first = words(data, offsets)
    count = np.diff(first).astype(float)
    some = np.maximum(count, 1)
    text = np.repeat(np.arange(n), np.diff(first))
    out = np.zeros((n, RATIOS))
    out[:, 0] = _per_text(_ODD[data], offsets) / size
    out[:, 1] = _per_text(_UPPER[data], offsets) / np.maximum(_per_text(_LETTER[data] & (data < 128), offsets), 1)
    out[:, 2] = _per_text(data == ord("|"), offsets) / some
    out[:, 3] = _per_text(data == ord("!"), offsets) / some
    if len(hashes):
        same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])])
        out[:, 4] = np.bincount(text, same, n) / some
        keys = mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        distinct = np.bincount(text[np.unique(keys, return_index=True)[1]], minlength=n)
        out[:, 5] = distinct / (some / np.maximum(1, np.sqrt(some / 200)))
        line = np.searchsorted(np.flatnonzero(data == 10), starts)
        edge = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])]))
        held = np.diff(np.concatenate([edge, [len(hashes)]]))
        place = np.arange(len(hashes)) - np.repeat(edge, held)
        sums = np.add.reduceat(mix(hashes + place.astype(np.uint64)), edge)
        line_keys = mix(sums + text[edge].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        again = np.ones(len(edge), bool)
        again[np.unique(line_keys, return_index=True)[1]] = False
        out[:, 6] = np.bincount(text[edge], again * held, n) / some
    out[:, 7] = _per_text(_MARK[data], offsets) / some
    return out, count


def votes(ratio: np.ndarray, count: np.ndarray) -> np.ndarray:
    """1 for good, -1 for bad, 0 for no vote; a text without words gets none."""
    out = np.zeros(ratio.shape, np.int8)
    for j, (_, side, bad, good) in enumerate(LABELLERS):
        r = ratio[:, j] if side == "high" else -ratio[:, j]
        bad, good = (bad, good) if side == "high" else (-bad, -good)
        out[:, j] = np.where(r > bad, -1, np.where(r < good, 1, 0))
    out[count < 1] = 0
    out[count < 20, 4:7] = 0  # too few words to tell repetition
    out[np.ix_(count < 5, [1, 7])] = 0
    return out


def pattern(vote: np.ndarray) -> np.ndarray:
    """Votes as one number, base 3."""
    return (vote.astype(np.int64) + 1) @ (3 ** np.arange(RATIOS))


def unpattern(number: np.ndarray) -> np.ndarray:
    return (number[:, None] // 3 ** np.arange(RATIOS)) % 3 - 1


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Each pattern's posterior of good, rates[class, labeller] of the vote bad among votes given, and the share of good.

    No vote is a missing value: a labeller abstains for want of words, which
    tells nothing of the class. The rates and the share lean on BELIEF and PRIOR
    with the weight of WEIGHT documents, whatever the corpus's size, so that a
    labeller without votes has a rate; all else is estimated.
    """
    vote = unpattern(patterns)
    bad, given, total = vote == -1, vote != 0, counts.sum()
    good = np.where(bad.any(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = (good @ counts + PRIOR * WEIGHT) / (total + WEIGHT)
        share = np.array([1 - good, good]) * counts
        rates = (share @ bad + WEIGHT * np.array(BELIEF)[:, None]) / (share @ given + WEIGHT)
        told = bad @ np.log(rates).T + (given & ~bad) @ np.log1p(-rates).T
        fresh = 1 / (1 + np.exp(np.clip(told[:, 0] - told[:, 1] + np.log((1 - prior) / prior), -50, 50)))
        done = np.abs(fresh - good).max(initial=0) < 1e-6
        good = fresh
        if done:
            break
    return good, rates, float(prior)


def features(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Hashed features of each text, of unit length, with the ratios and a constant behind."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS + RATIOS + 1), np.float32)
    shape = _CLASS[data]
    for i in range(n):
        one = shape[offsets[i] : offsets[i + 1]]
        if not len(one):
            continue
        gram = one.copy()
        row = np.bincount((mix(gram) % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS).astype(np.float32)
        for k in range(1, 4):
            if len(one) > k:
                gram = gram[:-1] * np.uint64(257) + one[k:]
                row += np.bincount((mix(gram + np.uint64(k << 40)) % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS)
        row = np.sqrt(row)
        out[i, :DIMENSIONS] = row / np.sqrt(row @ row)
    out[:, DIMENSIONS:-1] = np.minimum(ratio, 2.0)
    out[:, -1] = 1.0
    return out


def train(x: np.ndarray, target: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Weights of a logistic scorer on soft targets: full-batch descent with momentum and decay."""
    x, target = x.astype(np.float32), target.astype(np.float32)
    weights, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = (p - target) @ x / max(len(x), 1) + 1e-4 * weights
        speed = 0.9 * speed - 1.0 * slope
        weights = weights + speed
    return weights


def _each(batches, columns: int):
    """(ids, text bytes, offsets) of runs of rows; the text column stands last."""
    for batch in batches:
        data, offsets = utf8(batch.column(columns - 1))
        for a, b in slices(offsets):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


class Model:
    """What fit() learned: the scorer's weights and the labellers' rates."""

    def __init__(self, weights: np.ndarray, rates: np.ndarray, posterior: dict[int, float]):
        self.weights, self.rates, self.posterior = weights, rates, posterior


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Count all votes, estimate, and train on at most sample documents; None for an empty table."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("h"), text.alias("text"))

    def vote(batches):
        """A task's counts by pattern, and the least hashes of its distinct texts."""
        seen, least = np.zeros(3**RATIOS, np.int64), np.zeros(0, np.int64)
        for part, data, offsets in _each(batches, 2):
            seen += np.bincount(pattern(votes(*ratios(data, offsets))), minlength=len(seen))
            least = np.unique(np.concatenate([least, part.column(0).to_numpy()]))[:sample]
        found = np.flatnonzero(seen)
        columns = [pa.array(found), pa.nulls(len(found), pa.int64()), pa.array(seen[found])]
        yield pa.RecordBatch.from_arrays(columns, ["pattern", "h", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(least), pa.int64()), pa.array(least), pa.nulls(len(least), pa.int64())], ["pattern", "h", "n"])

    told = materialize(rows.mapInArrow(vote, "pattern long, h long, n long"), "votes")
    counted = told.where("h IS NULL").groupBy("pattern").agg(F.sum("n").alias("n"))
    found = sorted((r.pattern, r.n) for r in counted.collect())  # 3^8 rows at most
    if not found:
        return None
    patterns, counts = np.array([p for p, _ in found]), np.array([n for _, n in found], float)
    good, rates, _ = expectation_maximisation(patterns, counts)
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))

    chosen = told.where("h IS NOT NULL").select("h").distinct().orderBy("h").limit(sample)  # the documented bound
    most = chosen.agg(F.max("h")).first()[0]

    def describe(batches):
        done: set[int] = set()  # hashes of the sample only
        for part, data, offsets in _each(batches, 2):
            hashes = part.column(0).to_pylist()
            for i, h in enumerate(hashes):
                if h not in done:  # a text that stands on many rows counts once
                    done.add(h)
                    own, size = data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]])
                    ratio, count = ratios(own, size)
                    x = features(own, size, ratio).astype(np.float16)
                    columns = [pa.array([h]), pa.array(pattern(votes(ratio, count))), pa.array([x.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["h", "pattern", "x"])

    described = rows.where(F.col("h") <= most).mapInArrow(describe, "h long, pattern long, x binary")
    got = described.groupBy("h").agg(F.min("pattern").alias("pattern"), F.min("x").alias("x")).orderBy("h").collect()  # sample rows at most
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).reshape(len(got), DIMENSIONS + RATIOS + 1)
    target = np.array([posterior[r.pattern] for r in got])
    return Model(train(x, target), rates, posterior)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, posterior (of its votes), score, keep."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for rows, data, offsets in _each(batches, 2):
            ratio, count = ratios(data, offsets)
            p = 1 / (1 + np.exp(-np.clip(features(data, offsets, ratio).astype(np.float64) @ model.weights, -30, 30)))
            p[count < 1] = 0.0
            post = [model.posterior.get(int(k), 0.5) for k in pattern(votes(ratio, count))]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(post, pa.float64()), pa.array(p), pa.array(p >= KEEP)], ["id", "posterior", "score", "keep"]
            )

    out = rows.mapInArrow(run, f"id {kind}, posterior double, score double, keep boolean")
    return out.withColumnRenamed("id", id_col)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit(docs, text_col, sample), id_col, text_col)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier keeps, with all their columns, in one pass over the rows."""
    model = fit(docs, text_col, sample)
    if model is None:
        return docs
    place, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(place))
            for a, b in slices(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ratio, count = ratios(part, own)
                p = features(part, own, ratio).astype(np.float64) @ model.weights
                yield batch.slice(a, b - a).filter(pa.array((p >= 0) & (count > 0)))

    return docs.mapInArrow(run, schema)
