"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes ratios.

A text's features are the hashed character n-grams, word ends marked, of its distinct
words (A-Z lower-cased). Each feature is scaled by its naive Bayes log-count ratio
between toxic and other training texts, and logistic regression learns weights on
the scaled features (Wang and Manning, 2012). Labels, language, source and id are
never inputs.

Fitting uses at most ``SAMPLE_PER_CLASS`` labelled rows of each class, the first by a
hash of the id; everything else covers all rows. Scoring is one pass without shuffle,
with the weights (``BUCKETS`` numbers) sent along.

A text without words, null included, gets the score of the intercept. Rows are kept
one for one. Null labels do not train; without rows of both classes every score is the
share of toxic rows among those given. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.bytehash import Words, mix
from folio.llm.tokenizing import text_groups

U64 = np.uint64
BUCKETS = 1 << 19
GRAMS = (3, 4, 5)
#: Labelled rows of each class that a fit uses at most.
SAMPLE_PER_CLASS = 4000
#: Training texts that a feature must be in.
LEAST_TEXTS = 4
ROUNDS = 120
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 8, dtype=np.uint64) * U64(2) + U64(1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, and where each text's begin (a number may recur)."""
    words = Words(column, lower=True)
    doc = np.repeat(np.arange(len(words.of) - 1), words.counts())
    # the first of each distinct word of a text
    _, first = np.unique(mix(words.hashes ^ mix(doc.astype(U64) + U64(1))), return_index=True)
    first.sort()
    data = words.data
    lead = (data & 0xC0) != 0x80
    place = np.cumsum(lead) - 1
    at = np.flatnonzero(lead)
    char = data[at].astype(U64)
    char[(char >= 65) & (char <= 90)] += U64(32)
    for k in range(1, 4):  # a character's value: its bytes in a row
        follows = at + k < len(data)
        more = np.zeros(len(at), bool)
        more[follows] = ~lead[at[follows] + k]
        if not more.any():
            break
        more &= np.concatenate([at[1:], [len(data)]]) > at + k
        char[more] = char[more] << U64(8) | data[at[more] + k].astype(U64)
    start = place[words.starts[first]]
    size = place[words.ends[first] - 1] - start + 1
    # words one after another, each between two marks of value 1
    padded = size + 2
    end = np.cumsum(padded)
    begin = end - padded
    row = np.ones(int(end[-1]) if len(end) else 0, U64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    row[np.repeat(begin + 1, size) + inner] = char[np.repeat(start, size) + inner]
    left = np.repeat(end, padded) - np.arange(len(row))  # characters to the end of the word
    of_doc = np.repeat(doc[first], padded)
    parts, docs = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        total = np.zeros(len(at), U64)
        for k in range(n):
            total += row[at + k] * _FACTORS[k]
        parts.append((mix(total + U64(n)) % U64(BUCKETS)).astype(np.int32))
        docs.append(of_doc[at])
    value, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return value[order], np.searchsorted(doc[order], np.arange(len(words.of)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, value: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Probability of toxic; a feature counts once in a text, as in training."""
        last, totals = np.empty(BUCKETS, np.int32), np.empty(len(of) - 1)
        for k, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
            own, number = value[a:b], np.arange(b - a, dtype=np.int32)
            last[own] = number
            totals[k] = self.weights[own[last[own] == number]].sum(dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(totals + self.intercept, -30, 30)))


def held_out(doc_id: str = "doc_id") -> Column:
    """A row without an id counts as held out: it can't be told from the labelled ones."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def settled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of ids that are not held out and have one label; ids with both are left out."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out())
    sums = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    return sums.where("toxic = _most").drop("_most")


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most SAMPLE_PER_CLASS labelled texts of each class that is not held out."""
    known = settled(labels)
    order = F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string")))
    some = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(SAMPLE_PER_CLASS) for k in (0, 1)]
    ids = some[0].union(some[1])
    # at most 2 * SAMPLE_PER_CLASS ids, so every executor can hold them; of rows that share an id, one is learnt from
    found = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(rows: list[tuple[int, np.ndarray]], prior: float) -> Model:
    """Weights from (label, distinct feature numbers); prior: share of toxic rows."""
    y = np.array([k for k, _ in rows], float)
    odds = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), float(odds))
    toxic = np.bincount(np.concatenate([f for k, f in rows if k]), minlength=BUCKETS)
    other = np.bincount(np.concatenate([f for k, f in rows if not k]), minlength=BUCKETS)
    n1, n0 = y.sum(), (1 - y).sum()
    ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((other + 1) / (n0 + 2))
    ratio[toxic + other < LEAST_TEXTS] = 0
    kept = [f[np.abs(ratio[f]) > 0.25] for _, f in rows]
    value = np.concatenate(kept)
    of = np.concatenate([[0], np.cumsum([len(f) for f in kept])])
    row = np.repeat(np.arange(len(kept)), np.diff(of))
    scale = ratio[value]
    weight, bias = np.zeros(BUCKETS), 0.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, weight[value] * scale, len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        grad = np.bincount(value, error[row] * scale, BUCKETS) + 2e-5 * weight
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.99 * vb + 0.01 * error.sum() ** 2
        rate = 0.05 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        weight -= rate * m / (np.sqrt(v) + 1e-7)
        bias -= rate * mb / (np.sqrt(vb) + 1e-7)
    return Model((weight * ratio).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample; its features, not its texts, reach the driver."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_groups(whole, "text"):
                value, of = features(batch.column("text"))
                own = [np.unique(value[a:b]).tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.binary())], ["toxic", "features"])

    shares = settled(labels).agg(F.avg("toxic")).first()[0]
    found = training_sample(docs, labels).select("text", F.col("toxic").cast("int")).mapInArrow(extract, "toxic int, features binary").toArrow()
    rows = [(k, np.frombuffer(f, np.int32)) for k, f in zip(found.column("toxic").to_pylist(), found.column("features").to_pylist(), strict=True)]
    return fit(rows, shares or 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for whole in batches:
            for batch in text_groups(whole, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(*features(batch.column("text"))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
