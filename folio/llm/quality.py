"""Quality rules as weak supervision: votes, accuracies by expectation-maximisation, posteriors.

Each rule votes good (1), bad (-1) or abstains (0) from a document's counts. Nothing
is labelled: expectation-maximisation over the counts of vote patterns estimates how
often each rule votes each way on good and on bad documents, and the posterior
probability of good decides instead of all rules having to pass. The patterns are
at most 3 ** rules whatever the input, so only they reach the driver.

A document without words, null text included, fails the base test and is rejected.
Equal texts get equal results; rows are kept one for one; extra columns are ignored
by ``quality`` and kept by ``keep_good``. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from folio.llm.bytehash import IS_SPACE, Words, mix, text_bytes
from folio.llm.shared import materialize
from folio.llm.tokenizing import text_groups

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(x) for x in "#*$%&|<>"]] = True
_SPACES = " \t\n\x0b\x0c\r"
U64 = np.uint64
WINDOW = 8

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_wide", "n_marks", "n_symbol_ends"]
#: Before the names of the counts.
PREFIX = "_count_"


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _lines(texts: list[str | None]) -> tuple[list[int], list[int]]:
    """Lines with a word, and those equal to an earlier one, of each text."""
    lines, repeats = [], []
    for text in texts:
        own = [x for x in (text or "").split("\n") if x.strip(_SPACES)]
        lines.append(len(own))
        repeats.append(len(own) - len(set(own)))
    return lines, repeats


def repeated_words(words: Words, n: int = WINDOW) -> np.ndarray:
    """Per text, how many words lie in windows of n words found twice or more in it."""
    hashes, of = words.windows(n)
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    # equal windows of one text, and only those, get equal keys
    _, which, count = np.unique(mix(hashes ^ mix(doc.astype(U64) + U64(1))), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[which] > 1)
    first = words.of[:-1][doc[twice]] + twice - of[:-1][doc[twice]]
    cover = np.zeros(len(words.hashes) + 1, np.int32)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + n, -1)
    return _per_text(np.cumsum(cover[:-1]) > 0, words.of)


def _counts(column: pa.Array) -> list[pa.Array]:
    words = Words(column)
    offsets, data = text_bytes(column)
    lines, repeats = _lines(column.to_pylist())
    cols = [
        words.counts(),
        _per_text(~IS_SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        _per_text(_SYMBOL[data], offsets),
        repeats,
        repeated_words(words),
        lines,
        _per_text((data >= 65) & (data <= 90), offsets),
        _per_text((data >= 97) & (data <= 122), offsets),
        _per_text(data >= 0xC0, offsets),
        _per_text((data == 33) | (data == 63), offsets),
        _per_text(_SYMBOL[data[words.ends - 1]], words.of),
    ]
    return [pa.array(x, pa.int64()) for x in cols]


def with_features(docs: DataFrame) -> DataFrame:
    """(doc, counts of its whole text under ``PREFIX``); ``doc`` holds the row as it was."""
    names = ["doc", *(PREFIX + x for x in FEATURES)]
    packed = docs.select(F.struct("*").alias("doc"))
    schema = StructType([*packed.schema.fields, *(StructField(PREFIX + x, LongType()) for x in FEATURES)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            doc = whole.column("doc")
            both = pa.RecordBatch.from_arrays([doc, doc.field("text")], ["doc", "text"])
            for batch in text_groups(both, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("doc"), *_counts(batch.column("text"))], names)

    return packed.mapInArrow(count, schema)


def count(name: str) -> Column:
    return F.col(PREFIX + name)


def base_failed() -> Column:
    return (count("n_words") < 20) | (100 * count("n_repeat_words") > 30 * count("n_words"))


@dataclass(frozen=True)
class VoteRule:
    """Bad above (or below, if ``high_is_good``) ``bad``, good on the other side of ``good``, else no vote."""

    name: str
    value: Column
    good: float
    bad: float
    high_is_good: bool = False

    def vote(self) -> Column:
        if self.high_is_good:
            return F.when(self.value < self.bad, -1).when(self.value >= self.good, 1).otherwise(0)
        return F.when(self.value > self.bad, -1).when(self.value <= self.good, 1).otherwise(0)


def vote_rules() -> list[VoteRule]:
    """The production rules; a ratio without a denominator is null and gives no vote."""
    words, letters = count("n_words"), count("n_upper") + count("n_lower")

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    mean_word = share(count("word_chars"), words)
    return [
        VoteRule("length", words, 40, 20, high_is_good=True),
        VoteRule("symbols", share(count("n_symbols"), words), 0.05, 0.3),
        VoteRule("repeats", share(count("n_repeat_words"), words), 0.1, 0.3),
        VoteRule("lines", F.when(count("n_lines") >= 3, count("n_dup_lines") / count("n_lines")), 0.1, 0.3),
        VoteRule("shouting", share(count("n_upper"), letters), 0.15, 0.4),
        VoteRule("marks", share(count("n_marks"), words), 0.05, 0.3),
        VoteRule("letters", share(letters + count("n_wide"), count("word_chars")), 0.93, 0.84, high_is_good=True),
        VoteRule("symbol_ends", share(count("n_symbol_ends"), words), 0.05, 0.3),
        VoteRule("word_size", F.abs(mean_word - 6), 2.5, 4.5),
    ]


@dataclass(frozen=True)
class LabelModel:
    """Prior of good and log-likelihoods of each vote, by rule."""

    prior: float
    good: list[dict[int, float]]
    bad: list[dict[int, float]]

    def log_odds(self, votes: list[Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, good, bad in zip(votes, self.good, self.bad, strict=True):
            gain = F.when(vote == 1, good[1] - bad[1]).when(vote == -1, good[-1] - bad[-1]).otherwise(good[0] - bad[0])
            total = total + gain
        return total


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 100, smoothing: float = 1.0) -> LabelModel:
    """Expectation-maximisation over (votes, count) pairs, from a start that believes every rule.

    Each rule looks for one kind of flaw, so the first guess is 0.95 good without a bad
    vote and 0.1 with one; the accuracies follow from it, and it from them in turn.
    A rule whose bad votes fall on documents that the others praise loses its weight.
    """
    kinds = (-1, 0, 1)
    votes = np.array([p for p, _ in patterns], int).reshape(len(patterns), rules)
    count = np.array([n for _, n in patterns], float)
    is_kind = np.stack([votes == k for k in kinds], axis=2)
    p, prior = np.where((votes == -1).any(1), 0.1, 0.95), 0.5
    for _ in range(rounds):
        new = float(((p * count).sum() + smoothing) / (count.sum() + 2 * smoothing))
        g = (is_kind * (p * count)[:, None, None]).sum(0) + smoothing
        b = (is_kind * ((1 - p) * count)[:, None, None]).sum(0) + smoothing
        good, bad = g / g.sum(1, keepdims=True), b / b.sum(1, keepdims=True)
        done, prior = abs(new - prior) < 1e-10, min(max(new, 1e-6), 1 - 1e-6)
        if done:
            break
        odds = math.log(prior / (1 - prior)) + (is_kind * (np.log(good) - np.log(bad))).sum((1, 2))
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    as_logs = lambda m: [{k: float(math.log(x)) for k, x in zip(kinds, row, strict=True)} for row in m]
    return LabelModel(prior, as_logs(good), as_logs(bad))


def fit(counted: DataFrame, rules: list[VoteRule]) -> LabelModel:
    """The label model of all documents, from counts of their vote patterns."""
    votes = counted.select(*(r.vote().alias(r.name) for r in rules))
    patterns = votes.groupBy(*(r.name for r in rules)).count().collect()  # at most 3 ** rules rows
    return fit_label_model([(tuple(x[:-1]), x[-1]) for x in patterns], len(rules))


def p_good(model: LabelModel, rules: list[VoteRule]) -> Column:
    return 1 / (1 + F.exp(-model.log_odds([r.vote() for r in rules])))


def quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, p_good and kept of every document."""
    counted = with_features(docs.select(F.col("doc_id").cast("long"), "text"))
    counted = materialize(counted.select(F.col("doc.doc_id").alias("doc_id"), *(PREFIX + x for x in FEATURES)), "quality-features")
    rules = vote_rules()
    judged = counted.withColumn("p_good", p_good(fit(counted, rules), rules)).withColumn("base_failed", base_failed())
    return judged.select("doc_id", *(count(x).alias(x) for x in FEATURES), "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= least)).alias("kept"))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that are kept, as they are.

    Texts are counted twice, once for the model and once for the verdict, which is
    cheaper than a shuffle of them.
    """
    rules = vote_rules()
    counted = with_features(docs)
    model = fit(with_features(docs.select("text")), rules)
    return counted.where(~base_failed() & (p_good(model, rules) >= least)).select("doc.*")
