"""Stupid-backoff scores of documents under the n-gram counts of all of them.

The score of a word after the words before it is the relative frequency of the
longest n-gram that the corpus has, times 0.4 for each word dropped. Counts are
tables partitioned by hash: blocks of documents send their distinct n-grams with
counts, buckets of the hash range add them up, the totals are joined back to the
blocks' exploded n-grams, and each document's log scores are summed.

With ``leave_out`` (the default) a document's own n-grams are taken from the counts
first, so it is scored by the rest of the corpus, and backing off is real.

An n-gram of three words or more can only be counted elsewhere if both of the
(n - 1)-grams in it are. So counting goes by length: words and pairs first, then, length
by length, those n-grams whose parts have passed. This leaves out no n-gram that any
score needs, and it is what keeps the tables small, as most long n-grams are unique.

Words are lower-cased (A-Z) runs of non-spaces. A word that the rest of the corpus
lacks counts as seen once. A document without words, null text included, has score 0
and no mean. Rows are kept one for one and equal ids are separate documents; copies
of a text support each other. Extra columns are ignored, an empty table gives none.
``docs`` must be a written table, as its rows are dealt by place. N-grams are known
by 64-bit hashes: two of a corpus of 10**9 share one with a chance of 3 in 100, which
changes the counts of those two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.blockcounts import U64, corpus_size, in_blocks, joined_totals, totals, with_totals
from folio.llm.bytehash import Words

#: Longest n-gram.
ORDER = 3
BACKOFF = 0.4
SCORE_SCHEMA = "doc_id long, n_tokens long, n_backoff long, log_score double"


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of unsigned 64-bit keys in ascending order, equal ones as they come, and the keys there.

    The keys are sorted with their places in the low bits, which takes a fraction of
    the time of sorting places by key; keys that agree in all bits above are put in
    order afterwards. Of hashes, a block has hardly any.
    """
    low = U64((1 << len(keys).bit_length()) - 1)
    packed = keys & ~low
    packed |= np.arange(len(keys), dtype=U64)
    packed.sort()
    places = (packed & low).astype(np.int64)
    there = keys[places]
    for head in np.unique(packed[1:][there[1:] < there[:-1]] & ~low):
        a, b = np.searchsorted(packed, head), np.searchsorted(packed, head | low, "right")
        places[a:b] = places[a:b][np.argsort(there[a:b], kind="stable")]
        there[a:b] = keys[places[a:b]]
    return places, there


def _lengths(first: np.ndarray) -> np.ndarray:
    """Lengths of the runs that begin where ``first`` is set."""
    return np.diff(np.flatnonzero(first), append=len(first))


class Grams:
    """The n-grams of a block's documents, counted length by length."""

    def __init__(self, table: pa.Table, leave_out: bool):
        self.words, self.leave_out = Words(table.column("text"), lower=True), leave_out
        self.counts: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []

    def candidates(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all n-grams, where each text's begin, and which may be counted elsewhere."""
        hashes, of = self.words.windows(n)
        if n <= 2:
            return hashes, of, np.ones(len(hashes), bool)
        shorter, start = self.counts[n - 2], self.starts[n - 2]
        first = np.repeat(start[:-1] - of[:-1], np.diff(of)) + np.arange(of[-1])
        return hashes, of, (shorter[first] > 0) & (shorter[first + 1] > 0)

    def take(self, total: np.ndarray, *found: tuple) -> None:
        """Counts of all n-grams of one or more lengths, as ``candidates`` found them.

        ``total`` has the counts of the distinct candidates of all these lengths, in
        order of their hashes. One sort lines both up: n-grams with equal hashes lie
        side by side, and those of one document among them too.
        """
        at = [np.flatnonzero(may) for _, _, may in found]
        places, keys = in_order(np.concatenate([hashes[k] for (hashes, _, _), k in zip(found, at, strict=True)]))
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        there = np.repeat(total, _lengths(first))
        if self.leave_out:
            doc = np.concatenate([np.repeat(np.arange(len(of) - 1), np.diff(of))[k] for (_, of, _), k in zip(found, at, strict=True)])[places]
            # the same n-gram in the same document
            first[1:] |= doc[1:] != doc[:-1]
            times = _lengths(first)
            there -= np.repeat(times, times)
        some = np.empty(len(there), np.int64)
        some[places] = there
        ends = np.cumsum([len(k) for k in at])
        for (hashes, of, _), k, end in zip(found, at, ends.tolist(), strict=True):
            count = np.zeros(len(hashes), np.int64)
            count[k] = some[end - len(k) : end]
            self.counts.append(count)
            self.starts.append(of)


def _level(answers: pa.Table, level: int) -> pa.Table:
    return answers.filter(pa.array(answers.column("level").to_numpy() == level))


def _known(table: pa.Table, answers: pa.Table, upto: int, leave_out: bool) -> Grams:
    """The block's n-grams with counts for n = 1..upto."""
    grams = Grams(table, leave_out)
    grams.take(joined_totals(_level(answers, 2)), *(grams.candidates(n) for n in range(1, min(upto, 2) + 1)))
    for n in range(3, upto + 1):
        grams.take(joined_totals(_level(answers, n)), grams.candidates(n))
    return grams


def score(docs: DataFrame, order: int = ORDER, leave_out: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_backoff (words scored by less than the longest n-gram), log_score."""
    size = corpus_size(docs)
    blocks = in_blocks(docs.select(F.col("doc_id").cast("long"), "text"), size)
    n_all = size.words

    def short_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        words = Words(table.column("text"), lower=True)
        return np.unique(np.concatenate([words.windows(n)[0] for n in range(1, min(order, 2) + 1)]), return_counts=True)

    def longer_keys(n: int):
        def keys(table: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            hashes, _, may = _known(table, answers, n - 1, leave_out).candidates(n)
            return np.unique(hashes[may], return_counts=True)

        return keys

    known = totals(blocks, short_keys, size).withColumn("level", F.lit(2))
    for n in range(3, order + 1):
        known = known.union(totals(blocks, longer_keys(n), size, known).withColumn("level", F.lit(n)))

    def use(table: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _known(table, answers, order, leave_out)
        of, counts, starts = grams.words.of, grams.counts, grams.starts
        n_words = np.diff(of)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        others = (n_all - n_words if leave_out else np.full(len(n_words), n_all)).clip(1)
        place_in = np.arange(len(doc)) - of[:-1][doc]
        value = np.maximum(counts[0], 1) / others[doc]
        used = np.zeros(len(doc), np.int64)
        possible = np.minimum(place_in, order - 1)  # words before that an n-gram can hold
        for n in range(2, order + 1):
            ends = np.flatnonzero(place_in >= n - 1)
            d, k = doc[ends], place_in[ends] - (n - 1)
            seen = counts[n - 1][starts[n - 1][:-1][d] + k]
            before = counts[n - 2][starts[n - 2][:-1][d] + k]
            hit = seen > 0
            value[ends[hit]] = seen[hit] / before[hit]
            used[ends[hit]] = n - 1
        missing = possible - used
        sums = np.bincount(doc, np.log(value) + missing * np.log(BACKOFF), len(n_words))
        late = np.bincount(doc, missing > 0, len(n_words)).astype(np.int64)
        return pa.table([table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(late), pa.array(sums, pa.float64())], ["doc_id", "n_tokens", "n_backoff", "log_score"])

    return with_totals(blocks, known, use, SCORE_SCHEMA)
