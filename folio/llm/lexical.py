"""Ranked lexical search over a two-level quantised index.

The index has one row per segment, some megabytes of neighbouring documents, written in
place: texts are never shuffled. A segment holds the sorted hashes of its terms and, for
each, a posting list with the local document numbers and two levels of impact. The first
level is one byte: what the term adds per unit of its weight, rounded upward to steps of
``STEP``. The second is the exact number of occurrences.

A search takes a block of items at a time to all segments. Bytes times weights, summed per
document, are upper bounds; the bytes less one, lower bounds. A task keeps each item's
k-th largest lower bound so far, rescores in whole numbers every document whose upper
bound reaches it, and returns its k best; the best of all tasks are the answer. The bound
of a task is never above that of all documents, so nothing of the answer is lost, and a
task returns k rows an item however many documents tie.

A term's score is ``weight * part``: ``weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))``,
``part = (1000000000 tf) div (1000 tf + 8 m)`` with ``m = 10 + (90 n N) div L``.

Terms are told apart by 64-bit hashes. Null and empty texts have no terms: such documents
aren't counted in N, and such items get no rows. Texts are taken whole; a very long one is
a segment of its own. Repeated documents are documents of their own, also under one id;
the terms of rows that share an item id are one item's. Null document ids come last among
equal scores. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.bytehash import Words, text_bytes
from folio.llm.memory import release
from folio.llm.shared import materialize, scratch_path
from folio.llm.tokenizing import text_groups

#: What one unit of the first level stands for; a part is below 1,000,000, so a byte holds it.
STEP = 3922
#: Text of a segment, on average, and its documents at most (local numbers have 16 bits).
SEGMENT_BYTES, SEGMENT_DOCS = 8 << 20, 1 << 16
#: Items that travel to the segments at once, and their terms, where one item hasn't more.
BLOCK_ITEMS, BLOCK_TERMS = 1024, 1 << 18

INDEX_SCHEMA = "segment long, doc_ids array<long>, lengths binary, terms binary, starts binary, docs binary, impacts binary, counts binary"

_SPACE = 0x20
#: Bytes of terms, A-Z in lower case; all others are spaces. Bytes of wider characters belong to terms.
_AS_TERMS = np.full(256, _SPACE, np.uint8)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _AS_TERMS[_first : _last + 1] = np.arange(_first, _last + 1)
_AS_TERMS[0x41 : 0x5A + 1] += 0x20


@dataclass(frozen=True)
class Index:
    """Segments, and the corpus's documents with terms (N) and occurrences of terms (L)."""

    segments: DataFrame
    n_docs: int
    n_terms: int


def _terms(column: pa.Array) -> Words:
    """Hashes of the terms of each text."""
    offsets, data = text_bytes(column)
    spaced = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_AS_TERMS[data]))
    return Words(spaced)


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and occurrences of terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for whole in batches:
            for batch in text_groups(whole, "text"):
                offsets, data = text_bytes(batch.column("text"))
                inside = _AS_TERMS[data] != _SPACE
                opens = inside.copy()
                opens[1:] &= ~inside[:-1]
                edges = offsets[:-1][offsets[:-1] < len(data)]
                opens[edges] = inside[edges]
                before = np.concatenate([[0], np.cumsum(opens)])[offsets]
                own = np.diff(before)
                n, total = n + int((own > 0).sum()), total + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    row = docs.select("text").mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def _parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (tf * 1_000_000_000) // (tf * 1000 + m * 8)


def _medians(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 10 + (90 * lengths * n_docs) // max(n_terms, 1)


def _segment(number: int, ids: list, texts: list, n_docs: int, n_terms: int) -> pa.RecordBatch:
    words = _terms(pa.chunked_array(texts).combine_chunks())
    lengths = words.counts().astype(np.int64)
    doc = np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
    order = np.argsort(words.hashes, kind="stable")  # documents stay in order within a term
    h, doc = words.hashes[order], doc[order]
    del words, order
    new_term = np.ones(len(h), bool)
    new_term[1:] = h[1:] != h[:-1]
    new = new_term.copy()
    new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    doc = doc[at]
    impact = -(-_parts(tf, _medians(lengths, n_docs, n_terms)[doc]) // STEP)
    first = np.flatnonzero(new_term[at])
    values = [np.ascontiguousarray(h[at[first]]), np.append(first, len(at)).astype(np.uint32), doc, impact.astype(np.uint8), tf.astype(np.uint32)]
    arrays = [pa.array([number], pa.int64()), pa.array([[x for part in ids for x in part.to_pylist()]], pa.list_(pa.int64())), pa.array([lengths.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array([x.tobytes()], pa.binary()) for x in values)], ["segment", "doc_ids", "lengths", "terms", "starts", "docs", "impacts", "counts"])


def build_index(docs: DataFrame, path: str | None = None) -> Index:
    """Index every document (``doc_id``, ``text``); written to ``path``, or to the shared folder."""
    n_docs, n_terms = corpus_counts(docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, size, rows = TaskContext.get().partitionId() << 32, [], [], 0, 0
        for whole in batches:
            for batch in text_groups(whole, "text"):
                for a in range(0, batch.num_rows, SEGMENT_DOCS // 2):
                    part = batch.slice(a, SEGMENT_DOCS // 2)
                    text = part.column("text").cast(pa.large_string())
                    if rows and (size >= SEGMENT_BYTES or rows + len(text) > SEGMENT_DOCS):
                        yield _segment(number, ids, texts, n_docs, n_terms)
                        number, ids, texts, size, rows = number + 1, [], [], 0, 0
                        release()
                    ids.append(part.column("doc_id"))
                    texts.append(text)
                    size, rows = size + text.nbytes, rows + len(text)
        if rows:
            yield _segment(number, ids, texts, n_docs, n_terms)
        release()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, INDEX_SCHEMA)
    spark = docs.sparkSession
    path = path or scratch_path(spark, "lexical-index")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return Index(spark.read.schema(INDEX_SCHEMA).parquet(path), n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and ``terms``, the distinct hashes of its terms as bytes; items without terms have no row."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_groups(whole, "text"):
                words = _terms(batch.column("text"))
                own = [np.unique(words.hashes[a:b]).view(np.int64) for a, b in zip(words.of[:-1], words.of[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(own, pa.list_(pa.int64()))], ["item_id", "terms"])

    rows = items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(split, "item_id long, terms array<long>").where(F.size("terms") > 0)
    return rows.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))


@dataclass(frozen=True)
class _Block:
    """Items with their terms as places among the block's terms."""

    ids: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    terms: np.ndarray


def _blocks(items: DataFrame) -> Iterator[_Block]:
    """A bounded number of items at a time reaches the driver."""
    ids: list[int] = []
    own: list[np.ndarray] = []

    def block() -> _Block:
        terms, places = np.unique(np.concatenate(own), return_inverse=True)
        return _Block(np.array(ids, np.int64), np.concatenate([[0], np.cumsum([len(x) for x in own])]), places, terms)

    for row in items.toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or sum(map(len, own)) + len(row.terms) > BLOCK_TERMS):
            yield block()
            ids, own = [], []
        ids.append(row.item_id)
        own.append(np.array(row.terms, np.int64).view(np.uint64))
    if ids:
        yield block()


def _found(terms: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``terms`` a segment has, and their places in its list."""
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(own, terms)
    at[at == len(own)] = 0
    there = np.flatnonzero(own[at] == terms)
    return there, at[there]


def _weights(index: Index, terms: np.ndarray) -> np.ndarray:
    """Whole weights by document frequency, which tasks add up over their segments."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                there, at = _found(terms, np.frombuffer(own.as_buffer(), np.uint64))
                df[there] += np.diff(np.frombuffer(starts.as_buffer(), np.uint32).astype(np.int64))[at] if len(at) else 0
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some])], ["term", "df"])

    found = index.segments.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(len(terms), np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class _Best:
    """The k best (score, document) of each item that a task has seen, and k-th largest lower bounds."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.lower = np.zeros((items, k), np.int64)
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]

    def raise_bound(self, item: int, lower: np.ndarray) -> int:
        own = np.sort(np.concatenate([self.lower[item], lower]))[-self.k :]
        self.lower[item] = own
        return int(own[0])

    def add(self, item: int, scores: np.ndarray, ids: list[int | None]) -> None:
        rows = self.rows[item]
        rows += [(-s, x is None, x or 0) for s, x in zip(scores.tolist(), ids, strict=True) if s > 0]
        rows.sort()
        del rows[self.k :]


def _postings(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all postings of the lists ``at``, and each list's length."""
    first, size = starts[at], starts[at + 1] - starts[at]
    before = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(first - before[:-1], size) + np.arange(before[-1]), size


def _search_segment(row: dict, block: _Block, weights: np.ndarray, index_counts: tuple[int, int], best: _Best) -> None:
    docs, impacts = np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["impacts"], np.uint8)
    starts = np.frombuffer(row["starts"], np.uint32).astype(np.int64)
    list_of = np.full(len(block.terms), -1)
    there, at = _found(block.terms, np.frombuffer(row["terms"], np.uint64))
    list_of[there] = at
    lengths = np.frombuffer(row["lengths"], np.int64)
    chosen = np.zeros(len(lengths), bool)
    for item in range(len(block.ids)):
        own = block.places[block.starts[item] : block.starts[item + 1]]
        own = own[(list_of[own] >= 0) & (weights[own] > 0)]
        if not len(own):
            continue
        where, size = _postings(starts, list_of[own])
        weight = np.repeat(weights[own], size)
        doc = docs[where]
        # whole numbers below 2 ** 53, so sums of doubles are exact
        upper = np.bincount(doc, weights=weight * impacts[where], minlength=len(lengths))
        k = best.k
        top = np.argpartition(upper, -k)[-k:] if len(upper) > k else np.arange(len(upper))
        chosen[top] = True
        some = chosen[doc]
        lower = np.bincount(doc[some], weights=weight[some] * np.maximum(impacts[where[some]].astype(np.int64) - 1, 0), minlength=len(lengths))[top]
        chosen[top] = False
        bound = best.raise_bound(item, lower.astype(np.int64))
        reached = np.flatnonzero(upper >= max(bound, 1))
        chosen[reached] = True
        some = np.flatnonzero(chosen[doc])
        chosen[reached] = False
        tf = np.frombuffer(row["counts"], np.uint32)[where[some]].astype(np.int64)
        doc = doc[some]
        score = np.zeros(len(lengths), np.int64)
        np.add.at(score, doc, weight[some] * _parts(tf, _medians(lengths, *index_counts)[doc]))
        best.add(item, score[reached], [row["doc_ids"][x] for x in reached.tolist()])


def _search_block(index: Index, block: _Block, k: int) -> DataFrame:
    weights, counts = _weights(index, block.terms), (index.n_docs, index.n_terms)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(block.ids), k)
        for batch in batches:
            for place in range(batch.num_rows):
                row = {n: batch.column(n)[place].as_py() for n in ("doc_ids", "lengths", "terms", "starts", "docs", "impacts", "counts")}
                _search_segment(row, block, weights, counts, best)
        release()
        found = [(int(block.ids[i]), None if null else x, -s) for i, rows in enumerate(best.rows) for s, null, x in rows]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return index.segments.mapInArrow(search, "item_id long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of each item (``item_id``, ``text``): item_id, rank, doc_id, score."""
    spark: SparkSession = items.sparkSession
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in _blocks(materialize(item_terms(items), "items")):
        found = found.unionByName(_search_block(index, block, k))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
