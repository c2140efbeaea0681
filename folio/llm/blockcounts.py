"""Corpus-wide counts of hashed keys, joined back to the documents that hold them.

Documents are dealt into blocks by their place in the input, of about ``BLOCK_BYTES`` each.
A block sends each distinct key once with its own count, sorted and cut into hash
buckets, so a key that every document has costs one entry per block. A bucket adds
up the counts of its keys over all blocks and answers each block in the order of
its request; the block makes its keys again from its documents and lines them up.

Keys travel as differences of sorted values in 48 bits, answers without keys, so
a shuffle carries about seven bytes per distinct key of a block. A block has bounded
size, a bucket holds a hash share of the keys and their number grows with the input:
no group grows with the data, and no key is hot after the first step. A block sends a
row per bucket that it has keys in, so there are never more rows than keys, however
many blocks and buckets there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.bytehash import IS_SPACE, mix, text_bytes
from folio.llm.memory import release
from folio.llm.tokenizing import text_groups

U64 = np.uint64
#: Text in a block, on average.
BLOCK_BYTES = 8 << 20
#: Text whose keys a bucket counts, on average.
BUCKET_BYTES = 6 << 20
LEAST_BLOCKS, LEAST_BUCKETS = 24, 48
#: Text that travels as one row, or one document.
SLICE_BYTES = 256 << 10

REQUEST_SCHEMA = "_bucket int, _block long, low binary, high binary, wide binary, counts binary"
ANSWER_SCHEMA = "_bucket int, _block long, totals binary"


@dataclass(frozen=True)
class CorpusSize:
    bytes: int
    words: int


def corpus_size(docs: DataFrame) -> CorpusSize:
    """Bytes and words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = words = 0
        for whole in batches:
            for batch in text_groups(whole, "text"):
                offsets, data = text_bytes(batch.column("text"))
                inside = ~IS_SPACE[data]
                opens = inside.copy()
                opens[1:] &= ~inside[:-1]
                edges = offsets[1:-1]
                edges = np.unique(edges[(edges > 0) & (edges < len(data))])
                size += len(data)
                words += int(opens.sum()) + int((inside[edges] & inside[edges - 1]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([words], pa.int64())], ["bytes", "words"])

    row = docs.select("text").mapInArrow(count, "bytes long, words long").agg(F.sum("bytes"), F.sum("words")).first()
    return CorpusSize(row[0] or 0, row[1] or 0)


def block_count(size: CorpusSize) -> int:
    return max(LEAST_BLOCKS, math.ceil(size.bytes / BLOCK_BYTES))


def in_blocks(docs: DataFrame, size: CorpusSize) -> DataFrame:
    """Deal the documents of a written table into blocks: the one shuffle of the texts.

    Slices of neighbouring rows travel as one compressed Arrow stream each. A slice's
    block comes from its place in the input, so equal rows spread like all others and a
    table read twice from the same files is dealt alike both times.
    """
    blocks = block_count(size)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for whole in batches:
            for batch in text_groups(whole, "text", SLICE_BYTES):
                block = int(mix(np.array([part << 32 | place], U64))[0]) % blocks
                place += 1
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
                    # a slice as it is would bring its whole batch along
                    stream.write_table(pa.Table.from_batches([batch]))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_block", "packed"])

    return docs.mapInArrow(pack, "_block long, packed binary").repartition(blocks, "_block")


def _rows(table: pa.Table) -> pa.Table:
    """The documents of a block, with ``_block``."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("packed").combine_chunks()] if table.num_rows else []
    if not parts:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "_block": pa.array([], pa.int64())})
    rows = pa.concat_tables(parts).combine_chunks()
    return rows.append_column("_block", pa.array(np.full(rows.num_rows, table.column("_block")[0].as_py()), pa.int64()))


def _present(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall in, and where each one's keys begin; a bucket is a range of values."""
    return np.unique(keys // U64((1 << 64) // buckets + 1), return_index=True)


def _pack(keys: np.ndarray) -> tuple[bytes | None, bytes | None, bytes | None]:
    gaps = np.diff(keys, prepend=U64(0))
    gaps[0] = 0  # the first key stands in front of the low bytes
    if len(gaps) > 1 and int(gaps.max()) >> 48:
        return None, None, keys.tobytes()
    return keys[:1].tobytes() + (gaps & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (gaps >> U64(32)).astype(np.uint16).tobytes(), None


def _unpack(low: bytes | None, high: bytes | None, wide: bytes | None) -> np.ndarray:
    if wide is not None:
        return np.frombuffer(wide, U64)
    gaps = np.frombuffer(low, np.uint32, offset=8).astype(U64) | (np.frombuffer(high, np.uint16).astype(U64) << U64(32))
    gaps[0] = np.frombuffer(low, U64, 1)[0]
    return np.cumsum(gaps, dtype=U64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts as bytes; the few from 255 on follow in full."""
    large = counts >= 255
    return len(counts).to_bytes(8, "little") + np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes()


def _widen(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    counts = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.uint8, offset=8 + n).view(np.int64)
    return counts


Keys = Callable[..., tuple[np.ndarray, np.ndarray]]


def totals(blocks: DataFrame, keys: Keys, size: CorpusSize, known: DataFrame | None = None) -> DataFrame:
    """Per block and bucket, the corpus-wide totals of the block's distinct keys.

    ``keys`` gives the sorted distinct keys (unsigned 64-bit) of a block's documents
    and their counts in it; with ``known``, answers of an earlier round, it is given
    the block's rows of those too.
    """

    buckets = max(LEAST_BUCKETS, math.ceil(size.bytes / BUCKET_BYTES))

    def request(table: pa.Table, *answers: pa.Table) -> pa.Table:
        own, counts = keys(_rows(table), *answers)
        block = table.column("_block")[0].as_py()
        there, first = _present(own, buckets)
        rows = []
        for b, x, y in zip(there.tolist(), first.tolist(), np.append(first, len(own))[1:].tolist(), strict=True):
            rows.append((b, block, *_pack(own[x:y]), _narrow(counts[x:y])))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        release()
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["_bucket", "_block", "low", "high", "wide", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        asked = [_unpack(*x) for x in zip(*(table.column(c).to_pylist() for c in ("low", "high", "wide")), strict=True)]
        counts = [_widen(x) for x in table.column("counts").to_pylist()]
        _, which = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts)).astype(np.int64)[which]
        ends = np.cumsum([len(x) for x in asked])
        parts = [_narrow(total[b - len(x) : b]) for b, x in zip(ends, asked, strict=True)]
        release()
        return pa.table([table.column("_bucket"), table.column("_block"), pa.array(parts, pa.binary())], ["_bucket", "_block", "totals"])

    def request_after(table: pa.Table, answers: pa.Table) -> pa.Table:
        return request(table, answers)

    if known is None:
        asked = blocks.groupBy("_block").applyInArrow(request, REQUEST_SCHEMA)
    else:
        asked = blocks.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(request_after, REQUEST_SCHEMA)
    # dealt to the blocks here, so that several uses of the answers share one shuffle
    return asked.groupBy("_bucket").applyInArrow(answer, ANSWER_SCHEMA).repartition(block_count(size), "_block")


def joined_totals(answers: pa.Table) -> np.ndarray:
    """The totals of all distinct keys of a block, in key order."""
    order = np.argsort(answers.column("_bucket").to_numpy(), kind="stable")
    parts = answers.column("totals").to_pylist()
    return np.concatenate([_widen(parts[k]) for k in order]) if parts else np.zeros(0, np.int64)


def with_totals(blocks: DataFrame, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply ``use`` to each block's documents and its answers."""

    def apply(docs: pa.Table, own: pa.Table) -> pa.Table:
        out = use(_rows(docs), own)
        release()
        return out

    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(apply, schema)
