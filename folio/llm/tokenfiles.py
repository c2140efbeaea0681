"""Token ids of documents in Simple-8b files, written and read by Spark tasks.

Layout of a ``.s8b`` file, all little-endian: the magic number; the words of all
ids of its documents, coded in blocks (``simple8b``); per block the word at which
it begins (u64); per document its id (i64) and number of ids (u64); then a footer
of seven u64: blocks, documents, words, ids, values in a block, version, magic.
Files hold consecutive documents in ascending id order.

A null text counts as empty. A null document id sorts first and is kept; equal
ids stay separate documents, in an order that the text settles. Extra columns are
ignored. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import simple8b, storage
from folio.llm.shared import dealt, materialize, scratch_path, spread_over
from folio.llm.tokenizing import encoder, text_groups

MAGIC = 0x31304232385346  # "FS82B01"
VERSION = 1
#: Ids after which a task begins another file.
FILE_IDS = 4_000_000
_FOOTER = struct.Struct("<7Q")
NULL_ID = np.iinfo(np.int64).min

INDEX_SCHEMA = "path string, first_doc long, part int, place int, n_docs long, n_ids long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a file."""
    words, offsets = simple8b.encode(ids)
    footer = _FOOTER.pack(len(offsets), len(doc_ids), len(words), len(ids), simple8b.BLOCK, VERSION, MAGIC)
    return [struct.pack("<Q", MAGIC), words.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), footer]


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, and all ids of a file."""
    blocks, docs, words, n, block, version, magic = _FOOTER.unpack(data[-_FOOTER.size :])
    if magic != MAGIC or struct.unpack_from("<Q", data)[0] != MAGIC or version != VERSION or block != simple8b.BLOCK:
        raise ValueError("not a token file of this version")
    at = 8
    parts = []
    for kind, count in (("<u8", words), ("<u8", blocks), ("<i8", docs), ("<u8", docs)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += 8 * count
    return parts[2], parts[3].astype(np.int64), simple8b.decode(parts[0], parts[1].astype(np.int64), n).astype(np.uint32)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None) -> DataFrame:
    """Encode ``text`` of all documents into files in ``folder``, in ascending doc_id order.

    One range shuffle sorts the documents; each task encodes its range and writes
    files of about ``FILE_IDS`` ids. Returns the index, one row per file, as a
    written table: a file counts only if the index names it.
    """
    tail = [] if end_id is None else [end_id]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            docs_, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            with storage.new_file(folder, ".s8b") as (uri, stream):
                for x in pack(docs_, sizes, ids):
                    stream.write(x)
            held.clear()
            row = [uri, None if docs_[0] == NULL_ID else int(docs_[0]), part, place, len(docs_), len(ids)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["path", "first_doc", "part", "place", "n_docs", "n_ids"])

        for whole in batches:
            for batch in text_groups(whole, "text"):
                ids, of = encoder(tokenizer).encode(batch.column("text"))
                if tail:
                    ids = np.insert(ids, of[1:], tail[0])
                    of = of + np.arange(len(of))
                held.append((batch.column("doc_id").fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False), np.diff(of), ids))
                if sum(len(x[2]) for x in held) >= FILE_IDS:
                    yield flush()
                    place += 1
        if held:
            yield flush()

    # rows that share an id, or have none, are ordered by a hash, so that they need not meet in one task
    rows = docs.select(F.col("doc_id").cast("long"), "text", dealt().alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return materialize(ordered.mapInArrow(write, INDEX_SCHEMA), "token-index")


def read_token_files(index: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Only the index, a row per file, is put in order; files are read in parallel.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("file_start").to_pylist(), strict=True):
                doc_ids, sizes, ids = unpack(storage.read_file(path))
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # parts are in the order of ids: a running sum over the few parts, then one over the files of each
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("part_start"))
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.join(parts, "part").withColumn("file_start", F.col("part_start") + F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = spread_over(index.count(), index.sparkSession.sparkContext.defaultParallelism)
    tasks = placed.select("path", "file_start").repartition(spread)
    return tasks.mapInArrow(read, DOC_SCHEMA)


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """Write the token files of all documents to the shared folder and read them back."""
    return read_token_files(write_token_files(docs, scratch_path(docs.sparkSession, "tokens"), tokenizer, end_id))
