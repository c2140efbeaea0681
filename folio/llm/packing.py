"""Best-fit packing of documents into token sequences, improved by swaps.

Documents become pieces of at most ``capacity`` ids (only longer ones are cut).
Pieces are dealt into groups of about ``GROUP_PIECES`` at random, so every group
has the same mix of lengths and no group grows with the data; each group is packed
in one task. A group starts from best-fit decreasing. Then the emptiest bins are
dissolved: local search moves a document, exchanges one for one or two for one
between underfull bins whenever that raises the sum of squared fills, until bins
run empty or nothing improves. Where many pieces are short, a group needs about one
sequence more than its tokens fill. Where all are long it stops short of the best: of
2,100 pieces that fit into 700 sequences by threes it makes 708, of 2,000 pieces of 1,300
to 1,700 tokens 916 where 896 would do.

Null text counts as empty: only its end id. Rows with equal doc_id stay separate
pieces but can't be told apart in the result. Extra columns are ignored. An empty
table gives an empty result. Text is never sent to the groups, only lengths.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import dealt, materialize
from folio.llm.tokenizing import encoder, text_groups

#: Pieces packed together by one task.
GROUP_PIECES = 20_000
#: Bins that local search works on at once, the emptiest of a group.
SEARCH_BINS = 48
#: Rounds of local search at most; each round raises the squared fill.
SEARCH_ROUNDS = 400

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_groups(whole, "text"):
                ids, of = encoder(tokenizer).encode(batch.column("text"))
                ids = np.insert(ids, of[1:], end_id)
                of = of + np.arange(len(of))
                size = np.diff(of)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                raw, a = memoryview(ids.astype("<u4").tobytes()), of[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(a.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece into the fullest bin that has room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, (n, -1))
        if at < len(rooms):
            free, b = rooms.pop(at)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if free > n:
            bisect.insort(rooms, (free - n, b))
    return bins


def _improve(donor: list[int], taker: list[int], lengths: np.ndarray, capacity: int) -> bool:
    """One change between two bins that raises the sum of squared fills, if there is any.

    The fuller bin takes: every change that leaves it fuller, within capacity, raises
    the sum, as their total stays. Moves are tried first, then one for one, two for one.
    """
    free = capacity - int(lengths[taker].sum())
    if free <= 0 or not donor:
        return False
    own = lengths[donor]
    fits = np.flatnonzero(own <= free)
    if len(fits):
        taker.append(donor.pop(int(fits[np.argmax(own[fits])])))
        return True
    theirs = lengths[taker]
    gain = own[:, None] - theirs[None, :]
    gain[(gain <= 0) | (gain > free)] = 0
    best, change = int(gain.max()), None
    if best > 0:
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        change = ([int(i)], [int(j)])
    if best < free:
        # two of the donor's for one of the taker's, then one for two
        for mine, other, flip in ((own, theirs, False), (theirs, own, True)):
            if len(mine) < 2:
                continue
            p, q = np.triu_indices(len(mine), 1)
            pair = mine[p] + mine[q]
            # of each pair's partners, the one that fills the most room
            order = np.argsort(other, kind="stable")
            ranked = other[order]
            if flip:
                at = np.searchsorted(ranked, pair + free, "right") - 1
                gain = np.where(at >= 0, ranked[np.maximum(at, 0)] - pair, 0)
            else:
                at = np.searchsorted(ranked, pair - free, "left")
                gain = np.where(at < len(ranked), pair - ranked[np.minimum(at, len(ranked) - 1)], 0)
            if len(gain) and int(gain.max()) > best:
                x = int(gain.argmax())
                best = int(gain[x])
                two, one = [int(p[x]), int(q[x])], [int(order[at[x]])]
                change = (one, two) if flip else (two, one)
    if change is None:
        return False
    give = [donor[i] for i in change[0]]
    take = [taker[j] for j in change[1]]
    for i in sorted(change[0], reverse=True):
        donor.pop(i)
    for j in sorted(change[1], reverse=True):
        taker.pop(j)
    taker += give
    donor += take
    return True


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchange documents between underfull bins, increasing squared fill, until bins empty."""
    bound = -(-int(lengths.sum()) // capacity)
    fill = [int(lengths[x].sum()) for x in bins]
    for _ in range(SEARCH_ROUNDS):
        if len(bins) <= bound:
            break
        order = sorted(range(len(bins)), key=fill.__getitem__)
        open_ = [b for b in order if fill[b] < capacity][:SEARCH_BINS]
        changed = False
        for donor in open_:
            for taker in reversed(open_):
                if donor == taker or fill[taker] < fill[donor]:
                    continue
                while bins[donor] and _improve(bins[donor], bins[taker], lengths, capacity):
                    changed = True
                    fill[donor], fill[taker] = int(lengths[bins[donor]].sum()), int(lengths[bins[taker]].sum())
                    if fill[taker] >= capacity or fill[donor] > fill[taker]:
                        break
                if not bins[donor]:
                    break
            if not bins[donor]:
                break
        keep = [b for b in range(len(bins)) if bins[b]]
        bins, fill = [bins[b] for b in keep], [fill[b] for b in keep]
        if not changed:
            break
    return bins


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    full = lengths >= capacity
    rest = np.flatnonzero(~full)
    bins = local_search(best_fit(lengths[rest], capacity), lengths[rest], capacity)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, members in enumerate(bins):
        own = rest[members]
        where[own] = b
        offset[own] = np.cumsum(lengths[own]) - lengths[own]
    where[full] = len(bins) + np.arange(int(full.sum()))
    return where, offset


def pack(piece_rows: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length.

    ``piece_rows`` must be a written table: it is counted first.
    """
    groups = max(1, round(piece_rows.count() / group_pieces))
    schema = piece_rows.schema.add("sequence_id", "long").add("offset", "long")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        where, offset = pack_lengths(pdf["length"].to_numpy(np.int64), capacity)
        pdf["sequence_id"] = pdf["_group"].to_numpy(np.int64) * (1 << 32) + where
        pdf["offset"] = offset
        return pdf.drop(columns="_group")

    # by place in the written table, so equal rows spread like others
    group = F.pmod(dealt(), F.lit(groups))
    return piece_rows.withColumn("_group", group).groupBy("_group").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Tokenize, cut and pack all documents."""
    return pack(materialize(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity, group_pieces)
