"""The prefix trie of conversations: dictionary tries over hash partitions, merged at the top.

A conversation is the sequence of its turns (role and text). Equal sequences are one
weighted path. Paths are dealt into partitions by the digest of their first turn; a grouped
map builds the tries of its partition, nodes in order of creation, children as
dictionaries from turn digest to node, and sums up in iterative postorder (a child is
always created after its parent, so the order of creation backwards is one).

A first turn whose paths hold more than ``MOST_TURNS`` turns is dealt out again by the
next turn, and again until every subtrie fits or its paths end. What lies above such
subtries is put together level by level from their tops; the root from all tops.

Turns are compared by the MD5 of role length, role and text. Null roles and texts are
empty. Turns are in the order of ``turn``, null first, then role and digest; repeated rows
are turns of their own. Rows with a null ``conv_id`` take no part. A conversation is one
row of 24 bytes a turn, however long its texts. Extra columns are ignored. Without
conversations there is no node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import materialize

#: Turns of a partition on average, and of a subtrie at most.
PARTITION_TURNS, MOST_TURNS = 25_000, 100_000
#: Ids that are hashed at once.
RUN_IDS = 8192
#: A rebuilt conversation begins like the first of its five.
FAMILY, LONGEST_HEAD = 5, 9

NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_NODES = "key binary, up binary, top boolean, bytes long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` from 0, ``digest`` and ``bytes`` of the text, a row a turn; no text is shuffled."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation c begins with the first crc32(c) % 9 turns of c - c % 5; its own follow from there.

    ``conv_id`` and ``path``, the turns in order; conversations left without turns are there too.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LONGEST_HEAD
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), head.alias("head"))
    # at most eight turns of a base conversation travel to its family
    first = turns.where(F.col("pos") < LONGEST_HEAD - 1).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    begun = convs.join(first, "base", "left").withColumn("pos", F.when(F.col("pos") < F.col("head"), F.col("pos")))
    own = turns.where(F.col("pos") >= F.crc32(F.col("conv_id").cast("string").cast("binary")) % LONGEST_HEAD)
    both = begun.select("conv_id", "pos", "digest", "bytes").unionByName(own)
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "digest", "bytes"))
    return both.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("path"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[int]]]:
    """Neighbouring ids of one path, ``RUN_IDS`` at a time."""
    whole, ids = None, []
    for batch in batches:
        for key, conv in zip(batch.column("whole").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if key != whole or len(ids) >= RUN_IDS:
                if ids:
                    yield whole, ids
                whole, ids = key, []
            ids.append(conv)
    if ids:
        yield whole, ids


def _ends(convs: DataFrame) -> DataFrame:
    """Per whole path, the digest of its conversations' ids in numerical order.

    Ids are sorted by range, so those of a path that many share are ordered and written out
    by many tasks; the task that hashes a path reads a few long runs of ids, one at a time.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, ids in _runs(batches):
            text = ",".join(map(str, ids)).encode()
            yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([text], pa.binary())], ["whole", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("whole").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == whole:
                    state.update(b"," + ids)
                    continue
                if whole is not None:
                    done.append((whole, state.hexdigest()))
                whole, state = key, hashlib.sha256(ids)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done])], ["whole", "ends"])
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary()), pa.array([state.hexdigest()])], ["whole", "ends"])

    keys = ["whole", "conv_id"]
    runs = convs.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(joined, "whole binary, first long, ids binary")
    return runs.repartition("whole").sortWithinPartitions("whole", "first").mapInArrow(digests, "whole binary, ends string")


def weighted_paths(convs: DataFrame) -> DataFrame:
    """Equal paths as one row: ``digests`` and ``sizes`` of its turns, ``least`` id, ``n``, ``ends``."""
    digests = F.transform("path", lambda x: x["digest"])
    whole = F.unhex(F.md5(F.concat_ws("", F.transform(digests, F.hex)).cast("binary")))
    rows = materialize(convs.select("conv_id", whole.alias("whole"), digests.alias("digests"), F.transform("path", lambda x: x["bytes"]).alias("sizes")), "rebuilt-conversations")
    same = rows.groupBy("whole").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"))
    paths = same.join(rows.select(F.col("conv_id").alias("least"), "digests", "sizes"), "least")
    return paths.join(_ends(rows), "whole").drop("whole")


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The tries below the keys of a partition."""
    tops: dict[bytes, int] = {}
    key, up, top, size, depth, parent, least, n, ends = [], [], [], [], [], [], [], [], []
    children: list[dict[bytes, int]] = []

    def node(row, is_top: bool, place: int, above: int) -> int:
        for column, value in ((key, row.key), (up, row.up), (top, is_top), (size, int(row.sizes[place])), (depth, place + 1), (parent, above), (least, None), (n, 0), (ends, NO_ENDS), (children, {})):
            column.append(value)
        return len(key) - 1

    for row in rows.itertuples(index=False):
        if row.key not in tops:
            tops[row.key] = node(row, True, row.at - 1, -1)
        here = tops[row.key]
        for place in range(row.at, len(row.digests)):
            turn = row.digests[place]
            after = children[here].get(turn)
            if after is None:
                after = children[here][turn] = node(row, False, place, here)
            here = after
        least[here] = row.least if least[here] is None else min(least[here], row.least)
        n[here] += row.n
        ends[here] = row.ends  # equal paths are one row: a node ends one path at most
    leaves, saved = [0] * len(key), [0] * len(key)
    for here in reversed(range(len(key))):
        leaves[here] = leaves[here] or 1
        saved[here] += (n[here] - 1) * size[here]
        above = parent[here]
        if above >= 0:
            least[above] = least[here] if least[above] is None else min(least[above], least[here])
            n[above] += n[here]
            leaves[above] += leaves[here]
            saved[above] += saved[here]
    above = pd.array([least[p] if p >= 0 else None for p in parent], "Int64")
    return pd.DataFrame({"key": key, "up": up, "top": top, "bytes": size, "conv_id": least, "depth": depth, "parent_conv_id": above, "n_convs": n, "n_children": [len(x) for x in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})


def _next(paths: DataFrame) -> DataFrame:
    """The same paths, dealt by one more turn; ``up`` is the key before, ``at`` the turns in the key."""
    key = F.unhex(F.md5(F.concat(F.col("key"), F.col("digests")[F.col("at")])))
    return paths.select(key.alias("key"), F.col("key").alias("up"), (F.col("at") + 1).alias("at"), "digests", "sizes", "least", "n", "ends")


def _merged(children: DataFrame, ended: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes put together from the tops below them and the paths that end there.

    ``children`` has the node's key as ``up``, ``ended`` as ``key``; ``nodes`` has key, up, depth and bytes.
    """
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    below = children.select(F.col("up").alias("key"), F.col("conv_id").alias("least"), F.col("n_convs").alias("n"), F.lit(1).alias("child"), "n_leaves", "saved_tokens", none.alias("ends"))
    here = ended.select("key", "least", "n", F.lit(0).alias("child"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends")
    merged = below.unionByName(here).groupBy("key").agg(
        F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("child").cast("long").alias("n_children"),
        F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.coalesce(F.max("ends"), F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    if nodes is None:
        return merged
    return merged.join(nodes, "key").withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes"))


def _deal(paths: DataFrame, most_turns: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Paths with the key of their subtrie, none of more than ``most_turns`` turns; and, per
    depth from 1 on, the keys above such subtries and the paths that end at them."""
    pending = _next(paths.where(F.size("digests") > 0).withColumns({"key": F.lit(b""), "at": F.lit(0)}))
    fitting, upper = [], []
    while True:
        size = F.size("digests") - F.col("at") + 1
        large = materialize(pending.groupBy("key").agg(F.sum(size).alias("turns")).where(F.col("turns") > most_turns).select("key"), "large-subtries")
        if large.isEmpty():
            fitting.append(pending)
            break
        fitting.append(pending.join(large, "key", "left_anti"))
        pending = materialize(pending.join(large, "key", "left_semi"), "large-paths")
        nodes = pending.groupBy("key").agg(F.min("up").alias("up"), F.max("at").cast("long").alias("depth"), F.max(F.col("sizes")[F.col("at") - 1]).alias("bytes"))
        upper.append((nodes, pending.where(F.size("digests") == F.col("at"))))
        pending = _next(pending.where(F.size("digests") > F.col("at")))
    dealt = fitting[0]
    for more in fitting[1:]:
        dealt = dealt.unionByName(more)
    return materialize(dealt, "dealt-paths"), upper


def trie(convs: DataFrame, most_turns: int = MOST_TURNS, partition_turns: int = PARTITION_TURNS) -> DataFrame:
    """Every node of the trie of conversations (``conv_id`` and ``path``, as ``rebuilt`` gives them)."""
    paths = materialize(weighted_paths(convs), "paths")
    dealt, upper = _deal(paths, most_turns)
    turns = dealt.agg(F.sum(F.size("digests"))).first()[0] or 0
    partition = F.pmod(F.xxhash64("key"), F.lit(max(1, math.ceil(turns / partition_turns)))).alias("partition")
    nodes = materialize(dealt.select(partition, "key", "up", "at", "digests", "sizes", "least", "n", "ends").groupBy("partition").applyInPandas(_tries, _NODES), "trie-nodes")

    tops = nodes.where("top")
    above = None
    for level in reversed(range(len(upper))):  # large subtries, from the deepest up
        made = materialize(_merged(tops.where(F.col("depth") == level + 2), upper[level][1], upper[level][0]), "merged-nodes")
        tops = tops.unionByName(made, allowMissingColumns=True)
        above = made if above is None else above.unionByName(made)
    ended = paths.where(F.size("digests") == 0).withColumn("key", F.lit(b""))
    root = materialize(_merged(tops.where(F.col("depth") == 1), ended), "root").withColumns({"depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    first = root.first()
    least = F.lit(first.conv_id if first else None).cast("long")
    out = nodes.where("not top").select(COLUMNS).unionByName(root.select(COLUMNS)).unionByName(tops.where("depth = 1").withColumn("parent_conv_id", least).select(COLUMNS))
    if above is not None:
        parents = above.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
        out = out.unionByName(tops.where("depth > 1").drop("parent_conv_id").join(parents, "up").select(COLUMNS))
    return out
