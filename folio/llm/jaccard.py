"""Exact Jaccard join of documents on word shingles, by token-combination prefixes.

A document is the set of its distinct shingles. Two sets with Jaccard similarity t or
more share so many shingles that, in one global order with rare ones first, the first
few of each must meet: a set needs |x| - ceil(t |x|) + 1 places of prefix. Shingles
that no other set has use up places and index nothing. Rare ones are indexed alone.
Frequent ones fall into classes by hash; a class is indexed by its 2-combinations, so
it costs the prefix one more place (without a common combination at most one shingle
of a class is shared), and the prefix is extended until its places suffice. Classes
are six times as many for each fourfold set size, which bounds the combinations; a
set near the border of two sizes is indexed for both.

Sets that share a signature are verified exactly, and no others. Every set is first
compared with one hub, the set it meets most often among those its signatures name;
most members of a group of near copies so join one component for one comparison each.
What is left, sets of different components on the list of one signature, is compared
without exception: lists that meet are one group, long ones are cut into tiles, every
pair of tiles that may hold a pair of different components is a group of bounded size,
and the overlaps of each list come from matrix products. Pairs are never rows, and only a spanning forest of the links leaves
a group. Equal sets are one node from the start.

Counts come from ``blockcounts``: no shingle list is collected, broadcast or sampled.
Shingles and sets are known by 64-bit hashes. Two shingles of one pair of documents, or
two sets of a corpus, that share a hash would be taken as equal; with 10**9 sets the
chance of one such pair is 3 in 100.

Null and empty texts have no shingles and link with nothing; texts under five words
are one shingle. Rows are kept one for one; rows with equal ids stay separate. Extra
columns are ignored. An empty table gives an empty result. ``docs`` must be a written
table, as its rows are dealt to blocks by place. Null ids count as larger than others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.blockcounts import U64, corpus_size, in_blocks, joined_totals, totals, with_totals
from folio.llm.bytehash import Words, distinct_sets, mix
from folio.llm.components import components, forest, spanning
from folio.llm.memory import release
from folio.llm.shared import materialize

SHINGLE_WORDS = 5
#: Similarity in hundredths.
THRESHOLD = 75
#: Shingles in more sets than this are frequent and indexed by combinations.
RARE_SETS = 12
#: Sets of size 12 * 4**k to 48 * 4**k use 6 * 4**k classes.
TIER_SIZE, TIER_CLASSES = 12, 6

#: Sets in a tile, on average.
TILE_SETS = 128
#: Keys over which the sets of a component are dealt.
SALTS = 16
#: Links of a group that wait to be thinned to a forest.
FOREST_ROWS = 1 << 14
#: Shingles in a matrix product at once.
COLUMNS = 8192

TABLE_SCHEMA = "kind int, doc_id long, set_id long, n_shingles int, sig long, block long, shingles binary"


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: size and id of its set, and the first text that has it; then the
    distinct sets' values and where each begins."""
    hashes, of = Words(table.column("text"), lower=True).windows(SHINGLE_WORDS, short=True)
    values, of = distinct_sets(hashes, of)
    size = np.diff(of)
    raw = memoryview(values.tobytes())
    ids = np.array([int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)], np.int64)
    return size, ids, np.unique(ids, return_index=True)[1], values, of


def _keys_of(first: np.ndarray, values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """All shingles of the distinct sets; an order needs 48 bits of them."""
    if not len(first):
        return values[:0]
    return np.concatenate([values[of[k] : of[k + 1]] for k in first]) >> U64(16) << U64(16)


def _block_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    _, _, first, values, of = _sets(table)
    return np.unique(_keys_of(first, values, of), return_counts=True)


def tiers(n: int) -> list[int]:
    """The sizes a set of n shingles is indexed for; -1: all shingles alone."""
    out = [-1] if n < TIER_SIZE else []
    k = 0
    while 4 * n >= 3 * TIER_SIZE * 4**k:
        if n < 4 * TIER_SIZE * 4**k:
            out.append(k)
        k += 1
    return out


def signatures(values: np.ndarray, df: np.ndarray, rare: int = RARE_SETS) -> np.ndarray:
    """The signatures of one set: its shingles' hashes and the sets that have each."""
    n = len(values)
    need = n - (THRESHOLD * n + 99) // 100 + 1
    alone = int((df <= 1).sum())
    need -= alone
    if need <= 0:
        return values[:0]
    order = np.lexsort((values, df))[alone:]
    values, df = values[order], df[order]
    n_rare = int(np.searchsorted(df, rare, "right"))
    out = []
    for tier in tiers(n):
        singles = len(values) if tier < 0 else n_rare
        out.append(mix(values[: min(need, singles)]))
        rest = need - singles
        if rest <= 0 or singles == len(values):
            continue
        frequent = values[n_rare:]
        group = (mix(frequent ^ U64(0x5BD1E995)) % U64(TIER_CLASSES * 4**tier)).astype(np.int64)
        fresh = np.zeros(len(group), bool)
        fresh[np.unique(group, return_index=True)[1]] = True
        places = np.cumsum(~fresh)  # each class but its first shingle
        end = min(len(group), int(np.searchsorted(places, rest)) + 1)
        order = np.lexsort((frequent[:end], group[:end]))
        token, group = frequent[:end][order], group[:end][order]
        for lag in range(1, int(np.bincount(group).max())):
            same = np.flatnonzero(group[lag:] == group[:-lag])
            out.append(mix(mix(token[same]) * U64(3) + token[same + lag] + U64(tier + 1)))
    return np.unique(np.concatenate(out))


def _index(table: pa.Table, answers: pa.Table) -> pa.Table:
    """A row per document (kind 0), per signature of a set (1), and per set with any (2)."""
    size, ids, first, values, of = _sets(table)
    keys = _keys_of(first, values, of)
    df = joined_totals(answers)[np.searchsorted(np.unique(keys), keys)] if len(keys) else np.zeros(0, np.int64)
    parts = [pa.table({"kind": pa.array(np.zeros(len(size), np.int32)), "doc_id": table.column("doc_id"), "set_id": pa.array(ids, mask=size == 0), "n_shingles": pa.array(size, pa.int32()), "sig": pa.nulls(len(size), pa.int64()), "block": pa.nulls(len(size), pa.int64()), "shingles": pa.nulls(len(size), pa.binary())})]
    at, sets, sigs, sizes, kept = 0, [], [], [], []
    for k in first.tolist():
        n = int(size[k])
        own = values[of[k] : of[k + 1]]
        found = signatures(own, df[at : at + n]) if n else own
        at += n
        if len(found):
            sets.append(np.full(len(found), ids[k]))
            sizes.append(np.full(len(found), n, np.int32))
            sigs.append(found.view(np.int64))
            kept.append((int(ids[k]), n, own.tobytes()))
    if kept:
        joined = [np.concatenate(x) for x in (sets, sizes, sigs)]
        parts.append(pa.table({"kind": pa.array(np.ones(len(joined[0]), np.int32)), "doc_id": pa.nulls(len(joined[0]), pa.int64()), "set_id": joined[0], "n_shingles": joined[1], "sig": joined[2], "block": pa.nulls(len(joined[0]), pa.int64()), "shingles": pa.nulls(len(joined[0]), pa.binary())}))
        own_id, own_n, own_raw = zip(*kept, strict=True)
        parts.append(pa.table({"kind": pa.array(np.full(len(kept), 2, np.int32)), "doc_id": pa.nulls(len(kept), pa.int64()), "set_id": pa.array(own_id, pa.int64()), "n_shingles": pa.array(own_n, pa.int32()), "sig": pa.nulls(len(kept), pa.int64()), "block": table.column("_block").slice(0, 1).take(pa.array(np.zeros(len(kept), np.int64))), "shingles": pa.array(own_raw, pa.binary())}))
    return pa.concat_tables(parts)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist()
        good = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            same = len(np.intersect1d(x, y, assume_unique=True))
            good[k] = 100 * same >= THRESHOLD * (len(x) + len(y) - same)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["src", "dst"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that are links, held against the whole sets."""
    a = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("b_set"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_set", "b_set").mapInArrow(_verify, "src long, dst long")


def _close(a: str, b: str):
    """Sizes that a link allows."""
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def hub_pairs(sigs: DataFrame) -> DataFrame:
    """Each set with the hub that it meets in most signatures.

    This only saves comparisons: sets that it leaves apart are compared later.
    """
    hubs = sigs.groupBy("sig").agg(F.min(F.struct("set_id", "n_shingles")).alias("hub"), F.max("set_id").alias("last")).where("hub.set_id < last").select("sig", F.col("hub.set_id").alias("a"), F.col("hub.n_shingles").alias("a_n"))
    met = sigs.join(hubs, "sig").where((F.col("set_id") != F.col("a")) & _close("n_shingles", "a_n"))
    times = met.groupBy("set_id", "a").count()
    return times.groupBy("set_id").agg(F.max(F.struct("count", "a")).alias("x")).select("x.a", F.col("set_id").alias("b"))


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Common shingles of all x with all y, as products of 0/1 matrices."""
    values, which = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    n_x = sum(map(len, x))
    both = np.zeros(len(values), bool)
    both[which[:n_x]] = True
    there = np.zeros(len(values), bool)
    there[which[n_x:]] = True
    column = np.cumsum(both & there) - 1
    column[~(both & there)] = -1
    column = column[which]
    row = np.concatenate([np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)])
    out = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        mine = (column >= a) & (column < a + COLUMNS)
        parts = []
        for side, size in ((slice(0, n_x), len(x)), (slice(n_x, None), len(y))):
            m = np.zeros((size, COLUMNS), np.float32)
            m[row[side][mine[side]], column[side][mine[side]] - a] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _linked(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    same = overlaps(x, y)
    n_x, n_y = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    return 100 * same >= THRESHOLD * (n_x[:, None] + n_y[None, :] - same)


def _compare(table: pa.Table) -> pa.Table:
    """Links within the lists of one group, or between two tiles of it, as one forest.

    Lists are taken one by one, so sets that share none are never compared; links that
    several lists find leave once, so a group gives fewer rows than it has sets.
    """
    sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
    ids, tile = table.column("set_id").to_numpy(), table.column("tile").to_numpy()
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    lists: dict[int, list[int]] = {}
    for k, own in enumerate(table.column("lists").to_pylist()):
        for sig in own:
            lists.setdefault(sig, []).append(k)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for members in {tuple(x) for x in lists.values()}:
        own = np.array(members)
        left, right = own[tile[own] == one], own[tile[own] == two]
        if len(left) and len(right) and len(own) > 1:
            new = spanning(_linked([sets[k] for k in left], [sets[k] for k in right]), ids[left], ids[right])
            a, b = np.concatenate([a, new[0]]), np.concatenate([b, new[1]])
            if len(a) > FOREST_ROWS:
                a, b = forest(a, b)
    a, b = forest(a, b)
    release()
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])


def meetings(sigs: DataFrame) -> DataFrame:
    """Where sets of different components that share a signature are compared.

    ``sigs``: sig, set_id, component. The list of a signature is the sets that have it.
    Lists of one component need no comparison, and of lists with the same members (known
    by their number and 128 bits) one is enough. Lists that have the same smallest member
    are one group, and so are all lists of a family, sets that meet directly or through
    others, if it is no larger than a tile: a set is sent to a group once, with the lists
    that it is in. A larger group is cut into tiles; members of its largest component need
    not be compared with each other, so their tiles meet only those of the rest.
    Result: (group, one, two, tile, set_id, lists), a comparison per (group, one, two).
    """
    lists = sigs.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("all"), F.min("set_id").alias("hub"), F.bit_xor(F.xxhash64("set_id")).alias("f1"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("f2"))
    lists = lists.where("x < y").groupBy("all", "f1", "f2").agg(F.min(F.struct("sig", "hub")).alias("x")).select("x.sig", "x.hub")
    met = materialize(sigs.join(lists, "sig").select("sig", "hub", "set_id", "component"), "lists")
    families = components(met.select(F.col("set_id").alias("src"), F.col("hub").alias("dst"))).select(F.col("node").alias("set_id"), F.col("component").alias("family"))
    small = families.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= TILE_SETS).select("family")
    met = met.join(families.join(small, "family"), "set_id", "left").withColumn("group", F.coalesce("family", "hub"))
    members = met.groupBy("group", "set_id").agg(F.any_value("component").alias("component"), F.collect_list("sig").alias("lists"))
    members = materialize(members, "meetings")
    sizes = members.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"))
    of_group = sizes.groupBy("group").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main")).where(F.col("all") > TILE_SETS).select("group", "all", F.col("main.n").alias("n_main"), F.col("main.component").alias("main"))
    tiles = lambda n: F.ceil(n / TILE_SETS).cast("int")
    hashed = F.xxhash64("set_id")
    placed = members.join(of_group, "group", "left").withColumn("mains", tiles(F.col("n_main"))).withColumn("rest", tiles(F.col("all") - F.col("n_main")))
    whole, is_main = F.col("all").isNull(), F.col("component") == F.col("main")
    placed = placed.withColumn("tile", F.when(whole, 0).when(is_main, F.pmod(hashed, "mains")).otherwise(F.col("mains") + F.pmod(hashed, F.greatest("rest", F.lit(1)))).cast("int"))
    last = F.col("mains") + F.col("rest") - 1
    partners = F.when(whole, F.array(F.lit(0))).when(is_main, F.when(F.col("rest") > 0, F.sequence("mains", last)).otherwise(F.array().cast("array<int>"))).otherwise(F.sequence(F.lit(0), last))
    paired = placed.withColumn("partner", F.explode(partners))
    return paired.select("group", F.greatest("tile", "partner").alias("one"), F.least("tile", "partner").alias("two"), "tile", "set_id", "lists")


def cross_links(sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """A forest of all links between sets of different components that share a signature."""
    return meetings(sigs).join(sets, "set_id").groupBy("group", "one", "two").applyInArrow(_compare, "src long, dst long")


def _placed(sigs: DataFrame, found: DataFrame) -> DataFrame:
    return sigs.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    size = corpus_size(docs)
    blocks = in_blocks(docs.select(F.col("doc_id").cast("long"), "text"), size)
    answers = totals(blocks, _block_keys, size)
    table = materialize(with_totals(blocks, answers, _index, TABLE_SCHEMA), "shingle-index")
    rows = table.where("kind = 0").select("doc_id", "set_id", "n_shingles")
    sigs = table.where("kind = 1").select("sig", "set_id", "n_shingles").distinct()
    found = table.where("kind = 2").select("set_id", "block", "shingles")
    # one of the blocks that have the set, settled without its shingles
    sets = found.join(found.groupBy("set_id").agg(F.min("block").alias("block")), ["set_id", "block"]).select("set_id", "shingles")
    links = materialize(verified(hub_pairs(sigs), sets), "hub-links")
    more = materialize(cross_links(_placed(sigs, components(links)), sets), "cross-links")
    whole = components(links.union(more)).withColumnRenamed("node", "set_id")
    return with_least(rows, whole)


def with_least(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id from rows (doc_id, set_id, n_shingles) and (set_id, component).

    Copies collapse to their set before sets meet their component, and a component's
    sets are dealt over ``SALTS`` keys, so no component's documents meet in one task.
    """
    of_set = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    placed = of_set.join(whole, "set_id").withColumn("salt", F.pmod(F.xxhash64("set_id"), F.lit(SALTS)).cast("int"))
    least = placed.groupBy("component", "salt").agg(F.min("least").alias("least")).groupBy("component").agg(F.min("least").alias("component_least"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = placed.join(salted, ["component", "salt"]).select("set_id", "component_least")
    ids = of_set.join(found, "set_id", "left").select("set_id", F.coalesce("component_least", "least").alias("least"))
    out = rows.join(ids, "set_id", "left")
    return out.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
