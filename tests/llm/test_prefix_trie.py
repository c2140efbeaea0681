"""The trie of conversations against a plain version, on awkward rows and with large subtries dealt out again."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from folio.llm import prefixtrie
from folio.llm.shared import materialize


def sequences(rows):
    """Rebuilt conversations by id; rows: (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + t[h:]
    return out


def brute(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(children), leaves, saved, sha))
    return sorted(out, key=repr)


def nodes(df, *sizes):
    turns = materialize(prefixtrie.turns_of(df), "turns")
    return sorted((tuple(r) for r in prefixtrie.trie(prefixtrie.rebuilt(turns), *sizes).select(prefixtrie.COLUMNS).collect()), key=repr)


def awkward(longest):
    rows = []
    for c in range(60):  # a common first turn, then few different ones, some conversations alike
        rows += [(c, 0, "user", "hello"), (c, 1, "assistant", f"hi {c % 2}"), (c, 2, "user", "é" * (c % 3)), *((c, 3 + k, "user", f"{c // 20} {k}") for k in range(c % 7))]
    rows += [(100 + k, t, "user", "same") for k in range(7) for t in range(6)]
    rows += [(203, None, None, None), (203, None, "user", "x"), (203, 4, "b", None), (203, 4, "a", "tie"), (203, 4, "a", "tie"), (207, 1, "", ""), (-3, 1, "user", "hello"), (-5, 0, "user", "hello"), (-5, 2, "user", "x"), (None, 1, "user", "x")]
    rows += [(305, t, "user", f"long {t}" * 50) for t in range(longest)] + [(306, t, "user", f"long {t}" * 50) for t in range(longest + 1)]
    rows += [(401, 0, "user:", "a"), (402, 0, "user", ":a")]
    return rows


@pytest.mark.parametrize("sizes", [(), (9, 5)])
def test_nodes_as_the_plain_version(spark, sizes):
    rows = awkward(7 if sizes else 400)
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, pos int, digest string").repartition(3)
    assert nodes(df, *sizes) == brute(sequences(rows))


@pytest.mark.parametrize("run", [7, 8192])
def test_equal_conversations_are_one_path(spark, monkeypatch, run):
    monkeypatch.setattr(prefixtrie, "RUN_IDS", run)
    rows = [(5 * k, t, "user", f"turn {t}") for k in range(200) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = materialize(prefixtrie.turns_of(df), "turns")
    assert prefixtrie.weighted_paths(prefixtrie.rebuilt(turns)).count() == 1
    assert nodes(df) == brute(sequences(rows))


def test_all_turnless_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(k, 0, "user", "x") for k in (6, 8) if zlib.crc32(str(k).encode()) % 9 > 0] or [(9, 0, "user", "x")]
    assert nodes(spark.createDataFrame(rows, schema)) == brute(sequences(rows))
    assert nodes(spark.createDataFrame([], schema)) == []
