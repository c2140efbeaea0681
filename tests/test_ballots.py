"""Ragged label spaces on a small table: shared labels, a group without calibration, ties, nulls, empty tables."""

import math

import pytest

from folio.operators import ballots as B


def test_sets_are_unions_over_candidate_groups(spark):
    z = {1: [2.0, 1.0, 0.0, None], 2: [0.0, 0.0, 0.0, 5.0], 3: [1.0, 1.0, 3.0, 1.0]}
    logits = spark.createDataFrame([(i, k, v) for i, row in z.items() for k, v in enumerate(row)], "id long, k int, z double")
    ballots = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 2), ("b", 3), ("c", 3), ("a", 0)], "g string, k int")
    p = B.ballot_probabilities(logits, ballots, "id", "g", "k", "z")
    got = {(r.id, r.g, r.k): r.p for r in p.collect()}
    for (i, g, k), v in got.items():
        own = [x for h, x in (("a", 0), ("a", 1), ("b", 1), ("b", 2), ("b", 3), ("c", 3)) if h == g and z[i][x] is not None]
        assert v == pytest.approx(math.exp(z[i][k]) / sum(math.exp(z[i][x]) for x in own))
    assert len(got) == 3 * 6 - 2 and (1, "c", 3) not in got
    bank = spark.createDataFrame([("a", 0.5), ("b", 0.3)], "g string, qhat double")  # c holds every label
    candidates = spark.createDataFrame([("x", 1, "a"), ("x", 1, "b"), ("x", 2, "c"), ("x", 3, "b"), ("y", 2, "a"), ("y", 1, "c")], "policy string, id long, g string")
    sets = {(r.policy, r.id): (r.n_groups, r.set) for r in B.ballot_sets(p, bank, candidates, "id", "g", "k").collect()}
    assert sets == {("x", 1): (2, [0, 1]), ("x", 2): (1, [3]), ("x", 3): (1, [2]), ("y", 2): (1, [0, 1]), ("y", 1): (1, [])}
    truth = spark.createDataFrame([(1, 1), (2, 3), (3, 0)], "id long, k int")
    report = {r.policy: r.asDict() for r in B.policy_report(B.ballot_sets(p, bank, candidates, "id", "g", "k"), truth, "id", "k").collect()}
    assert report["x"]["coverage"] == pytest.approx(2 / 3) and report["y"] == {"policy": "y", "n": 2, "coverage": 0.0, "groups_read": 1.0, "avg_size": 1.0, "singleton": 0.0, "empty": 0.5}


def test_thresholds_by_group(spark):
    p = spark.createDataFrame([(i, g, 0, (i + 1) / 100) for i in range(40) for g in "ab"], "id long, g string, k int, p double")
    truth = spark.createDataFrame([(i, "a" if i < 30 else "b", 0) for i in range(38)], "id long, g string, k int")
    got = {r.g: (r.n, r.qhat) for r in B.ballot_thresholds(p, truth, "id", "g", "k", [0.2]).collect()}
    assert got["a"][0] == 30 and got["a"][1] == pytest.approx(sorted(1 - (i + 1) / 100 for i in range(30))[25])
    assert got["b"][0] == 8 and got["b"][1] == pytest.approx(1 - 31 / 100)
    assert B.ballot_thresholds(p, truth.limit(0), "id", "g", "k", [0.2]).count() == 0


def test_policies_read_the_groups_they_name(spark):
    groups = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.45), (1, "c", 0.05), (2, "a", 0.8), (2, "b", 0.2), (3, "b", 0.5), (3, "a", 0.5), (4, "a", 0.3)], "id long, g string, s double")
    got = {}
    for r in B.policies(groups, "id", "g", "s", 0.4, 0.1, 0.56).collect():
        got.setdefault(r.policy, {}).setdefault(r.id, []).append(r.g)
    got = {p: {i: "".join(sorted(x)) for i, x in own.items()} for p, own in got.items()}
    assert got == {"top": {1: "a", 2: "a", 3: "a", 4: "a"}, "borderline": {1: "ab", 2: "a", 3: "ab", 4: "a"}, "set": {1: "ab", 2: "a", 3: "ab", 4: "a"}, "all": {1: "abc", 2: "ab", 3: "ab", 4: "a"}}
    assert B.policies(groups.limit(0), "id", "g", "s", 0.4, 0.1).count() == 0
