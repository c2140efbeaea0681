"""What counting the n-grams of a block costs, and the order it rests on."""

import time

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import lmscore
from folio.llm.blockcounts import _narrow
from folio.llm.bytehash import Words


def least_seconds(run, times=5):
    """CPU seconds of the fastest of a few runs."""

    def once():
        began = time.process_time()
        run()
        return time.process_time() - began

    return min(once() for _ in range(times))


def test_counting_costs_little_more_than_hashing():
    """To line totals up with the n-grams of this block took 7.6 times what its distinct ones take, then 1.7 times."""
    rng = np.random.default_rng(9)
    texts = pa.table({"text": [" ".join(f"w{k}" for k in rng.zipf(1.2, 500) % 100_000) for _ in range(1500)]})

    def distinct():
        words = Words(texts.column("text"), lower=True)
        return np.unique(np.concatenate([words.windows(n)[0] for n in (1, 2)]), return_counts=True)

    total = distinct()[1]
    answers = pa.table({"_bucket": pa.array([0], pa.int32()), "totals": pa.array([_narrow(total)]), "level": pa.array([2], pa.int32())})
    assert least_seconds(lambda: lmscore._known(texts, answers, 2, True)) < 4 * least_seconds(distinct)


@pytest.mark.parametrize("keys", [
    [],
    [7],
    [5, 3, 5, 3, 5],
    [2**64 - 1, 0, 2**63, 2**64 - 1, 0],
    # equal but for the bits that hold places, out of order and repeated
    [2**40 + k for k in (3, 1, 2, 3, 0, 1)] + [9, 2**63 + 2, 2**63, 2**63 + 1, 2**63],
])
def test_places_in_order_of_keys(keys):
    keys = np.array(keys, np.uint64)
    places, there = lmscore.in_order(keys)
    assert places.tolist() == np.argsort(keys, kind="stable").tolist()
    assert there.tolist() == sorted(keys.tolist())


def test_places_in_order_of_many_keys():
    rng = np.random.default_rng(10)
    for top in (50, 1 << 12, 1 << 20, 1 << 63):
        keys = rng.integers(0, top, 20_000).astype(np.uint64)
        places, there = lmscore.in_order(keys)
        assert (places == np.argsort(keys, kind="stable")).all() and (there == np.sort(keys)).all()
