"""Problem 2 against a plain version, at any part size."""

import random

import pytest

from sealwork.operators import history
from sealwork.session import Scratch
from tests import brute

SCHEMA = "claim_id string, revision int, revision_digest string, supersedes string, us bigint, content string"


def run(spark, rows, part):
    out = history.version_history(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), Scratch(spark, "test"), part=part).collect()
    assert len(out) == len({tuple(x) for x in out})
    return {tuple(x) for x in out}


def told_in_two_ways(seed):
    r = random.Random(seed)
    rows = []
    for c in "abcdef":
        before = ""
        for v in range(r.randrange(1, 12)):
            if r.random() < 0.15:
                continue
            ds = [f"d{r.randrange(4)}" for _ in range(r.choice([1, 2, 2, 3]))]
            for d in ds:
                rows += [(c, v, d, before, r.randrange(50))] * r.choice([1, 2])
            before = r.choice(ds)
    return rows


@pytest.mark.parametrize("part", [1, 2, 512])
def test_against_brute_force(spark, part):
    for seed in (1, 2):
        rows = told_in_two_ways(seed)
        assert run(spark, rows, part) == brute.history(rows)


@pytest.mark.parametrize("part", [1, 512])
def test_edges(spark, part):
    assert run(spark, [], part) == set()
    dirty = [(None, 0, "a", "", 1), ("c", None, "a", "", 1), ("c", 0, None, None, 5), ("c", 1, "", None, 7), ("c", 2, "z", "", None), ("c", 3, "y", "z", 9)]
    # a null digest is one of its own, like the empty one; an unreadable time ends the version before it at an unknown time
    assert run(spark, dirty, part) == {("c", 0, 5, None), ("c", 2, None, 9), ("c", 3, 9, -1)}
    # the earliest copy counts
    assert run(spark, [("c", 0, "a", "", 25), ("c", 0, "a", "", 20)], part) == {("c", 0, 20, -1)}
    # a conflict over two revisions is settled from its end
    chain = [("c", 0, "a", "", 10), ("c", 1, "b", "a", 20), ("c", 1, "B", "a", 21), ("c", 2, "e", "b", 30), ("c", 2, "E", "B", 31), ("c", 3, "f", "e", 40)]
    assert run(spark, chain, part) == {("c", 0, 10, 20), ("c", 1, 20, 30), ("c", 2, 30, 40), ("c", 3, 40, -1)}
