"""Problem 4: all descendants over all parents, against a plain search."""

import random

import pytest
from tests import brute
from sealwork.operators import hierarchy
from sealwork.plans import problems
from sealwork.session import Scratch


LOCALITY = ["session_id", "ingested_at"]


def table(spark, links):
    return spark.createDataFrame([(n, p, "s", i) for i, (n, p) in enumerate(links)], "node string, parents array<string>, session_id string, ingested_at long")


def test_descendants_over_all_parents(spark):
    r = random.Random(4)
    links = [(f"n{i}", [f"n{r.randrange(max(0, i - 9), i)}" for _ in range(r.choice([0, 1, 1, 2, 3]))] if i else None) for i in range(80)]
    links += [("a", ["c"]), ("b", ["a", "top"]), ("c", ["b"]), ("low", ["c", "n3", "absent", " ", None]), ("self", ["self"]), ("n5", ["n1"]), (None, ["n1"])]
    links += [(f"chain{i}", [f"chain{i - 1}"] if i else []) for i in range(37)] + [("top", [])]
    parents = {}
    for n, ps in links:
        parents.setdefault(n, set()).update(ps or [])
    want = set()
    for n in parents.keys() - {None}:
        seen, todo = set(), list(parents[n])
        while todo:
            p = todo.pop()
            if p in parents and p is not None and p not in seen:
                seen.add(p)
                todo += parents[p]
        want |= {(p, n) for p in seen if p != n}
    for rows in (1000, 60):
        got = [tuple(x) for x in hierarchy.descendants(table(spark, links), Scratch(spark, "test"), LOCALITY, block_rows=rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def found(out):
    rows = {(x["node"], x["root"], x["depth"]) for x in out["assigned"].collect() if x["node"] != x["root"]}
    return rows | {(x["node"], x["root"], -1) for x in out["looped"].collect()}


def mixed(seed, n):
    """Descents, rings in one another's way, chains between rings, self links, dirty parents."""
    r = random.Random(seed)
    links = [(f"n{i:03}", [f"n{r.randrange(max(0, i - 9), i):03}" for _ in range(r.choice([0, 1, 1, 2]))] if i else None) for i in range(n)]
    links += [(f"q{i}", [f"q{(i + 1) % 7}"]) for i in range(7)] + [("q3", ["n004"]), ("n050", ["q5"]), ("n030", ["n045"]), ("s", ["s", "", " ", None, "absent"]), ("t", ["s"]), (None, ["s"])]
    links += [(f"k{i}", [f"k{i - 1}"] if i else ["q2"]) for i in range(30)] + [("m0", ["k29", "m1"]), ("m1", ["m0"]), ("m2", ["m1"])]
    return links


RING = [(f"r{(i * 37) % 60:03}", [f"r{(i * 37 + 37) % 60:03}"]) for i in range(60)]


@pytest.mark.parametrize("name,links,block_rows", [
    ("empty", [], 1000), ("pair", [("a", ["b"]), ("b", ["a"])], 1000), ("self", [("a", ["a"])], 1000), ("chain", [(f"c{i:02}", [f"c{i - 1:02}"] if i else []) for i in range(60)], 25),
    ("ring", RING, 1000), ("ring", RING, 40), ("mixed", mixed(3, 60), 1000), ("mixed", mixed(3, 60), 60),
])
def test_found_against_brute_force(spark, name, links, block_rows):
    out = hierarchy.hierarchy(table(spark, links), Scratch(spark, "test"), LOCALITY, block_rows=block_rows)
    assert found(out) == brute.descents(links)


def test_descendant_counts(spark, tmp_path):
    links = [("r", []), ("x", ["r"]), ("y", ["r"]), ("z", ["x", "y"]), ("z", ["x"])]
    spark.createDataFrame([(n, p, "s", i) for i, (n, p) in enumerate(links)], "run_id string, parents array<string>, session_id string, ingested_at long").write.parquet(f"{tmp_path}/runs.parquet")
    assert {tuple(x) for x in problems.QUERIES["p4_descendant_counts"](spark, str(tmp_path)).collect()} == {("r", 3), ("x", 1), ("y", 1), ("z", 0)}
    assert problems.QUERIES["p4_descendants"](spark, str(tmp_path)).count() == 5


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_path_through_a_chain_that_leads_into_a_loop(spark, block_rows):
    links = [("r", []), ("a", ["r"]), ("b", ["a"]), ("l1", ["b", "l2"]), ("l2", ["l1"]), ("m", ["l2"]), ("o", ["m"]), ("p1", ["o", "p2"]), ("p2", ["p1"]), ("leaf", ["b"]), ("leaf2", ["leaf"]), ("below", ["o"])]
    out = hierarchy.hierarchy(table(spark, links), Scratch(spark, "test"), LOCALITY, block_rows=block_rows)
    rows = {}
    for x in sorted(out["assigned"].collect(), key=lambda x: (x["depth"], x["root"])):
        rows.setdefault(x["node"], x)
    pieces = spark.createDataFrame([(n, x["base"], x["seg"]) for n, x in rows.items()], "node string, base string, seg array<string>")
    path = {x["node"]: x["path"] for x in hierarchy.whole_paths(pieces, Scratch(spark, "test")).collect()}
    assert path == {"r": [], "a": ["r"], "b": ["r", "a"], "m": ["l2"], "o": ["l2", "m"], "leaf": ["r", "a", "b"], "leaf2": ["r", "a", "b", "leaf"], "below": ["l2", "m", "o"]}
    assert all(len(path[n]) == x["depth"] for n, x in rows.items())
