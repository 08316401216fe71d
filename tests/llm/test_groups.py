"""Problem 5 against union-find."""

import random
from collections import defaultdict

from sealwork.llm import groups
from sealwork.session import Scratch

SCHEMA = "basin_id string, scheme string, alias_id string, relation string, basin_id2 int"


def united(rows, meaningless):
    """rows: (basin_id, scheme, alias_id, relation) -> {(basin, group)}."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b, s, a, r in rows:
        if r == "same_as" and b is not None and s is not None and a is not None and a.strip().lower() not in meaningless:
            s, a = s.strip().lower(), a.strip().lower()
            up[find(("basin", b))] = find(("basin", a) if s == "aihydro" else (s, a))
    of = defaultdict(list)
    for k in list(up):
        if k[0] == "basin":
            of[find(k)].append(k[1])
    return {(b, min(g)) for g in of.values() if len(g) > 1 for b in g}


def run(spark, rows):
    out = groups.basin_groups(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), Scratch(spark, "test"))
    return {(x["basin_id"], x["group_id"]) for x in out.collect()}


def test_against_union_find(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        scheme = r.choice(["usgs", " USGS", "hydro", "aihydro "])
        alias = f"b{r.randrange(300):03}" if "ai" in scheme else r.choice([f"A{r.randrange(200)} ", f"a{r.randrange(200)}", "n/a", None, "", "-"])
        rows.append((f"b{r.randrange(300):03}", scheme, alias, r.choice(["same_as"] * 5 + ["located_at", None])))
    rows += [(f"p{i}", "usgs", "popular", "same_as") for i in range(120)] + [(f"chain{i}", "aihydro", f"chain{i + 1}", "same_as") for i in range(40)] + [(None, "usgs", "a1", "same_as")]
    assert run(spark, rows) == united(rows, groups.MEANINGLESS)


def test_spelling_of_basin_ids(spark):
    rows = [("BASIN:Ab", "usgs", "1", "same_as"), ("Z", "aihydro", " basin:aB ", "same_as"), ("q", "aihydro", "New:ID", "same_as"), ("same", "aihydro", "SAME", "same_as")]
    assert run(spark, rows) == {("BASIN:Ab", "BASIN:Ab"), ("Z", "BASIN:Ab"), ("q", "new:id"), ("new:id", "new:id")}


def test_hub_is_salted_and_edges(spark):
    assert run(spark, []) == set()
    links = spark.createDataFrame([("hub", f"x{i}") for i in range(50)] + [("x1", "x1"), ("x1", "hub"), (None, "x2"), ("u", "v")], "a string, b string")
    out = {x["v"]: x["root"] for x in groups.connected_groups(links, Scratch(spark, "test"), links_per_salt=7).collect()}
    assert len({out[k] for k in out if k not in "uv"}) == 1 and out["u"] == out["v"] != out["hub"] and len(out) == 53
