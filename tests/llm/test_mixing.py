"""Problem 8: shares, repeats and the order of virtual finish times."""

from sealwork.llm import mixing
from sealwork.session import Scratch

SCHEMA = "doc_id bigint, source string, n_tokens bigint"


def mix(spark, docs, targets, budget=None):
    m, s = mixing.fair_mix(spark.createDataFrame(docs, SCHEMA), targets, Scratch(spark, "test"), budget)
    return m.collect(), {x["source"]: x for x in s.collect()}


def test_shares_and_repeats(spark):
    docs = [(i, "big", 10 + i % 7) for i in range(600)] + [(1000 + i, "small", 12) for i in range(20)] + [(2000, None, 5), (2001, "big", 0), (2002, "other", 50)]
    rows, shares = mix(spark, docs, [("big", 0.8, 1), ("small", 0.2, 4), ("absent", 0.0, 1)])
    used = {}
    for x in rows:
        used.setdefault(x["doc_id"], []).append(x["copy_no"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in used.values())
    assert max(len(v) for k, v in used.items() if k < 1000) == 1 and max(len(v) for v in used.values()) <= 4
    assert abs(shares["big"]["actual_share"] - 0.8) < 0.01 and abs(shares["small"]["actual_share"] - 0.2) < 0.01
    assert shares["other"]["n_used"] == 0 and shares[None]["n_docs"] == 1 and not {2000, 2001, 2002} & used.keys()
    # prefix sums against a plain walk in the order of finish time
    total = 0
    for x in sorted(rows, key=lambda x: (x["finish_time"], x["source"], x["doc_id"], x["copy_no"])):
        total += x["n_tokens"]
        assert x["end_tokens"] == total


def test_budget_beyond_supply_and_empty(spark):
    rows, shares = mix(spark, [(1, "a", 10), (2, "b", 10)], [("a", 0.5, 1), ("b", 0.5, 3)], budget=1000)
    assert sorted((x["doc_id"], x["copy_no"]) for x in rows) == [(1, 1), (2, 1), (2, 2), (2, 3)] and shares["b"]["actual_share"] == 0.75
    rows, shares = mix(spark, [], [("a", 1.0, 1)])
    assert rows == [] and shares["a"]["actual_share"] == 0


def test_token_counts_of_whole_texts(spark):
    texts = ["", None, "a b  c\n\n d", "x" * 5000 + " tail", "日本語 テキスト\t\tend ", "def f(x):\n    return x\r\n"]
    enc = mixing.encoder()
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    got = {x["doc_id"]: x["n_tokens"] for x in mixing.token_counts(docs).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
