"""Problem 7: exact leaks against a plain search, recall of the latent search, paraphrases, edges."""

import random

import numpy as np
import pytest

from sealwork.llm import leaks
from sealwork.session import Scratch

WORDS = [f"{a}{b}" for a in ("ro", "mi", "ta", "ke", "lu", "so", "ba", "ne") for b in ("ver", "sill", "gate", "pond", "ridge", "flume", "stone", "weir", "bank", "field")]


def frames(spark, docs):
    return spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, passage int")


def sets(seed=2):
    r = random.Random(seed)
    standing = " ".join(r.choice(WORDS) for _ in range(16))
    items = [(i, standing + " " + " ".join(r.choice(WORDS) for _ in range(60)) + f" give {40 + i} and {900 + i}") for i in range(12)]
    docs = []
    for k in range(60):
        item = items[k % 12][1].split()
        at, n = r.randrange(16, len(item) - 20), r.choice([9, 11, 12, 14, 20])
        part = item[at : at + n] if k % 3 else item[: r.choice([12, 16])]
        own = [r.choice(WORDS) for _ in range(r.choice([0, 5, 80]))]
        text = " ".join(own) + "\n# " + r.choice([" ", "\n//  ", "\\n "]).join(part).upper() + " . " + " ".join(reversed(own))
        docs.append((k, text))
    return items, docs


def brute(items, docs):
    runs = {}
    for i, t in items:
        w = leaks.words_of(t)
        for k in range(len(w) - 11):
            runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leaks.words_of(t)
        for k in range(len(w) - 11):
            own = runs.get(tuple(w[k : k + 12]), set())
            if len(own) == 1:
                out.add((d, next(iter(own))))
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_exact_leaks_against_plain_search(spark, shuffled):
    items, docs = sets()
    want = brute(items, docs)
    if shuffled:
        random.Random(1).shuffle(items)
    got = leaks.leaked_items(frames(spark, docs), items, Scratch(spark, "test"))
    assert want and {(x["doc_id"], x["item_id"]) for x in got.where("exact").collect()} == want


def test_rows_come_from_the_latent_search(spark):
    items, docs = sets()
    ix = leaks.index_items(items)
    held = leaks.document_passages(frames(spark, docs), ix.vocabulary).selectExpr("passage").distinct()
    size = len(ix.vocabulary)
    blind = np.zeros((size, 4), "float32")
    blind[0] = 1
    assert leaks.search(held, ix, np.ones(size), blind).where("exact").count() < leaks.search(held, ix, np.ones(size), np.eye(size, dtype="float32")).where("exact").count()


def test_sparse_products_equal_dense_ones():
    r = np.random.default_rng(1)
    rows = r.integers(-1, 9, (50, leaks.PASSAGE)).astype("int32")
    idf, q = r.random(9) + 0.5, r.normal(size=(9, 3))
    a = np.zeros((50, 9))
    for i, row in enumerate(rows):
        for w in row[row >= 0]:
            a[i, w] += idf[w]
    length = np.sqrt((a * a).sum(axis=1))
    assert np.allclose(leaks.lengths(rows, idf), length) and np.allclose(leaks.times(rows, idf, q), (a @ q) / length[:, None], atol=1e-5)


def test_paraphrase_with_and_without_answers(spark):
    items, _ = sets()
    w = items[3][1].split()
    plain = w[20:44]
    changed = [x if k % 8 else "otherwise" for k, x in enumerate(plain)]
    tail = w[-24:]
    wrong = [x if k % 8 else "otherwise" for k, x in enumerate(tail)]
    docs = [(1, " ".join(changed)), (2, " ".join(wrong)), (3, " ".join(wrong).replace("43", "51").replace("903", "77")), (4, " ".join(items[0][1].split()[:16])), (5, None), (6, "")]
    got = {(x["doc_id"], x["item_id"]) for x in leaks.leaked_items(frames(spark, docs), items, Scratch(spark, "test"), near=0.3, paraphrases=True).where("not exact").collect()}
    assert (1, 3) in got and not {d for d, _ in got} & {3, 4, 5, 6}


def test_edges(spark):
    assert leaks.leaked_items(frames(spark, []), [(1, "a " * 30)], Scratch(spark, "test")).count() == 0
    assert leaks.leaked_items(frames(spark, [(1, "a b")]), [], Scratch(spark, "test")).count() == 0
    table = spark.createDataFrame([(1, "x"), (2, None), (None, "y")], "item_id bigint, text string")
    assert leaks.read_items(table) == [(1, "x")]
    with pytest.raises(ValueError):
        leaks.read_items(table.where("item_id = 1").union(table.where("item_id = 1")), most=1)
