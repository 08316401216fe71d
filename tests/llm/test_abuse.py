"""Problem 9: disguises, whole texts, scores for every document and rates per source."""

import datetime

import numpy as np

from sealwork.llm import abuse
from sealwork.llm.queries import QUERIES


def test_disguises():
    for text in ("you stupid clown", "y0u stup1d cl0wn", "you stu​pid c l o w n", "you_stupid_clown", "you stuuupid\n# CLOWN", "yоu stuрid clоwn"):
        assert abuse.words_of(text) == ["you", "stupid", "clown"], text


def test_filters_of_several_widths():
    m = abuse.start(1)
    tap = np.abs(m.conv.reshape(abuse.WIDTH, abuse.DIM, abuse.FILTERS)).sum(axis=1) > 0
    assert (tap.sum(axis=0) == 1 + np.arange(abuse.FILTERS) // abuse.OF_WIDTH).all()
    enc = abuse.Encoder()
    docs = [enc.encode(t) for t in ("you stupid clown", "note the mask", "read a file")]
    trained = abuse.fit(docs, np.array([1, 0, 0], "float32"), np.array(enc.rows), steps=20)
    assert ((np.abs(trained.conv.reshape(abuse.WIDTH, abuse.DIM, abuse.FILTERS)).sum(axis=1) > 0) == tap).all()


def test_long_text_scores_as_its_whole():
    enc = abuse.Encoder()
    long = enc.encode("abcd efgh " * 40_000 + "rare words here")
    feats, model = np.array(enc.rows), abuse.start(1)
    assert len(long) > 2 * abuse.PLACES
    assert np.allclose(abuse.logits(model, [long, long[-3:]], feats), abuse._forward(model, [long, long[-3:]], feats)[0], atol=1e-4)


def test_every_document_is_scored(spark):
    assert {"p9_found", "p9_scores", "p9_rates"} <= set(QUERIES)
    noise = ["sort the list", "read a file", "sum of all rows", "close the grid"]
    docs = [(i, f"{noise[i % 4]} {'you stupid clown' if i % 3 == 0 else 'note the mask'} {noise[i % 3]}", "a" if i % 2 else None, "C") for i in range(90)]
    docs += [(90, None, "b", None), (91, "  ", "b", "c"), (92, "x " * 1000 + "you stupid clown", "b", "c")]
    day = datetime.datetime(2024, 1, 1)
    labels = [(i, "r", int(i % 3 == 0), day) for i in range(60)] + [(60, "r", 1, day), (60, "s", 0, day), (61, "r", None, day)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string")
    y = spark.createDataFrame(labels, "doc_id bigint, reviewer string, abusive int, rated_at timestamp")
    out = {r["doc_id"]: r for r in abuse.scored(d, y).collect()}
    assert set(out) == set(range(93))
    assert {i for i, r in out.items() if r["abusive"]} == {i for i in range(90) if i % 3 == 0} | {92}
    assert out[90]["score"] == out[91]["score"] == 0
    rates = {r["source"]: (r["documents"], r["found"]) for r in abuse.source_rates(abuse.scored(d, y)).collect()}
    assert rates == {None: (45, 15), "a": (45, 15), "b": (3, 1)}
    assert {r["abusive"] for r in abuse.scored(d, y.where("abusive = 0")).collect()} == {None}
