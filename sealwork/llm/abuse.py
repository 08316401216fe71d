"""Abusive text in documents (problem 9): a convolutional classifier in numpy.

Text is undone of disguises (letters of other scripts, leet, spaced or repeated letters, escapes) and cut into words. A word is
the mean of hashed embeddings of itself and its letter groups; filters over one to four words in a row, their largest value
over the whole text and a logistic layer give the score. It is fitted on a bounded sample of doc_labels; scores are for whole texts.
"""

from __future__ import annotations

import base64
import binascii
import html
import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sample: at most so many labelled documents, by hash of doc_id; texts longer than SAMPLE_CHARS are scored but not learned from.
SAMPLE_DOCS = 5000
SAMPLE_CHARS = 100_000
HASHED, GRAMS, DIM = 1 << 15, 12, 24
#: Filters of each width, narrow ones first: filter f looks at 1 + f // OF_WIDTH words in a row.
WIDTH, OF_WIDTH = 4, 12
FILTERS = WIDTH * OF_WIDTH
STEPS, BATCH_DOCS, FOLDS = 1000, 48, 2
#: A language has a threshold of its own from so many positive labels on; others share one.
LANGUAGE_POSITIVES = 25
#: With fewer positive labels than this no threshold can be told from scores; it is 0.5.
LEAST_POSITIVES = 5
#: Places of a text over which filters are laid at once, and words a task keeps.
PLACES = 1 << 15
KEPT_WORDS = 200_000
_ALIKE = str.maketrans("авекмнорстухіјѕԁɡһӏԛԝοανιρτυκεχ", "abekmhopctyxijsdghlqwoaviptukex")
_ALIKE.update(str.maketrans("асеорхуіјѕ", "aceopxyijs"))
_LEET = str.maketrans("013457@$!", "oieastasi")
_TOKEN = re.compile(r"[^\W_](?:[^\W_]|[@$!](?=[^\W_]))*|[@$](?:[^\W_]|[@$!](?=[^\W_]))+")
_UNICODE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_BREAK = re.compile(r"\\+[nrt]")
_HIDDEN = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}={0,2}")
_HUMPS = re.compile(r"[a-z]{2,}(?:[A-Z][a-z]+){2,}$|(?:[A-Z][a-z]+){3,}$")
_REPEAT = re.compile(r"(\w)\1\1+")
_LATIN = re.compile(r"[a-z]")


def _plain(m: re.Match) -> str:
    try:
        text = base64.b64decode(m[0], validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError):
        return m[0]
    return f" {text} " if text.isprintable() and " " in text else m[0]


def _word(token: str) -> str:
    w = unicodedata.normalize("NFKC", token).lower()
    if not w.isascii():
        folded = w.translate(_ALIKE)
        w = folded if _LATIN.search(w) or folded.isascii() else w
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    stem = w.rstrip("0123456789")
    if len(stem) >= 3 and stem.isalpha():
        w = stem
    elif not w.isalpha():
        if w.startswith("0x") or not any(c.isalpha() for c in w):
            return ""
        w = w.translate(_LEET)
    return _REPEAT.sub(r"\1", w)


def words_of(text: str, known: dict[str, str] | None = None) -> list[str]:
    """Words in reading order, undone of disguises; numbers are no words. known: tokens seen before."""
    known = {} if known is None else known
    if "\\" in text:
        text = _BREAK.sub(" ", _UNICODE.sub(lambda m: chr(int(m[1] or m[2], 16)), text))
    if "&" in text:
        text = html.unescape(text)
    text = _BASE64.sub(_plain, text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    out: list[str] = []
    spelt: list[str] = []
    for token in _TOKEN.findall(text):
        w = known.get(token)
        if w is None:
            w = " ".join(_word(x) for x in re.findall(r"[A-Z]?[a-z]+", token)) if _HUMPS.match(token) else _word(token)
            if len(known) < 500_000:
                known[token] = w
        if len(w) == 1:
            spelt.append(w)
            continue
        if spelt:
            out += ["".join(spelt)] if len(spelt) > 3 else spelt
            spelt = []
        if w:
            out += w.split(" ") if " " in w else [w]
    return out + (["".join(spelt)] if len(spelt) > 3 else spelt)


def features(word: str) -> list[int]:
    """Hashes of a word and its groups of four letters, -1 beyond the end."""
    w = f"<{word[:24]}>"
    grams = [w, *(f"g{w[i : i + 4]}" for i in range(max(0, len(w) - 3)))][:GRAMS]
    return [zlib.crc32(g.encode()) % HASHED for g in grams] + [-1] * (GRAMS - len(grams))


@dataclass
class Model:
    table: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.conv, self.conv_bias, self.out, self.out_bias]


def _mask() -> np.ndarray:
    """1 where a filter is wide enough for the tap of a row of conv."""
    return np.repeat(np.arange(WIDTH)[:, None] <= np.arange(FILTERS) // OF_WIDTH, DIM, axis=0).astype("float32")


def start(seed: int) -> Model:
    r = np.random.default_rng(seed)
    return Model(*(x.astype("float32") for x in (r.normal(0, 0.3, (HASHED, DIM)), r.normal(0, 0.25, (WIDTH * DIM, FILTERS)) * _mask(), np.zeros(FILTERS), r.normal(0, 0.2, FILTERS), np.full(1, -2.0))))


class Encoder:
    """Numbers words and keeps their features."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[list[int]] = []
        self.known: dict[str, str] = {}

    def encode(self, text: str | None) -> np.ndarray:
        out = []
        for w in words_of(text or "", self.known):
            i = self.ids.get(w)
            if i is None:
                i = self.ids[w] = len(self.rows)
                self.rows.append(features(w))
            out.append(i)
        return np.array(out, "int32")


def _vectors(m: Model, feats: np.ndarray) -> np.ndarray:
    there = (feats >= 0).astype("float32")
    return np.einsum("vg,vgd->vd", there, m.table[feats]) / there.sum(axis=1, keepdims=True)


def _activations(m: Model, taps: list[np.ndarray], words: np.ndarray, n: int) -> np.ndarray:
    act = taps[0][words[:n]]
    for k in range(1, WIDTH):
        act[:, k * OF_WIDTH :] += taps[k][words[k : k + n]]
    act += m.conv_bias
    return act


def _taps(m: Model, vec: np.ndarray) -> list[np.ndarray]:
    """What each word adds to the filters that are wide enough, by place in the filter."""
    return [vec @ m.conv[k * DIM : (k + 1) * DIM, k * OF_WIDTH :] for k in range(WIDTH)]


def _forward(m: Model, docs: list[np.ndarray], feats: np.ndarray) -> tuple:
    """Logits of docs (word numbers into feats); a text is framed by WIDTH - 1 empty words on either side."""
    blank = len(feats)
    gap = np.full(WIDTH - 1, blank, "int32")
    words = np.concatenate([x for d in docs for x in (gap, d)] + [gap])
    first = np.cumsum([0] + [len(d) + WIDTH - 1 for d in docs])[:-1]
    vec = np.concatenate([_vectors(m, feats), np.zeros((1, DIM), "float32")])
    act = _activations(m, _taps(m, vec), words, len(words) - WIDTH + 1)
    top = np.maximum.reduceat(act, first, axis=0)
    pooled = np.maximum(top, 0)
    return pooled @ m.out + m.out_bias, pooled, act, top, words, first, vec


def fit(docs: list[np.ndarray], labels: np.ndarray, feats: np.ndarray, seed: int = 9, steps: int = STEPS) -> Model:
    """Adam on the logistic loss; words are left out at random, so that no single one is learned by heart."""
    full, rng = start(seed), np.random.default_rng(seed)
    held = np.unique(feats[feats >= 0])
    compact = np.where(feats >= 0, np.searchsorted(held, np.maximum(feats, 0)), -1)
    m = Model(full.table[held], full.conv, full.conv_bias, full.out, full.out_bias)
    mean, square = [np.zeros_like(p) for p in m.parts()], [np.zeros_like(p) for p in m.parts()]
    order, mask = np.zeros(0, int), _mask()
    for step in range(1, steps + 1):
        if len(order) < min(BATCH_DOCS, len(docs)):
            order = rng.permutation(len(docs))
        some, order = order[:BATCH_DOCS], order[BATCH_DOCS:]
        kept = [d[rng.random(len(d)) > 0.15] for d in (docs[i] for i in some)]
        used, numbers = np.unique(np.concatenate(kept), return_inverse=True)
        if not len(used):
            continue
        cut = np.split(numbers.astype("int32"), np.cumsum([len(d) for d in kept])[:-1])
        f = compact[used]
        logit, pooled, act, top, words, first, vec = _forward(m, cut, f)
        g = ((1 / (1 + np.exp(-logit)) - labels[some]) / len(some)).astype("float32")
        drop = ((rng.random(pooled.shape) > 0.3) / 0.7).astype("float32")
        g_pool = (g[:, None] * m.out) * (top > 0) * drop
        ends = np.append(first[1:], len(act))
        at = np.stack([a + act[a:b].argmax(axis=0) for a, b in zip(first, ends)])
        g_conv, g_vec = np.zeros_like(m.conv), np.zeros_like(vec)
        for k in range(WIDTH):
            w, tap = words[at + k], slice(k * DIM, (k + 1) * DIM)
            spread = np.bincount((w * FILTERS + np.arange(FILTERS)).ravel(), weights=g_pool.ravel(), minlength=len(vec) * FILTERS).reshape(-1, FILTERS).astype("float32")
            g_conv[tap] = vec.T @ spread
            g_vec += spread @ m.conv[tap].T
        there = f >= 0
        rows, touched = np.nonzero(there)
        g_table = np.zeros_like(m.table)
        np.add.at(g_table, f[rows, touched], (g_vec[:-1] / there.sum(axis=1)[:, None]).astype("float32")[rows])
        grads = [g_table, g_conv * mask + 1e-4 * m.conv, g_pool.sum(axis=0), (pooled * drop).T @ g + 1e-3 * m.out, g.sum(keepdims=True)]
        for j, (p, d) in enumerate(zip(m.parts(), grads)):
            mean[j] = 0.9 * mean[j] + 0.1 * d
            square[j] = 0.999 * square[j] + 0.001 * d * d
            p -= (0.004 * (mean[j] / (1 - 0.9**step)) / (np.sqrt(square[j] / (1 - 0.999**step)) + 1e-8)).astype("float32")
    full.table[held] = m.table
    return Model(full.table, *m.parts()[1:])


def logits(m: Model, docs: list[np.ndarray], feats: np.ndarray) -> np.ndarray:
    """Logits over whole texts of any length."""
    vec = np.concatenate([_vectors(m, feats), np.zeros((1, DIM), "float32")])
    taps = _taps(m, vec)
    gap = np.full(WIDTH - 1, len(feats), "int32")
    words = np.concatenate([x for d in docs for x in (gap, d)] + [gap])
    owner = np.repeat(np.arange(len(docs)), [len(d) + WIDTH - 1 for d in docs])
    top = np.full((len(docs), FILTERS), -np.inf, "float32")
    for s in range(0, len(owner), PLACES):
        mine = owner[s : s + PLACES]
        act = _activations(m, taps, words[s:], len(mine))
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        top[mine[first]] = np.maximum(top[mine[first]], np.maximum.reduceat(act, first, axis=0))
    return np.maximum(top, 0) @ m.out + m.out_bias


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of the largest F1, half way to the next score below; 0.5 if fewer than LEAST_POSITIVES labels are positive."""
    if labels.sum() < LEAST_POSITIVES:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = 0
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])


def language(lang: str | None) -> str:
    return (lang or "").strip().lower()


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, str, int]]:
    """(lang, text, label) of at most SAMPLE_DOCS documents on which most reviewers agree; ties and null ratings are no label."""
    votes = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id", "reviewer").agg(F.max_by("abusive", "rated_at").alias("abusive"))
    agreed = votes.groupBy("doc_id").agg(F.avg("abusive").alias("share")).where("share <> 0.5")
    some = agreed.select("doc_id", (F.col("share") > 0.5).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = docs.where(f"length(text) <= {SAMPLE_CHARS}").join(F.broadcast(some), "doc_id").select("doc_id", "lang", "text", "label").collect()
    return [(language(r["lang"]), r["text"], r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def train(spark: SparkSession, sample: list[tuple[str, str, int]], steps: int = STEPS) -> tuple[Model, dict[str, float], float] | None:
    """Model, thresholds per language and the threshold of all others; None if the sample lacks either label.

    Thresholds are those of the largest F1 on scores by models that have not seen the document; each model is fitted in a task of its own.
    """
    labels = np.array([y for _, _, y in sample], "float32")
    if len(set(labels.tolist())) < 2:
        return None
    fold = np.zeros(len(sample), int)
    for y in (0, 1):
        of = np.flatnonzero(labels == y)
        fold[of] = np.arange(len(of)) % FOLDS
    parts = [n for n in range(FOLDS) if 0 < labels[fold != n].sum() < (fold != n).sum() and (fold == n).any()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder()
        for n in (n for f in frames for n in f["id"].tolist()):
            docs = [enc.encode(t) for _, t, _ in sample]
            feats = np.array(enc.rows, "int64").reshape(-1, GRAMS)
            seen = np.flatnonzero(fold != n)
            m = fit([docs[i] for i in seen], labels[seen], feats, steps=steps)
            yield pd.DataFrame({"fold": [n], "out": [pickle.dumps(m if n == FOLDS else logits(m, [docs[i] for i in np.flatnonzero(fold == n)], feats))]})

    tasks = spark.createDataFrame([(n,) for n in (*parts, FOLDS)], "id int").repartitionByRange(len(parts) + 1, "id")
    got = {r["fold"]: pickle.loads(r["out"]) for r in tasks.mapInPandas(run, "fold int, out binary").collect()}
    scores = np.full(len(sample), np.nan)
    for n in parts:
        scores[fold == n] = 1 / (1 + np.exp(-got[n].astype(float)))
    known = ~np.isnan(scores)
    langs = np.array([x for x, _, _ in sample])
    common = best_threshold(scores[known], labels[known]) if known.any() else 0.5
    own = {x: best_threshold(scores[w], labels[w]) for x in sorted(set(langs.tolist())) if labels[w := known & (langs == x)].sum() >= LANGUAGE_POSITIVES}
    return got[FOLDS], own, common


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, lang, score, threshold, abusive), one row per document; null or blank text scores 0.

    Without labels of both kinds nothing can be learned; score, threshold and abusive are then null.
    """
    trained = train(docs.sparkSession, labelled_sample(docs, labels))
    if trained is None:
        return docs.select("doc_id", "source", "lang", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("boolean").alias("abusive"))
    model, own, common = trained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder()
        for b in batches:
            texts, score = b.column("text").to_pylist(), np.zeros(b.num_rows)
            todo: list[tuple[int, np.ndarray]] = []

            def settle() -> None:
                if todo:
                    got = logits(model, [d for _, d in todo], np.array(enc.rows, "int64").reshape(-1, GRAMS))
                    score[[i for i, _ in todo]] = 1 / (1 + np.exp(-got.astype(float)))
                    todo.clear()

            for i, text in enumerate(texts):
                d = enc.encode(text)
                if len(d):
                    todo.append((i, d))
                if len(enc.rows) > KEPT_WORDS:
                    settle()
                    enc = Encoder()
            settle()
            limit = np.array([own.get(language(x), common) for x in b.column("lang").to_pylist()], float)
            columns = [b.column("doc_id"), b.column("source"), b.column("lang"), pa.array(score), pa.array(limit), pa.array(score >= limit)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "lang", "score", "threshold", "abusive"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id bigint, source string, lang string, score double, threshold double, abusive boolean")


def source_rates(scores: DataFrame) -> DataFrame:
    """(source, documents, found, rate, mean_score), documents without a source under null."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("abusive").alias("found"), F.avg(F.col("abusive").cast("int")).alias("rate"), F.avg("score").alias("mean_score"))
