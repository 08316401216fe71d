"""Evaluation texts leaking into training text (problem 7): latent semantic retrieval.

Documents and items are cut into overlapping passages of words. A randomised SVD of the TF-IDF matrix of all document
passages, computed by distributed passes, spans a latent space; item passages are searched in it by cosine against every
distinct document passage. Only what comes near there is checked word by word: an exact run of words that no other item has,
or, for paraphrases, a long common subsequence and the item's answers (its numbers). Words and passages stay sparse: a passage
is projected by adding up the latent vectors of its words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealwork.session import Scratch

#: A run of RUN words is a leak. Any run lies whole in a passage: passages have PASSAGE words and begin every PASSAGE - RUN.
RUN = 12
PASSAGE = 24
RANK = 64
OVERSAMPLE = 16
#: Least cosine of a candidate; README gives the recall of the search against brute force.
NEAR = 0.4
PARAPHRASE_NEAR = 0.8
#: Common subsequence of a paraphrase, as a share of the rarity of the words of the item's passage, and share of the answers it must keep.
PARAPHRASE_SHARE = 0.7
PARAPHRASE_ANSWERS = 0.75
#: By so much the item's share must exceed that of any other item: what several items say alike is a standing phrase.
PARAPHRASE_AHEAD = 1.05
#: Evaluation sets beyond these are refused: their words and latent vectors (80 floats a word) are sent to every task.
MOST_ITEMS = 1_000_000
MOST_ITEM_WORDS = 2_000_000
MOST_VOCABULARY = 200_000

_ESCAPE = re.compile(r"\\+(?:n|r|u000[aAdD]|x0[aAdD])")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case; escapes of line breaks are no words."""
    return _WORD.findall(_ESCAPE.sub(" ", text).lower()) if "\\" in text else _WORD.findall(text.lower())


def windows(ids: np.ndarray, step: int = PASSAGE - RUN) -> np.ndarray:
    """Passages (rows of PASSAGE word ids, -1 beyond the end) such that every run of RUN words lies in one."""
    starts = np.arange(0, max(1, len(ids) - RUN + 1), step)
    padded = np.concatenate([ids, np.full(PASSAGE, -1, ids.dtype)])
    return padded[starts[:, None] + np.arange(PASSAGE)]


@dataclass
class ItemIndex:
    """Words, passages and unique runs of the evaluation items."""

    vocabulary: dict[str, int]
    items: np.ndarray
    passages: np.ndarray
    owner: np.ndarray
    run_hash: np.ndarray
    run_ids: np.ndarray
    run_owner: np.ndarray
    #: weight of each word: 0 if every item has it
    rarity: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: for each item the word ids of its answers
    answers: list[frozenset[int]] = field(default_factory=list)


_POWERS = np.array([pow(6364136223846793005, i, 1 << 64) for i in range(RUN)], "uint64")


def run_hashes(rows: np.ndarray) -> np.ndarray:
    """Hash of the run of RUN words at every place of every row."""
    x = (rows + 2).astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
    n = rows.shape[1] - RUN + 1
    return sum(x[:, i : i + n] * _POWERS[i] for i in range(RUN))


def index_items(items: list[tuple[int, str]]) -> ItemIndex:
    """Items with null or empty text have no passages and no runs; repeated ids are united."""
    texts = sorted((i, words_of(t)) for i, t in items if i is not None and t)
    if sum(len(w) for _, w in texts) > MOST_ITEM_WORDS:
        raise ValueError(f"evaluation items of more than {MOST_ITEM_WORDS} words")
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
    if len(vocabulary) > MOST_VOCABULARY:
        raise ValueError(f"evaluation items of more than {MOST_VOCABULARY} different words")
    names = sorted({i for i, _ in texts})
    number = {i: k for k, i in enumerate(names)}
    passages, owner = [np.zeros((0, PASSAGE), "int32")], []
    owners = defaultdict(set)
    for i, ws in texts:
        ids = np.array([vocabulary[w] for w in ws], "int32")
        p = windows(ids, RUN // 2)
        passages.append(p)
        owner += [number[i]] * len(p)
        for k in range(len(ids) - RUN + 1):
            owners[ids[k : k + RUN].tobytes()].add(number[i])
    runs = [(g, next(iter(o))) for g, o in owners.items() if len(o) == 1]
    ids = np.frombuffer(b"".join(g for g, _ in runs), "int32").reshape(-1, RUN)
    h = run_hashes(ids)[:, 0] if len(ids) else np.zeros(0, "uint64")
    order = np.argsort(h, kind="stable")
    number_word = {k for w, k in vocabulary.items() if w.isdigit() and len(w) > 1}
    answers: list[set[int]] = [set() for _ in names]
    for i, ws in texts:
        answers[number[i]] |= {vocabulary[w] for w in ws} & number_word
    holders = np.zeros(len(vocabulary))
    for w, _ in {(vocabulary[w], i) for i, ws in texts for w in ws}:
        holders[w] += 1
    rarity = np.log((len(names) + 1) / (holders + 1))
    return ItemIndex(
        vocabulary, np.array(names, "int64"), np.concatenate(passages), np.array(owner, "int64"), h[order], ids[order], np.array([o for _, o in runs], "int64")[order], rarity, [frozenset(x) for x in answers]
    )


def document_passages(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, passage) of whole texts: passages of which at least RUN words occur in items; others cannot hold a run of an item.

    passage: PASSAGE word ids as bytes, -1 for words that no item has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in batches:
            ids_out, out = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not text or doc is None:
                    continue
                ids = np.array([get(w, -1) for w in words_of(text)], "int32")
                if len(ids) < RUN or (ids >= 0).sum() < RUN:
                    continue
                rows = windows(ids)
                rows = rows[(rows >= 0).sum(axis=1) >= RUN]
                for p in {r.tobytes() for r in rows}:
                    ids_out.append(doc)
                    out.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids_out, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "passage"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, passage binary")


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("passage").to_pylist()), "int32").reshape(-1, PASSAGE)


def word_spread(passages: DataFrame, size: int) -> np.ndarray:
    """Number of passages (by their counts) that hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 1)
        for b in batches:
            rows = np.sort(_rows(b), axis=1)
            new = np.ones(rows.shape, bool)
            new[:, 1:] = rows[:, 1:] != rows[:, :-1]
            w = np.repeat(b.column("n").to_numpy()[:, None], PASSAGE, 1)
            n += np.bincount((rows + 1)[new], weights=w[new], minlength=size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(n[1:])], names=["word", "n"])

    got = passages.mapInArrow(run, "word bigint, n double").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size)
    for r in got:
        out[r["word"]] = r["n"]
    return out


BATCH = 2048


def lengths(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Length of the TF-IDF vector of each row; ids of -1 count nothing."""
    x = np.sort(rows, axis=1)
    weight = np.append(idf, 0.0)[x]  # -1 takes the last
    total = np.cumsum(weight, axis=1)
    last = np.ones(x.shape, bool)
    last[:, :-1] = x[:, 1:] != x[:, :-1]
    # count * idf of each word is the sum over its places; squares are taken where a word's places end
    out = np.zeros(len(x))
    before = np.zeros(len(x))
    for j in range(x.shape[1]):
        here = last[:, j]
        out[here] += (total[here, j] - before[here]) ** 2
        before[here] = total[here, j]
    return np.maximum(np.sqrt(out), 1e-9)


def times(rows: np.ndarray, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1, times q (words x width): the weighted vectors of the words are added up."""
    weighted = np.vstack([idf[:, None] * q, np.zeros((1, q.shape[1]))]).astype("float32")
    out = np.zeros((len(rows), q.shape[1]), "float32")
    for j in range(rows.shape[1]):
        out += weighted[rows[:, j]]
    return out / lengths(rows, idf)[:, None].astype("float32")


def gram_times(passages: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'A q for the TF-IDF matrix A of all passages: one distributed pass, partial sums per task added up by word blocks."""
    v, width = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros((v, width))
        for b in batches:
            every, n = _rows(b), b.column("n").to_numpy().astype("float32")
            for k in range(0, len(every), BATCH):
                rows = every[k : k + BATCH]
                z = times(rows, idf, q) * (n[k : k + BATCH] / lengths(rows, idf))[:, None]
                words = rows.ravel()
                order = np.argsort(words, kind="stable")
                order = order[np.searchsorted(words[order], 0) :]
                if not len(order):
                    continue
                held, first = np.unique(words[order], return_index=True)
                y[held] += idf[held, None] * np.add.reduceat(z[order // PASSAGE], first, axis=0)
        parts = [(s // 256, y[s : s + 256].tobytes()) for s in range(0, v, 256) if y[s : s + 256].any()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int64()), pa.array([y for _, y in parts], pa.binary())], names=["part", "y"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "y": [sum(np.frombuffer(y) for y in pdf["y"]).tobytes()]})

    got = passages.mapInArrow(run, "part bigint, y binary").groupBy("part").applyInPandas(add, "part bigint, y binary").collect()
    y = np.zeros((v, width))
    for r in got:
        y[r["part"] * 256 : r["part"] * 256 + 256] = np.frombuffer(r["y"]).reshape(-1, width)
    return y


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK, passes: int = 2, seed: int = 5) -> np.ndarray:
    """Right singular vectors (words x rank) by a randomised range finder with power passes over all passages."""
    v = len(idf)
    width = min(v, rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(v, width)))[0]
    for _ in range(passes):
        q = np.linalg.qr(gram_times(passages, idf, q))[0]
    small = q.T @ gram_times(passages, idf, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype("float32")


def weight_in_common(a: np.ndarray, b: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Share of the rarity of each row of b that its best common subsequence with the row of a holds; words of many items weigh less."""
    weight = np.append(rarity, 0.0).astype("float32")[b]
    row = np.zeros((len(a), PASSAGE + 1), "float32")
    for i in range(PASSAGE):
        nxt = np.zeros_like(row)
        same = (a[:, i : i + 1] == b) & (b >= 0)
        for j in range(PASSAGE):
            nxt[:, j + 1] = np.maximum(np.maximum(row[:, j + 1], nxt[:, j]), np.where(same[:, j], row[:, j] + weight[:, j], 0))
        row = nxt
    return row[:, -1] / np.maximum(weight.sum(axis=1), 1e-9)


def search(passages: DataFrame, ix: ItemIndex, idf: np.ndarray, space: np.ndarray, near: float = NEAR, paraphrases: bool = False) -> DataFrame:
    """(passage, item_id, cosine, common, exact): every distinct document passage against all item passages, in blocks.

    Candidates are items with a passage whose cosine in the latent space is at least ``near``; none is cut off, and nothing but
    candidates is looked at. exact: a run of RUN words that only this item has stands in the passage. Paraphrases: cosine of
    PARAPHRASE_NEAR, a common subsequence of PARAPHRASE_SHARE of the weight and, where the item's passage holds answers,
    PARAPHRASE_ANSWERS of them; a passage without answers is decided by the subsequence alone. A passage
    that is as near to another item is a standing phrase and tells of none.
    """

    def project(rows: np.ndarray) -> np.ndarray:
        x = times(rows, idf, space)
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)

    mine = project(ix.passages)
    first = np.searchsorted(ix.owner, np.arange(len(ix.items)))

    def exact_in(rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of candidates whose row holds a run of its item."""
        if not len(rows) or not len(ix.run_hash):
            return np.zeros(0, int), np.zeros(0, int)
        h = run_hashes(rows)
        at = np.minimum(np.searchsorted(ix.run_hash, h), len(ix.run_hash) - 1)
        r, c = np.nonzero(ix.run_hash[at] == h)
        o = ix.run_owner[at[r, c]]
        r, c, o = (x[wanted[r, o]] for x in (r, c, o))
        true = (rows[r[:, None], c[:, None] + np.arange(RUN)] == ix.run_ids[at[r, c]]).all(axis=1) if len(r) else np.zeros(0, bool)
        return r[true], o[true]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, out = _rows(b), []
            for k in range(0, len(every), BATCH):
                rows = every[k : k + BATCH]
                cosines = project(rows) @ mine.T
                best = np.maximum.reduceat(cosines, first, axis=1)
                some = np.flatnonzero((best >= near).any(axis=1))
                r, o = exact_in(rows[some], best[some] >= near)
                exact = set(zip(some[r].tolist(), o.tolist()))
                out += [(rows[i].tobytes(), int(ix.items[j]), float(best[i, j]), 1.0, True) for i, j in exact]
                if paraphrases:
                    p, q = np.nonzero(cosines >= PARAPHRASE_NEAR)
                    share = weight_in_common(rows[p], ix.passages[q], ix.rarity)
                    shares: dict[int, dict[int, tuple[float, float]]] = defaultdict(dict)
                    for i, j, n in zip(*(x[share >= PARAPHRASE_SHARE].tolist() for x in (p, q, share))):
                        item = int(ix.owner[j])
                        answers = ix.answers[item].intersection(ix.passages[j].tolist())
                        if not answers or len(answers.intersection(rows[i].tolist())) >= PARAPHRASE_ANSWERS * len(answers):
                            shares[i][item] = max(shares[i].get(item, (0.0, 0.0)), (n, float(cosines[i, j])))
                    for i, of in shares.items():
                        (n, item), *others = sorted(((n, item) for item, (n, _) in of.items()), reverse=True)
                        if (i, item) not in exact and (not others or n >= PARAPHRASE_AHEAD * others[0][0]):
                            out.append((rows[i].tobytes(), int(ix.items[item]), of[item][1], n, False))
            kinds = (pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["passage", "item_id", "cosine", "common", "exact"])

    return passages.select("passage").mapInArrow(run, "passage binary, item_id bigint, cosine double, common double, exact boolean")


def leaked_items(docs: DataFrame, items: list[tuple[int, str]], scratch: Scratch, near: float = NEAR, paraphrases: bool = False) -> DataFrame:
    """(doc_id, item_id, exact, cosine, common): documents and the items of which they hold passages.

    Null and empty texts hold none; a repeated doc_id is one document; without items or documents the result is empty.
    """
    ix = index_items(items)
    held = scratch.save(document_passages(docs, ix.vocabulary))
    distinct = scratch.save(held.groupBy("passage").agg(F.count("*").alias("n")))
    size = len(ix.vocabulary)
    none = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, exact boolean, cosine double, common double")
    if not size or not distinct.limit(1).count():
        return none
    spread = word_spread(distinct, size)
    idf = np.log((distinct.agg(F.sum("n")).first()[0] + 1) / (spread + 1)) + 1
    space = latent_space(distinct, idf)
    hits = search(distinct, ix, idf, space, near, paraphrases)
    return held.join(hits, "passage").groupBy("doc_id", "item_id").agg(F.bool_or("exact").alias("exact"), F.max("cosine").alias("cosine"), F.max("common").alias("common"))


def read_items(items: DataFrame, most: int = MOST_ITEMS) -> list[tuple[int, str]]:
    """The evaluation set; one of more than ``most`` items is refused, as index_items refuses one of too many words."""
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} evaluation items")
    return [(r["item_id"], r["text"]) for r in rows]
