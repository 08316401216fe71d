"""Mixing sources to target weights (problem 8): weighted fair queueing."""

from __future__ import annotations

import base64
import importlib.util
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealwork.operators.prefix import ranged_prefix_sum
from sealwork.session import Scratch

TOKENIZERS = "/opt/tokenizers"
_ENCODERS: dict[str, object] = {}
_COUNTS: dict[str, int] = {}
#: Pieces of the tokenizer's pattern never reach from other characters into white space, so a text may be cut before every run
#: of white space without changing its tokens; the parts repeat a lot and their counts are remembered.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PARTS = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
REMEMBERED = 400_000


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """The public byte-level BPE in ``folder``, loaded once per Python worker."""
    if folder not in _ENCODERS:
        import tiktoken

        spec = importlib.util.spec_from_file_location("_tokenizer_files", Path(folder) / "__init__.py")
        files = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(files)
        with open(Path(folder) / name, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[folder] = tiktoken.Encoding("public", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[folder]


def count_tokens(enc, text: str) -> int:
    """len(enc.encode_ordinary(text)), part by part."""
    n = 0
    known = _COUNTS
    for p in _PARTS.findall(text):
        k = known.get(p)
        if k is None:
            k = len(enc.encode_ordinary(p))
            if len(p) <= 80:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[p] = k
        n += k
    return n


def token_counts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) over whole texts; null text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for b in batches:
            n = [count_tokens(enc, t) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def fair_mix(counts: DataFrame, targets: list[tuple[str, float, int]], scratch: Scratch, budget: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mix, shares) of documents (doc_id, source, n_tokens) drawn from sources to target shares of all tokens.

    targets: source, share, most repeats. Sources without tokens cannot be drawn from; the weights of the others are scaled to
    sum 1. Without ``budget`` the mix is the largest in which every source reaches its weight. With a larger one, sources
    run dry after their repeats and the shares say so. Each document gets a virtual finish time: its source's tokens up to and
    including it, in an order shuffled by ``seed``, over the weight; repeats follow whole rounds. The mix is all that ends
    within the budget in the order of finish time. Documents without tokens, with a null source, or of a source without a target are not used.
    Ties in finish time go by source, doc_id and repeat. mix: doc_id, source, copy_no, n_tokens, finish_time, end_tokens.
    """
    spark = counts.sparkSession
    own = counts.where("n_tokens > 0 and source is not null and doc_id is not null")
    names = [s for s, share, most in targets if share and share > 0 and most and most > 0]
    supply = {r["source"]: r["t"] for r in own.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()} if names else {}
    weight = {s: share for s, share, most in targets if s in supply}
    total = sum(weight.values()) or 1.0
    weight = {s: w / total for s, w in weight.items()}
    most = {s: m for s, _, m in targets if s in supply}
    if budget is None:
        budget = int(min((most[s] * supply[s] / weight[s] for s in supply), default=0))
    rounds = {s: max(1, min(most[s], -(-int(budget * weight[s] + 1) // supply[s]))) for s in supply}
    plan = spark.createDataFrame([(s, weight[s], supply[s], rounds[s]) for s in supply], "source string, weight double, supply bigint, rounds int")
    rows = own.join(F.broadcast(plan), "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    rows = ranged_prefix_sum(rows, ["source"], ["h", "doc_id"], "n_tokens", "upto", scratch)
    copies = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("rounds")))).withColumn("finish_time", ((F.col("copy_no") - 1) * F.col("supply") + F.col("upto")) / F.col("weight"))
    timed = ranged_prefix_sum(copies, [], ["finish_time", "source", "doc_id", "copy_no"], "n_tokens", "end_tokens", scratch)
    mix = timed.where(F.col("end_tokens") <= budget).select("doc_id", "source", "copy_no", "n_tokens", "finish_time", "end_tokens")
    mix = scratch.save(mix)
    used = mix.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), F.max("copy_no").alias("most_used"), F.count("*").alias("n_used"))
    have = counts.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("supply_tokens"))
    goal = spark.createDataFrame([(s, float(a), int(m)) for s, a, m in targets], "source string, target_share double, max_repeats int")
    shares = goal.join(have, "source", "full").join(used, "source", "left")
    everything = sum(r["t"] or 0 for r in used.agg(F.sum("mix_tokens").alias("t")).collect())
    shares = shares.select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("supply_tokens", F.lit(0)).alias("supply_tokens"),
        F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), (F.coalesce("mix_tokens", F.lit(0)) / F.lit(float(everything or 1))).alias("actual_share"), F.coalesce("most_used", F.lit(0)).alias("most_used"),
    )
    return mix, shares


def read_targets(targets: DataFrame, most: int = 10_000) -> list[tuple[str, float, int]]:
    """The mix's settings; a table of more than ``most`` sources is refused. Repeated sources: the first by share counts."""
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    return sorted((r["source"], r["share"] or 0.0, r["most"] or 0) for r in rows)
