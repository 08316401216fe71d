"""Keyed results, resolution of references, cached compute and job listings, over append-only tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(writes: DataFrame, keys: list[str], seq: str, values: list[str]) -> DataFrame:
    """(keys, first_seq, n_writes, values): the last write of every key; first_seq is the place a key keeps. An aggregate, no sort."""
    agg = writes.groupBy(*keys).agg(F.min(seq).alias("first_seq"), F.count("*").alias("n_writes"), F.max_by(F.struct(*values), seq).alias("_v"))
    return agg.select(*keys, "first_seq", "n_writes", *[F.col("_v")[v].alias(v) for v in values])


def result_listing(results: DataFrame, product: str, owner: str, params: str, seq: str) -> DataFrame:
    """(product, owner, n, params_keys): distinct parameter keys of each owner in the order of their first write."""
    first = results.groupBy(product, owner, params).agg(F.min(seq).alias("_s"))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("_s", params))), lambda x: x[params])
    return first.groupBy(product, owner).agg(F.count("*").alias("n"), keys.alias("params_keys"))


def cache_misses(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct requests that no result answers, null keys meeting null keys."""
    a, b = requests.select(*keys).distinct(), results.select(*keys).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), on, "left_anti")


def resolve(refs: DataFrame, entities: DataFrame, ref: str, entity: str, name: str, seq: str, active: str | None = None) -> DataFrame:
    """(ref, entity, how): a reference is an id, else the name of the first entity so named; null or empty ones mean the active entity.

    how: id, name, active, or missing. Without ``active`` a null reference is missing.
    """
    want = refs.select(F.col(ref).alias("_r")).distinct()
    ids = entities.select(F.col(entity).alias("_r"), F.col(entity).alias("_id")).where("_r is not null").distinct()
    names = entities.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_r")).agg(F.min_by(entity, seq).alias("_named"))
    out = want.join(ids, "_r", "left").join(names, "_r", "left")
    open_ref = F.col("_r").isNull() | (F.col("_r") == "")
    how = F.when(open_ref & F.lit(active is not None), "active").when(F.col("_id").isNotNull(), "id").when(F.col("_named").isNotNull(), "name").otherwise("missing")
    value = F.when(open_ref & F.lit(active is not None), F.lit(active)).otherwise(F.coalesce("_id", "_named"))
    return out.select(F.col("_r").alias("ref"), value.alias("entity"), how.alias("how"))


def compute_missing(requests: DataFrame, results: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame], pd.Series], inputs: list[str]) -> DataFrame:
    """(keys, value, error, cached): results that are there, and the kernel's for those that are not; a failing row has an error and fails no other.

    kernel: takes a frame of one row with ``inputs`` and gives text. Requests of equal keys are computed once.
    """
    one = requests.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in inputs if c not in keys])
    found = one.join(results.select(*keys, "value"), keys).select(*keys, "value", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    todo = one.join(results.select(*keys), keys, "left_anti")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.select(*keys).schema)

    def run(frames):
        for pdf in frames:
            value, error = [], []
            for i in range(len(pdf)):
                try:
                    value.append(str(kernel(pdf.iloc[[i]])))
                    error.append(None)
                except Exception as e:
                    value.append(None)
                    error.append(f"{type(e).__name__}: {e}"[:200])
            yield pdf[keys].assign(value=value, error=error)

    fresh = todo.mapInPandas(run, f"{kinds}, value string, error string").withColumn("cached", F.lit(False))
    return found.unionByName(fresh)


def fanout_summary(results: DataFrame, batch: list[str], owner: str) -> DataFrame:
    """(batch, n_features, n_success, n_error, n_cached) of computed results (columns error, cached), each owner once."""
    return results.groupBy(*batch).agg(
        F.count_distinct(owner).alias("n_features"), F.count_distinct(F.when(F.col("error").isNull(), F.col(owner))).alias("n_success"), F.count_if(F.col("error").isNotNull()).alias("n_error"), F.count_if("cached").alias("n_cached")
    )


def jobs_view(registry: DataFrame, status: DataFrame, alive: DataFrame, terminal: tuple[str, ...] = ("complete", "failed", "cancelled")) -> DataFrame:
    """(job_id, kind, started_at, state): newest status over the registered one; a job that should run but has no live process is failed.

    registry: job_id, kind, started_at, registered; status: job_id, at, status; alive: job_id. Jobs known only by status are listed as well.
    """
    last = status.groupBy("job_id").agg(F.max_by("status", "at").alias("told"))
    known = registry.join(last, "job_id", "full").join(alive.select("job_id").distinct().withColumn("_alive", F.lit(True)), "job_id", "left")
    state = F.coalesce("told", "registered")
    return known.select("job_id", "kind", "started_at", F.when(state.isin(*terminal) | F.col("_alive"), state).otherwise("failed").alias("state"))


def citation_text(sources: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, citations): distinct citation texts in order of their first use, blank line between; a comment where there is none."""
    first = sources.groupBy(*keys, text).agg(F.min(order).alias("_o"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull() & (F.col(text) != ""), F.struct("_o", text)))), lambda x: x[text])
    return first.groupBy(*keys).agg(listed.alias("_l")).select(*keys, F.when(F.size("_l") > 0, F.array_join("_l", "\n\n")).otherwise("% no citations").alias("citations"))
