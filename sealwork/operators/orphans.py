"""References to records that do not exist (problem 3).

References are added up per key and period first; keys are then looked up, never single references. Keys that very many
references name are looked up by broadcast, all others by shuffled anti-joins; counts and rows of both sides are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when more than one in HEAVY_SHARE of all references names it; so there are fewer than HEAVY_SHARE heavy keys.
HEAVY_SHARE = 2000
KEY = ["ref_kind", "ref_id"]


def _verdicts(keys: DataFrame, known: DataFrame, gone: DataFrame) -> DataFrame:
    """(ref_kind, ref_id, state, us) of keys that are deleted or missing, or whose record came after some source (``lo``) saw it."""
    deleted = keys.join(gone, KEY, "left_semi").select(*KEY, F.lit("deleted").alias("state"), F.lit(None).cast("bigint").alias("us"))
    kept = keys.join(gone, KEY, "left_anti")
    missing = kept.join(known, KEY, "left_anti").select(*KEY, F.lit("missing").alias("state"), F.lit(None).cast("bigint").alias("us"))
    late = kept.join(known, KEY).where("us > lo").select(*KEY, F.lit("late").alias("state"), "us")
    return deleted.unionByName(missing).unionByName(late)


def looked_up(refs: DataFrame, targets: DataFrame, removed: DataFrame, scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, counts per key and period, verdicts): distinct references, their sums, and the faulty keys.

    refs: src_table, src_key, ref_kind, ref_id, src_us (first time the source was seen), period; may hold repeats, null and
    blank ids are no references. targets: ref_kind, ref_id, us; several rows per record count as one, first seen at the
    least us. removed: ref_kind, ref_id. verdicts: ref_kind, ref_id, state, us, heavy.
    """
    own = refs.where("src_key is not null and ref_kind is not null and ref_id is not null and trim(ref_id) <> ''")
    own = scratch.save(own.groupBy("src_table", "src_key", *KEY).agg(F.min("src_us").alias("src_us"), F.min("period").alias("period")))
    summed = own.groupBy("src_table", *KEY, "period").agg(F.count("*").alias("n"), F.min("src_us").alias("lo"), F.max("src_us").alias("hi"), F.count_if(F.col("src_us").isNull()).alias("timeless"))
    summed = scratch.save(summed)
    total = summed.agg(F.sum("n")).first()[0] or 0
    keys = summed.groupBy(*KEY).agg(F.min("lo").alias("lo"), (F.sum("n") * HEAVY_SHARE > total).alias("heavy"))
    keys = scratch.save(keys)
    heavy, light = keys.where("heavy"), keys.where("not heavy")
    known = targets.where("ref_id is not null").groupBy(*KEY).agg(F.min("us").alias("us"))
    gone = removed.where("ref_id is not null").select(*KEY).distinct()
    # fewer than HEAVY_SHARE rows whatever the data: sent to the tables instead of the tables to them
    small = F.broadcast(heavy.select(*KEY))
    heavy_known = targets.join(small, KEY, "left_semi").groupBy(*KEY).agg(F.min("us").alias("us"))
    heavy_gone = removed.join(small, KEY, "left_semi").select(*KEY).distinct()
    found = _verdicts(light, known, gone).withColumn("heavy", F.lit(False))
    found = found.unionByName(_verdicts(heavy, heavy_known, heavy_gone).withColumn("heavy", F.lit(True)))
    return own, summed, scratch.save(found)


def _with_verdict(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of faulty keys; those of heavy keys stay where they are, those of the others are shuffled by key."""
    heavy = F.broadcast(verdicts.where("heavy").drop("heavy"))
    return rows.join(verdicts.where("not heavy").drop("heavy"), KEY).unionByName(rows.join(heavy, KEY))


def faulty_references(refs: DataFrame, targets: DataFrame, removed: DataFrame, scratch) -> DataFrame:
    """(src_table, src_key, ref_kind, ref_id, state, period) of the references whose record is deleted, missing or late.

    For the inputs see looked_up. A record removed counts as deleted, whether or not it has rows; a reference from a source
    without a time is never late. Empty inputs give an empty result; extra columns are ignored.
    """
    own, _, verdicts = looked_up(refs, targets, removed, scratch)
    return _with_verdict(own, verdicts).where("state <> 'late' or us > src_us").select("src_table", "src_key", *KEY, "state", "period")


def orphan_counts(refs: DataFrame, targets: DataFrame, removed: DataFrame, scratch) -> DataFrame:
    """(src_table, period, ref_kind, state, n): faulty references per table and month, from the sums per key and period.

    Single references are read again only for keys and months in which the record came between the first and the last source.
    """
    own, summed, verdicts = looked_up(refs, targets, removed, scratch)
    sums = _with_verdict(summed, verdicts)
    whole = sums.where("state <> 'late' or us > hi").withColumn("n", F.when(F.col("state") == "late", F.col("n") - F.col("timeless")).otherwise(F.col("n")))
    mixed = sums.where("state = 'late' and us > lo and us <= hi").select("src_table", *KEY, "period", "us")
    split = own.join(mixed, ["src_table", *KEY, "period"]).where("us > src_us").withColumn("state", F.lit("late")).withColumn("n", F.lit(1).cast("bigint"))
    cols = ["src_table", "period", "ref_kind", "state", "n"]
    return whole.select(*cols).unionByName(split.select(*cols)).groupBy("src_table", "period", "ref_kind", "state").agg(F.sum("n").alias("n")).where("n > 0")
