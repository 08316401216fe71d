"""Queries and oracles of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sealwork.constants import ALIAS_TAG_SCHEME
from sealwork.llm import abuse, groups, leaks, mixing
from sealwork.session import Scratch, read_table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.basin_groups(read_table(spark, d, "place_aliases"), Scratch(spark, "groups")).select("basin_id", "group_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaked_items(read_table(spark, d, "documents"), leaks.read_items(read_table(spark, d, "eval_items")), Scratch(spark, "leaks"))
    return found.where("exact").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Exact leaks and paraphrases, with cosine and common words."""
    return leaks.leaked_items(read_table(spark, d, "documents"), leaks.read_items(read_table(spark, d, "eval_items")), Scratch(spark, "leaks"), paraphrases=True)


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "mix")
    counts = scratch.save(mixing.token_counts(read_table(spark, d, "documents")))
    return mixing.fair_mix(counts, mixing.read_targets(read_table(spark, d, "mix_targets")), scratch)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("abusive").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score and the threshold of its language."""
    return abuse.scored(read_table(spark, d, "documents"), read_table(spark, d, "doc_labels"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(p9_scores(spark, d))


QUERIES = {f.__name__: f for f in (p5_found, p7_found, p7_leaks, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)}
_NOT_AN_ID = ", ".join(f"'{m}'" for m in groups.MEANINGLESS)
_P5 = f"""with recursive rows_ as (select distinct basin_id, lower(trim(scheme)) as s, trim(alias_id) as a from place_aliases where relation = 'same_as' and basin_id is not null and scheme is not null and alias_id is not null
and lower(trim(alias_id)) not in ({_NOT_AN_ID}) and not regexp_matches(lower(trim(alias_id)), '{groups.NO_ID}')),
spelt as (select distinct basin_id from rows_), named as (select distinct a from rows_ where s = '{ALIAS_TAG_SCHEME}'),
target as (select a, a as t from named where a in (select basin_id from spelt) union all select a, coalesce(basin_id, lower(a)) from named left join spelt on lower(basin_id) = lower(a) where a not in (select basin_id from spelt)),
half as (select basin_id as x, min(basin_id) over (partition by s, lower(a)) as y from rows_ where s <> '{ALIAS_TAG_SCHEME}' union select basin_id, t from rows_ join target using (a) where s = '{ALIAS_TAG_SCHEME}'),
edges as (select x, y from half where x <> y union select y, x from half where x <> y), reach as (select x, y from edges union select reach.x, edges.y from reach join edges on edges.x = reach.y)
select x as basin_id, least(x, min(y)) as group_id from reach group by x"""
_WORDS = r"regexp_extract_all(lower(regexp_replace(text, '\\+(n|r|u000[aAdD]|x0[aAdD])', ' ', 'g')), '[\p{L}\p{N}]+')"
_P7 = f"""with i as (select item_id, {_WORDS} as w from eval_items where text is not null), gi as (select distinct item_id, array_to_string(w[k + 1:k + 12], ' ') as g from (select item_id, w, unnest(range(len(w) - 11)) as k from i where len(w) >= 12)),
own as (select g, min(item_id) as item_id from gi group by g having count(*) = 1), d as (select doc_id, {_WORDS} as w from documents where text is not null and doc_id is not null)
select distinct doc_id, item_id from (select doc_id, array_to_string(w[k + 1:k + 12], ' ') as g from (select doc_id, w, unnest(range(len(w) - 11)) as k from d where len(w) >= 12)) join own using (g)"""

ORACLES: dict[str, str] = {"p5_found": _P5, "p7_found": _P7}
