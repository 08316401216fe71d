"""History of changing entity attributes (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Revisions folded in one array. An entity with more is cut into parts of so many and the parts are stitched.
REVISIONS_PER_PART = 512

_ROW = "struct<revision:int,us:bigint,d:string,s:string>"

# from the end: a.named is what the revision after supersedes (null: there is none), a.cur the rows of the revision at hand
_SETTLED = f"""
    aggregate(
      reverse(h),
      named_struct('rev', cast(null as int), 'named', _named, 'pick', cast(null as {_ROW}), 'out', cast(array() as array<{_ROW}>)),
      (a, x) -> if(a.rev is not null and a.rev = x.revision,
        named_struct('rev', a.rev, 'named', a.named, 'pick', if(x.d = a.named and a.pick.d <> a.named, x, a.pick), 'out', a.out),
        named_struct('rev', x.revision, 'named', if(a.rev is null, a.named, a.pick.s), 'pick', x,
          'out', if(a.pick is null, a.out, concat(a.out, array(a.pick))))),
      a -> reverse(if(a.pick is null, a.out, concat(a.out, array(a.pick)))))
"""

_VERSIONS = """
    aggregate(v, named_struct('d', _before, 'out', cast(array() as array<struct<revision:int,us:bigint>>)),
      (a, x) -> named_struct('d', x.d, 'out', if(a.d is not null and a.d = x.d, a.out, concat(a.out, array(named_struct('revision', x.revision, 'us', x.us))))),
      a -> a.out)
"""


def version_history(revisions: DataFrame, scratch, time_us: str = "us", part: int = REVISIONS_PER_PART) -> DataFrame:
    """(claim_id, revision, valid_from_us, valid_to_us): one row per version of each entity.

    Input columns: claim_id, revision, revision_digest, supersedes and ``time_us``; others are ignored. Rows of the same
    claim, revision and digest are copies and count once, as the earliest. If a revision has several digests, the one that
    the row which counts of the next present revision supersedes counts; if that names none of them, the one told last
    (of several at once, that of the largest digest). A revision whose digest equals that of the revision present before opens no
    version. valid_to_us is -1 if no version follows, null if the next one's time cannot be read. Rows without claim_id
    or revision are left out; a null digest is a digest of its own. An empty table gives an empty one.

    Per entity and part a sorted array of structs is folded twice by a higher-order function: from the end to settle conflicts,
    then forward to append a version only upon change. No entity's whole history has to lie in one task: parts of ``part``
    revisions are stitched by windows over part rows. The answer does not depend on ``part``: where every revision of a part is
    in conflict, what the part after it settles is handed through it until nothing changes.
    """
    src = revisions.where("claim_id is not null and revision is not null").select(
        "claim_id", F.col("revision").cast("int").alias("revision"), F.coalesce("revision_digest", F.lit("")).alias("d"), F.coalesce("supersedes", F.lit("")).alias("s"), F.col(time_us).alias("us")
    )
    # nulls come first in a struct, so an unreadable time must not win over a readable one
    one = src.groupBy("claim_id", "revision", "d").agg(F.min(F.struct(F.col("us").isNull().alias("bad"), "us", "s")).alias("m"))
    rows = one.select("claim_id", "revision", F.struct("revision", F.col("m.us").alias("us"), "d", F.col("m.s").alias("s")).alias("x"))
    parts = rows.groupBy("claim_id", F.floor(F.col("revision") / part).alias("part")).agg(F.array_sort(F.collect_list("x")).alias("h"))
    parts = scratch.save(parts)
    order = W.partitionBy("claim_id").orderBy("part")
    first = F.expr("v[0].s")

    def settle(named: DataFrame) -> DataFrame:
        return named.withColumn("v", F.expr(_SETTLED))

    # a part in which some revision has one row only settles its first revision whatever follows
    open_part = F.expr("size(h) > 1 and forall(filter(transform(h, x -> x.revision), (r, i) -> i = 0 or r <> h[i - 1].revision), r -> size(filter(h, x -> x.revision = r)) > 1)")
    through = parts.withColumn("open", open_part).withColumn("last", F.lead("part").over(order).isNull())
    now = settle(parts.withColumn("_named", F.lit(None).cast("string"))).withColumn("_named", F.lead(first).over(order))
    now = settle(now.drop("v"))
    if through.where("open and not last").limit(1).count():
        now = scratch.save(now)
        while True:
            nxt = now.withColumn("_new", F.lead(first).over(order))
            if not nxt.where("not (_new <=> _named)").limit(1).count():
                break
            now = scratch.save(settle(nxt.withColumn("_named", F.col("_new")).drop("_new", "v")))
    now = now.withColumn("_before", F.lag(F.expr("element_at(v, -1).d")).over(order)).withColumn("n", F.expr(_VERSIONS))
    after = W.partitionBy("claim_id").orderBy("part").rowsBetween(1, W.unboundedFollowing)
    now = now.withColumn("_next", F.first(F.expr("get(n, 0)"), ignorenulls=True).over(after))
    end = "case when i + 1 < size(n) then get(n, i + 1).us when _next is not null then _next.us else -1 end"
    return now.select("claim_id", "_next", "n", F.posexplode("n").alias("i", "x")).select(
        "claim_id", F.col("x.revision").alias("revision"), F.col("x.us").alias("valid_from_us"), F.expr(end).alias("valid_to_us")
    )
