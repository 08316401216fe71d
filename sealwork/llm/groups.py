"""Consolidating pairwise matches into groups (problem 5): low-diameter decomposition.

Every level draws for each vertex an exponentially distributed head start; clusters grow from the vertices that start
first, one link per step, and each vertex joins the cluster that reaches it first. Clusters are contracted to one vertex,
links inside them vanish, and the links between clusters are decomposed again until none is left. The assignments of all
levels are composed at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealwork.constants import ALIAS_TAG_SCHEME
from sealwork.session import Scratch

#: Rate of the exponential head start. A level grows as many steps as its largest head start says, about ln(vertices) / RATE, or
#: until a step changes nothing, as where groups are small.
RATE = 0.2
#: Steps planned in one job.
STEPS_PER_JOB = 4
#: A vertex with more links than this is spread over several join keys.
LINKS_PER_SALT = 50_000
#: Parts in which the basins of one alias are first tied together.
ALIAS_PARTS = 16

# fixed values: alias ids that only say that no id is known
MEANINGLESS = ("", "-", "--", "?", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "tba", "tbd", "undefined", "unknown", "unspecified", "missing", "not available", "no id", "xxx")
#: Aliases of zeros only, or without a letter or digit, name nothing.
NO_ID = r"^0+$|^[^\p{L}\p{N}]*$"


def _head_start(v, level: int, rate: float):
    u = (F.pmod(F.xxhash64(v, F.lit(level)), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
    return -F.log(u) / rate


def connected_groups(links: DataFrame, scratch: Scratch, rate: float = RATE, links_per_salt: int = LINKS_PER_SALT) -> DataFrame:
    """(v, root): for every vertex of links(a, b) one vertex of its group, the same for all that are linked directly or through others.

    Links are undirected; repeats and links from a vertex to itself are harmless; links with a null end are left out. An empty
    table gives an empty one. Memory per task does not depend on group sizes: steps are joins on a vertex and minima per
    vertex, with partial aggregation before each shuffle; a vertex of many links is salted on the sending side.
    """
    edges = links.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    edges = scratch.save(edges)
    levels: list[DataFrame] = []
    while edges.limit(1).count():
        ends = edges.select("a", "b").unionByName(edges.selectExpr("b as a", "a as b")).distinct()
        degrees = ends.groupBy("a").agg(F.count("*").alias("n"))
        vertices = scratch.save(degrees.select(F.col("a").alias("v"), F.ceil(F.col("n") / links_per_salt).cast("int").alias("salts"), _head_start(F.col("a"), len(levels), rate).alias("start")))
        wide = F.broadcast(vertices.where("salts > 1").selectExpr("v a", "salts"))  # at most (links / links_per_salt) rows
        salted = ends.join(wide, "a", "left").select("a", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("b"), F.col("salts"))).otherwise(0).cast("int").alias("salt"), "b", F.lit(1).alias("cost"), F.lit(None).cast("int").alias("salts"))
        # a vertex also sends to itself at no cost, so that each step reads the one before once only
        sends = scratch.save(salted.unionByName(vertices.select(F.col("v").alias("a"), F.lit(0).alias("salt"), F.col("v").alias("b"), F.lit(0).alias("cost"), "salts")))
        grown = vertices.select("v", "salts", F.struct(F.col("start").alias("reach"), F.col("v").alias("c")).alias("best"))
        steps = int(vertices.agg(F.max("start")).first()[0])
        for step in range(steps):
            # a cluster is handed on as long as its head start lasts; each vertex keeps what reaches it with most left
            out = grown.select(F.col("v").alias("a"), "best", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
            sent = sends.join(out, ["a", "salt"]).where("best.reach >= cost")
            come = sent.select(F.col("b").alias("v"), "salts", F.struct((F.col("best.reach") - F.col("cost")).alias("reach"), F.col("best.c").alias("c")).alias("best"), "cost")
            grown = come.groupBy("v").agg(F.max("salts").alias("salts"), F.max("best").alias("best"), F.max(F.when(F.col("cost") == 0, F.col("best"))).alias("own"))
            if (step + 1) % STEPS_PER_JOB == 0 and step + 1 < steps:
                old, grown = grown, scratch.save(grown)
                scratch.drop(old)
                if not grown.where("own <> best").limit(1).count():
                    break
        cluster = scratch.save(grown.select("v", F.col("best.c").alias("c")))
        levels.append(cluster)
        inner = edges.join(cluster.selectExpr("v as a", "c as ca"), "a").join(cluster.selectExpr("v as b", "c as cb"), "b")
        inner = inner.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        old, edges = edges, scratch.save(inner)
        scratch.drop(old, sends, vertices)
    if not levels:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    whole = levels[-1].select("v", F.col("c").alias("root"))
    for level in reversed(levels[:-1]):
        whole = level.join(whole.withColumnRenamed("v", "c"), "c", "left").select("v", F.coalesce("root", "c").alias("root"))
    return whole


def basin_links(aliases: DataFrame, meaningless: tuple[str, ...] = MEANINGLESS, no_id: str = NO_ID) -> tuple[DataFrame, DataFrame]:
    """(links between 16-byte vertex keys, basins (v, basin_id)) of the same_as rows that name an id.

    Vertices are basins. The basins of one alias (scheme and id without case and outer blanks) are linked to the least of
    their part, and the least ones of the parts to the least of all, so an alias of many basins costs one link per basin, no
    pairs and no hot key, and an alias of one basin none. In the scheme whose ids are basin ids the alias is that basin: the one
    written exactly so; else those written so but for case; else a basin of its own, in lower case. Aliases that are in
    ``meaningless`` or match ``no_id`` link nothing.
    """
    alias, scheme = F.trim("alias_id"), F.lower(F.trim("scheme"))
    rows = aliases.where((F.col("relation") == "same_as") & F.col("basin_id").isNotNull() & scheme.isNotNull() & alias.isNotNull())
    rows = rows.where(~F.lower(alias).isin(*meaningless) & ~F.lower(alias).rlike(no_id))
    rows = rows.select("basin_id", scheme.alias("scheme"), alias.alias("alias")).distinct()
    key = lambda *c: F.unhex(F.md5(F.concat_ws("\x1f", *c)))
    basin = lambda c: key(F.lit("basin"), c)
    direct = rows.where(F.col("scheme") == ALIAS_TAG_SCHEME)
    other = rows.where(F.col("scheme") != ALIAS_TAG_SCHEME)
    spelt = rows.select(F.col("basin_id").alias("to")).distinct().withColumn("lower", F.lower("to"))
    named = direct.select("alias", F.lower("alias").alias("lower")).distinct().join(spelt, "lower", "left")
    exact = named.groupBy("alias").agg(F.bool_or(F.col("to") == F.col("alias")).alias("exact"))
    target = named.join(exact, "alias").where("to = alias or not coalesce(exact, false)").select("alias", F.coalesce("to", "lower").alias("to"))
    direct = direct.join(target, "alias").select("basin_id", "to")
    held = other.select(basin(F.col("basin_id")).alias("a"), key(F.col("scheme"), F.lower("alias")).alias("k"), F.pmod(F.xxhash64("basin_id"), F.lit(ALIAS_PARTS)).alias("part")).distinct()
    least = held.groupBy("k", "part").agg(F.min("a").alias("b"))
    of_all = least.groupBy("k").agg(F.min("b").alias("top"), F.count("*").alias("parts")).where("parts > 1")
    links = held.join(least, ["k", "part"]).where("a <> b").select("a", "b")
    links = links.unionByName(least.join(of_all, "k").where("b <> top").select(F.col("b").alias("a"), F.col("top").alias("b")))
    links = links.unionByName(direct.select(basin(F.col("basin_id")).alias("a"), basin(F.col("to")).alias("b")))
    names = rows.select("basin_id").unionByName(direct.select(F.col("to").alias("basin_id"))).distinct()
    return links, names.select(basin(F.col("basin_id")).alias("v"), "basin_id")


def basin_groups(aliases: DataFrame, scratch: Scratch, meaningless: tuple[str, ...] = MEANINGLESS, no_id: str = NO_ID) -> DataFrame:
    """(basin_id, group_id, n): all basins in groups of two or more; group_id is the smallest basin_id of the group.

    Rows that are null in relation, basin_id, scheme or alias_id link nothing; repeats count once.
    """
    links, names = basin_links(aliases, meaningless, no_id)
    placed = scratch.save(names.join(connected_groups(links, scratch), "v").select("basin_id", "root"))  # basins without a link are in no group
    heads = placed.groupBy("root").agg(F.min("basin_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return placed.join(heads, "root").select("basin_id", "group_id", "n")
