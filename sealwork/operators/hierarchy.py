"""Parent-child links to full hierarchies (problem 4): leaf peeling in blocks.

Peeling one layer per job needs as many jobs as the longest descent has links. Here nodes are laid out in blocks of bounded
size along a locality key (kin lie near each other), every job peels each block as far as it goes, and only what crosses
blocks waits for the next job. The order of peeling is kept; read backwards it gives roots, depths and paths. What
never becomes a leaf is a loop or stands above one.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 40_000
#: Blocks keep at most so many runs of a path; whole_paths puts the pieces together.
PATH_SEGMENT = 64


# ---------------------------------------------------------------- peeling inside a block


def _frame(rows: list[tuple], types: dict[str, str]) -> pd.DataFrame:
    """Rows as a frame whose columns have their types even if it is empty."""
    return pd.DataFrame(rows, columns=list(types)).astype(types)


def _peel(pdf: pd.DataFrame) -> pd.DataFrame:
    """Peels a block's nodes, leaves first. pin: parents inside the block; n_out: children not yet peeled elsewhere; base: subtree sizes sent from elsewhere."""
    nodes, pins = pdf["node"].tolist(), pdf["pin"].tolist()
    at = {x: i for i, x in enumerate(nodes)}
    waits = pdf["n_out"].tolist()
    size = [1 + b for b in pdf["base"].tolist()]
    prim = [at.get(p, -1) if p else -1 for p in pdf["primary"].tolist()]
    inner = [[at[p] for p in pin] if pin is not None else [] for pin in pins]
    for ps in inner:
        for p in ps:
            waits[p] += 1
    ready = deque(i for i, w in enumerate(waits) if w == 0)
    order = []
    while ready:
        i = ready.popleft()
        order.append(i)
        if prim[i] >= 0:
            size[prim[i]] += size[i]
        for p in inner[i]:
            waits[p] -= 1
            if waits[p] == 0:
                ready.append(p)
    out = {"block": [pdf["block"].iloc[0]] * len(order), "node": [nodes[i] for i in order], "place": range(len(order)), "size": [size[i] for i in order]}
    return pd.DataFrame(out).astype({"block": "int32", "node": "object", "place": "int32", "size": "int64"})


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    """Goes back over a block's peeled nodes. known: what parents outside the group hand down, as (root, depth) and a path."""
    pdf = pdf.sort_values("place", ascending=False)
    roots: dict[str, dict[str, int]] = {}
    paths: dict[str, tuple[str | None, list[str]]] = {}
    out = []
    for node, pin, top, known, way in zip(pdf["node"], pdf["pin"], pdf["is_root"], pdf["known"], pdf["way"]):
        if top:
            roots[node], paths[node] = {node: 0}, (None, [])
            out.append((node, node, 0, None, []))
            continue
        own: dict[str, int] = {}
        best: tuple[int, str] | None = None
        base, seg = None, []
        if known is not None:
            for r in known:
                if r["depth"] < own.get(r["root"], 1 << 60):
                    own[r["root"]] = r["depth"]
        if way is not None:
            best, base, seg = (way["depth"], way["parent"]), way["base"], list(way["seg"])
        for p in pin if pin is not None else ():
            up = roots[p]
            for r, d in up.items():
                if d + 1 < own.get(r, 1 << 60):
                    own[r] = d + 1
            here = (min(up.values()) + 1, p)
            if best is None or here < best:
                best = here
                base, seg = paths[p]
                base, seg = (base, [*seg, p]) if len(seg) < PATH_SEGMENT else (p, [])
        roots[node], paths[node] = own, (base, seg)
        out += [(node, r, d, base, seg) for r, d in own.items()]
    return _frame(out, {"node": "object", "root": "object", "depth": "int32", "base": "object", "seg": "object"})


# ---------------------------------------------------------------- loops and distances


def strong_groups(links: list[list[int]]) -> list[list[int]]:
    """Groups of nodes that reach each other, those nearer to the ends of the links first. links: for each node the nodes it leads to."""
    index, low, held = [-1] * len(links), [0] * len(links), [False] * len(links)
    stack: list[int] = []
    groups: list[list[int]] = []
    count = 0
    for start in range(len(links)):
        if index[start] >= 0:
            continue
        work = [(start, 0)]
        while work:
            v, k = work.pop()
            if k == 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                held[v] = True
            elif held[links[v][k - 1]]:
                low[v] = min(low[v], low[links[v][k - 1]])
            deeper = False
            while k < len(links[v]):
                u = links[v][k]
                k += 1
                if index[u] < 0:
                    work += [(v, k), (u, 0)]
                    deeper = True
                    break
                if held[u]:
                    low[v] = min(low[v], index[u])
            if deeper or low[v] != index[v]:
                continue
            group = []
            while not group or group[-1] != v:
                group.append(stack.pop())
                held[group[-1]] = False
            groups.append(group)
    return groups


def _local_loops(pdf: pd.DataFrame) -> pd.DataFrame:
    """The group of each node of a block: the least node of those it reaches and is reached by inside the block; looped: it can reach itself there."""
    nodes = pdf["node"].tolist()
    at = {x: i for i, x in enumerate(nodes)}
    links = [[at[p] for p in pin] if pin is not None else [] for pin in pdf["pin"]]
    out = []
    for group in strong_groups(links):
        name, looped = min(nodes[i] for i in group), len(group) > 1 or group[0] in links[group[0]]
        out += [(pdf["block"].iloc[0], nodes[i], name, looped) for i in group]
    return _frame(out, {"block": "int32", "node": "object", "comp": "object", "looped": "bool"})


def _spread_in(step: int, kind: str):
    """Label correction inside a block: from the fresh rows along the block's links, least value for each (node, key)."""

    def run(state: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        block = (state if len(state) else links)["block"].iloc[0]
        to = defaultdict(list)
        for a, b in zip(links["src"], links["dst"]):
            to[a].append(b)
        best = {(n, k): v for n, k, v in zip(state["node"], state["key"], state["val"])}
        fresh = {(n, k) for n, k, f in zip(state["node"], state["key"], state["fresh"]) if f}
        todo = deque(sorted(fresh, key=best.__getitem__))
        while todo:
            n, k = todo.popleft()
            v = best[n, k] + step if step else best[n, k]
            for m in to.get(n, ()):
                if (m, k) not in best or v < best[m, k]:
                    best[m, k] = v
                    fresh.add((m, k))
                    todo.append((m, k))
        rows = [(block, n, k, v, (n, k) in fresh) for (n, k), v in best.items()]
        return _frame(rows, {"block": "int32", "node": "object", "key": "object", "val": kind, "fresh": "bool"})

    return run


def spread(state: DataFrame, links: DataFrame, step: int, scratch) -> DataFrame:
    """(block, node, key, val): least values of each (node, key) when every link (src, dst, sblock, dblock) hands on what src has, plus ``step``.

    state: block, node, key, val. Inside blocks labels run to their fixed point in one job; a further job is needed only as
    often as a label crosses from block to block. No task holds more than the labels and links of a block.
    """
    kind = state.schema["val"].dataType.simpleString()
    inner = links.where("sblock = dblock").selectExpr("sblock block", "src", "dst")
    cross = links.where("sblock <> dblock")
    crossing = bool(cross.limit(1).count())
    state = state.withColumn("fresh", F.lit(True))
    while True:
        state = scratch.save(
            state.groupBy("block").cogroup(inner.groupBy("block")).applyInPandas(_spread_in(step, "int32" if kind == "int" else "object"), f"block int, node string, key string, val {kind}, fresh boolean").where("node is not null")
        )
        if not crossing:
            break
        value = (F.min("val") + step).cast(kind) if step else F.min("val")
        sent = state.where("fresh").join(cross.withColumnRenamed("src", "node"), "node").groupBy(F.col("dblock").alias("block"), F.col("dst").alias("node"), "key").agg(value.alias("val"))
        both = state.select("block", "node", "key", "val", F.lit(False).alias("come")).unionByName(sent.withColumn("come", F.lit(True)))
        own = F.min(F.when(~F.col("come"), F.col("val")))
        both = both.groupBy("block", "node", "key").agg(F.min("val").alias("val"), F.coalesce(F.min("val") < own, F.lit(True)).alias("fresh"))
        both = scratch.save(both)
        old, state = state, both
        if not both.where("fresh").limit(1).count():
            break
        scratch.drop(old)
    return state.drop("fresh")


def loop_groups(nodes: DataFrame, edges: DataFrame, scratch) -> DataFrame:
    """(node, loop) of all nodes that can reach themselves, with the least node of those they reach and are reached by.

    nodes: node, block; edges: child, parent, cblock, pblock. Loops inside a block are found there. Where links cross blocks the
    groups so found are coloured by the least group that leads to them; members of a colour that lead back to its group
    form one loop, are set aside, and the rest is coloured again.
    """
    pins = edges.where("cblock = pblock").groupBy(F.col("child").alias("node")).agg(F.collect_list("parent").alias("pin"))
    local = scratch.save(nodes.select("node", "block").join(pins, "node", "left").groupBy("block").applyInPandas(_local_loops, "block int, node string, comp string, looped boolean"))
    if not edges.where("cblock <> pblock").limit(1).count():
        return local.where("looped").select("node", F.col("comp").alias("loop"))
    of = local.select("node", "comp")
    place = local.where("node = comp").select("comp", "block")
    links = edges.join(of.selectExpr("node child", "comp dst"), "child").join(of.selectExpr("node parent", "comp src"), "parent").where("src <> dst")
    links = scratch.save(links.selectExpr("src", "dst", "pblock sblock", "cblock dblock").distinct())
    rest, found = place, None
    while rest.limit(1).count():
        colour = spread(rest.select("block", F.col("comp").alias("node"), F.lit("").alias("key"), F.col("comp").alias("val")), links, 0, scratch).selectExpr("node comp", "val colour", "block")
        same = links.join(colour.selectExpr("comp src", "colour c1"), "src").join(colour.selectExpr("comp dst", "colour c2"), "dst").where("c1 = c2")
        back = scratch.save(same.selectExpr("dst src", "src dst", "dblock sblock", "sblock dblock"))
        heads = colour.where("comp = colour").select("block", F.col("comp").alias("node"), F.col("colour").alias("key"), F.lit(0).alias("val"))
        got = spread(heads, back, 0, scratch).selectExpr("node comp", "key loop")
        found = got if found is None else found.unionByName(got)
        rest = scratch.save(rest.join(got.select("comp"), "comp", "left_anti"))
        left = rest.select("comp")
        links = scratch.save(links.join(left.withColumnRenamed("comp", "src"), "src", "left_semi").join(left.withColumnRenamed("comp", "dst"), "dst", "left_semi").select("src", "dst", "sblock", "dblock"))
    found = scratch.save(found)
    wide = found.groupBy("loop").count().where("count > 1").select("loop")
    looped = local.groupBy("comp").agg(F.bool_or("looped").alias("looped"))
    groups = found.join(wide.withColumn("wide", F.lit(True)), "loop", "left").join(looped, "comp").where("looped or wide").select("comp", "loop")
    return scratch.save(local.join(groups, "comp").select("node", "loop"))


def knots(nodes: DataFrame, edges: DataFrame, scratch) -> DataFrame:
    """(node, root, depth, looped) of what is left by peeling: rows for roots and loops above a node; looped: the row of a loop's member for its own loop."""
    loops = loop_groups(nodes, edges, scratch)
    top = nodes.join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti").selectExpr("block", "node", "node key")
    starts = nodes.join(loops, "node").selectExpr("block", "node", "loop key").unionByName(top).withColumn("val", F.lit(0))
    dist = spread(starts, edges.selectExpr("parent src", "child dst", "pblock sblock", "cblock dblock"), 1, scratch)
    return dist.join(loops, "node", "left").select("node", F.col("key").alias("root"), F.col("val").alias("depth"), F.coalesce(F.col("loop") == F.col("key"), F.lit(False)).alias("looped"))


# ---------------------------------------------------------------- descendants


def links_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (child, parent) of rows (node, parents); null or blank parents, and parents that are no node, are no links."""
    edges = rows.select(F.col("node").alias("child"), F.explode("parents").alias("parent")).where("parent is not null and trim(parent) <> ''").distinct()
    return edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")


PAIRS_PER_BATCH = 200_000


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (node, descendant) inside a block, each node with itself as well: leaves are peeled and send their lists to their parents."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    names = t.column("node").combine_chunks()
    nodes = names.to_pylist()
    at = {x: i for i, x in enumerate(nodes)}
    up = [[at[p] for p in pin] if pin else [] for pin in t.column("pin").to_pylist()]
    waits = [0] * len(nodes)
    for ps in up:
        for p in ps:
            waits[p] += 1
    lists: dict[int, list[np.ndarray]] = defaultdict(list)
    held_a: list[np.ndarray] = []
    held_d: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        a, d = np.concatenate(held_a), np.concatenate(held_d)
        held_a.clear()
        held_d.clear()
        return pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(d))], names=["node", "descendant"])

    def merged(own: list[int], sent: list[np.ndarray]) -> np.ndarray:
        mine = np.array(own, "int32")
        return np.concatenate([mine, *sent]) if len(sent) <= 1 else np.unique(np.concatenate([mine, *sent]))

    ready = [i for i, w in enumerate(waits) if not w]
    peeled = [False] * len(nodes)
    while ready:
        i = ready.pop()
        peeled[i] = True
        below = merged([i], lists.pop(i, []))
        held_a.append(np.full(len(below), i, "int32"))
        held_d.append(below)
        size += len(below)
        if size >= PAIRS_PER_BATCH:
            yield flush()
            size = 0
        for p in up[i]:
            lists[p].append(below)
            waits[p] -= 1
            if not waits[p]:
                ready.append(p)
    # what is left holds loops: groups that reach each other share one list; the lowest come last in strong_groups
    left = [i for i in range(len(nodes)) if not peeled[i]]
    back = {x: k for k, x in enumerate(left)}
    for group in reversed(strong_groups([[back[p] for p in up[i]] for i in left])):
        members = sorted(left[k] for k in group)
        below = np.unique(np.concatenate([np.array(members, "int32"), *(x for i in members for x in lists.pop(i, []))]))
        inside = set(members)
        for i in members:
            held_a.append(np.full(len(below), i, "int32"))
            held_d.append(below)
            size += len(below)
            if size >= PAIRS_PER_BATCH:
                yield flush()
                size = 0
            for p in up[i]:
                if p not in inside:
                    lists[p].append(below)
    if held_a:
        yield flush()


def descendants(links: DataFrame, scratch, locality: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct (node, descendant) over all parents, on and above loops as well; a node is not listed as its own descendant.

    Inside a block peeled leaves send their lists to their parents. Lists that would cross blocks are rows instead: pairs of
    a child go to its parent in another block and from there to all ancestors inside that block, until no new pair comes
    (as many jobs as a descent crosses blocks). So no list is longer than a block, whatever the number of descendants.
    """
    rows = links.where("node is not null")
    nodes, edges = laid_out(rows, scratch, locality, block_rows)
    pins = edges.where("cblock = pblock").groupBy(F.col("child").alias("node")).agg(F.collect_list("parent").alias("pin"))
    feed = nodes.select("node", "block").join(pins, "node", "left")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _below(batches)

    inside = feed.groupBy("block").applyInArrow(below, "node string, descendant string")
    cross = edges.where("cblock <> pblock").select("child", "parent")
    if not cross.limit(1).count():
        return inside.where("node <> descendant")
    inside = scratch.save(inside)
    cross = scratch.save(cross)
    ups = inside.join(cross.select(F.col("parent").alias("descendant")).distinct(), "descendant", "left_semi").selectExpr("node anc", "descendant parent")
    ups = scratch.save(ups)
    every, front = inside, inside
    while True:
        sent = front.join(cross.withColumnRenamed("child", "node"), "node").select("parent", "descendant").distinct()
        new = sent.join(ups, "parent").select(F.col("anc").alias("node"), "descendant").distinct().join(every, ["node", "descendant"], "left_anti")
        front = scratch.save(new)
        if not front.limit(1).count():
            break
        every = every.unionByName(front)
    return every.where("node <> descendant")


def laid_out(rows: DataFrame, scratch, locality: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, loc, block) in blocks of about ``block_rows`` along the locality key, and distinct edges (child, parent, cblock, pblock)."""
    nodes = rows.groupBy("node").agg(*[F.min(c).alias(c) for c in locality])
    blocks = max(1, -(-nodes.count() // block_rows))
    own = nodes.repartitionByRange(blocks, *locality, "node").select("node", F.struct(*locality).alias("loc"), F.spark_partition_id().alias("block"))
    nodes = scratch.save(own)
    edges = rows.select(F.col("node").alias("child"), F.explode("parents").alias("parent")).where("parent is not null and trim(parent) <> ''").distinct()
    edges = edges.join(nodes.select(F.col("node").alias("parent"), F.col("block").alias("pblock")), "parent").join(nodes.select(F.col("node").alias("child"), F.col("block").alias("cblock")), "child")
    return nodes, scratch.save(edges)


def whole_paths(pieces: DataFrame, scratch) -> DataFrame:
    """(node, path): pieces (node, base, seg) with every base's own path put before, of any length; null seg counts as empty.

    Each pass joins a piece with that of its base, so a path of k pieces is whole after about log2(k) passes.
    """
    now = scratch.save(pieces.select("node", "base", F.coalesce("seg", F.expr("cast(array() as array<string>)")).alias("seg")))
    while now.where("base is not null").limit(1).count():
        up = now.select(F.col("node").alias("base"), F.col("base").alias("further"), F.col("seg").alias("before"))
        nxt = now.where("base is not null").join(up, "base", "left").select("node", F.col("further").alias("base"), F.concat(F.coalesce("before", F.expr("cast(array() as array<string>)")), F.array("base"), "seg").alias("seg"))
        now = scratch.save(now.where("base is null").unionByName(nxt))
    return now.select("node", F.col("seg").alias("path"))


# ---------------------------------------------------------------- the operator


def hierarchy(links: DataFrame, scratch, locality: list[str], block_rows: int = BLOCK_ROWS) -> dict[str, DataFrame]:
    """Full hierarchies of parent-child rows of unknown depth.

    links: node, parents (array), and the columns of ``locality``. Rows of the same node are united; null nodes are left out;
    null or blank parents, and parents that are no node, are no links. Returns tables

    - assigned(node, root, depth, base, seg): one row per node off the loops and root it descends from (a root: itself, 0), depth = fewest links;
      seg: the ids before the node on a shortest path, back to the run ``base`` whose own path goes before (null: seg begins at a root).
    - looped(node, root): nodes on loops with the smallest id of their loop group.
    - peeled(node, size): size of the subtree by primary (least) parent, leaves first; nodes above or on loops have none.

    No task holds more than a block of about ``block_rows`` nodes with its links and labels, and no list grows with the number
    of children. An empty table gives empty tables.
    """
    rows = links.where("node is not null")
    nodes, edges = laid_out(rows, scratch, locality, block_rows)
    n, blocks = nodes.count(), nodes.agg(F.max("block")).first()[0]
    blocks = (blocks or 0) + 1

    left_n, left_e, left, rounds, peeled_rounds = nodes.withColumn("base", F.lit(0).cast("bigint")), edges, n, 0, []
    while left or not rounds:
        inside = left_e.groupBy(F.col("child").alias("node")).agg(F.collect_list(F.when(F.col("pblock") == F.col("cblock"), F.col("parent"))).alias("pin"), F.min("parent").alias("primary"))
        outside = left_e.where("pblock <> cblock").groupBy(F.col("parent").alias("node")).agg(F.count("*").cast("int").alias("n_out"))
        feed = left_n.join(inside, "node", "left").join(outside, "node", "left").select("block", "node", "pin", F.coalesce("n_out", F.lit(0)).alias("n_out"), "primary", "base")
        peeled = feed.groupBy("block").applyInPandas(_peel, "block int, node string, place int, size bigint").withColumn("round", F.lit(rounds))
        peeled = scratch.save(peeled)
        got = peeled.count()
        peeled_rounds.append(peeled)
        rounds += 1
        left -= got
        # a leaf of what is left is peeled in any layout: without one, or in one block, peeling is over
        if not left or not got or blocks == 1:
            break
        blocks = -(-left // block_rows)
        gone = peeled.select("node", "size")
        sent = left_e.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("primary")).join(gone, "node").groupBy(F.col("primary").alias("node")).agg(F.sum("size").alias("sent"))
        rest = left_n.join(gone.select("node"), "node", "left_anti").join(sent, "node", "left").select("node", "loc", (F.col("base") + F.coalesce("sent", F.lit(0))).alias("base"))
        rest = rest.repartitionByRange(blocks, "loc", "node").withColumn("block", F.spark_partition_id()) if blocks > 1 else rest.withColumn("block", F.lit(0))
        left_n = scratch.save(rest)
        of = left_n.select("node", "block")
        left_e = left_e.select("child", "parent").join(of.selectExpr("node child", "block cblock"), "child").join(of.selectExpr("node parent", "block pblock"), "parent")
        left_e = scratch.save(left_e)

    assigned: list[DataFrame] = []
    looped = None
    peeled_all = peeled_rounds[0]
    for p in peeled_rounds[1:]:
        peeled_all = peeled_all.unionByName(p)
    if left:
        knot_n = scratch.save(left_n.join(peeled_rounds[-1].select("node"), "node", "left_anti").select("node", "block"))
        knot_e = left_e.join(knot_n.select(F.col("node").alias("child")), "child", "left_semi").select("child", "parent", "cblock", "pblock")
        # a parent of a node that never became a leaf never became one either, so no link is lost here
        knot_e = scratch.save(knot_e)
        known_knots = scratch.save(knots(knot_n, knot_e, scratch))
        looped = known_knots.where("looped").select("node", "root")
        near = known_knots.groupBy(F.col("node").alias("parent")).agg(F.min("depth").alias("depth"))
        via = knot_e.join(near, "parent").groupBy(F.col("child").alias("node")).agg(F.min(F.struct("depth", "parent"))["parent"].alias("base"))
        via = via.join(looped.select("node"), "node", "left_anti")  # a loop is a root: paths begin at it
        assigned.append(scratch.save(known_knots.join(via, "node", "left").select("node", "root", "depth", "base", F.expr("cast(array() as array<string>)").alias("seg"), "looped")))
    if looped is None:
        looped = nodes.limit(0).select("node", F.col("node").alias("root"))

    done = assigned[0] if assigned else None
    schema = "node string, root string, depth int, base string, seg array<string>"
    where = peeled_all.selectExpr("node parent", "round pround", "block pgroup")
    for r in reversed(range(rounds)):
        mine = peeled_rounds[r]
        up = edges.select("child", "parent").join(mine.selectExpr("node child", "block group"), "child")
        up = up.join(where, "parent", "left").withColumn("near", F.coalesce((F.col("pround") == r) & (F.col("pgroup") == F.col("group")), F.lit(False)))
        if rounds > 1 or done is not None:
            up = scratch.save(up)
        near = up.groupBy(F.col("child").alias("node")).agg(F.collect_list(F.when(F.col("near"), F.col("parent"))).alias("pin"))
        feed = mine.join(near, "node", "left").withColumn("is_root", F.col("pin").isNull())
        if done is None:
            feed = feed.withColumn("known", F.expr("cast(null as array<struct<root:string,depth:int>>)")).withColumn("way", F.expr("cast(null as struct<depth:int,parent:string,base:string,seg:array<string>>)"))
        else:
            far = up.where("not near").select("child", "parent").join(done.withColumnRenamed("node", "parent"), "parent")
            least = far.groupBy("child", "root").agg((F.min("depth") + 1).cast("int").alias("depth"))
            known = least.groupBy(F.col("child").alias("node")).agg(F.collect_list(F.struct("root", "depth")).alias("known"))
            hop = F.size("seg") < PATH_SEGMENT
            ways = far.groupBy(F.col("child").alias("node")).agg(
                F.min(F.struct((F.col("depth") + 1).cast("int").alias("depth"), "parent", F.when(hop & ~F.col("looped"), F.col("base")).otherwise(F.col("parent")).alias("base"), F.when(hop & ~F.col("looped"), F.concat("seg", F.array("parent"))).otherwise(F.expr("cast(array() as array<string>)")).alias("seg"))).alias("way")
            )
            feed = feed.join(known, "node", "left").join(ways, "node", "left")
        out = feed.groupBy("block").applyInPandas(_assign, schema)
        if r or assigned:
            out = scratch.save(out) if r else out
        assigned.append(out.withColumn("looped", F.lit(False)))
        if r:
            done = out.withColumn("looped", F.lit(False)) if done is None else done.unionByName(out.withColumn("looped", F.lit(False)))
    every = assigned[0]
    for a in assigned[1:]:
        every = every.unionByName(a)
    on_loop = looped.select("node")
    return {
        "assigned": every.join(on_loop, "node", "left_anti").drop("looped"),
        "looped": looped,
        "peeled": peeled_all.select("node", "size", "round", "block", "place"),
    }
