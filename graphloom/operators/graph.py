"""Graph operators over edge tables (src, dst): closure, depth, ancestors, cycles, hops, paths, neighbourhoods.

Iterations are joins of a frontier that end when it is empty, cut by reliable checkpoints.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.storage import shared_base


def use_checkpoints(spark: SparkSession) -> None:
    """Set the session's shared checkpoint folder."""
    shared_base(spark)


#: Rows up to which a frontier is broadcast to the stored edges, so that these need no shuffle in a round.
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """``df``, which must be stored or checkpointed, with a broadcast hint if a count shows it to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, hops): all reachable pairs but a node with itself, with the least number of steps; safe on cycles.

    A round doubles the length: once all pairs within 2^k steps are known, a longer shortest path has a node at exactly 2^k steps
    from its start, and the rest of it is known. The rounds are as many as the longest path has binary digits."""
    use_checkpoints(edges.sparkSession)
    known, length = edges.select("src", "dst").filter("src <> dst").distinct().withColumn("hops", F.lit(1)).checkpoint(), 1
    while True:
        first = known.filter(F.col("hops") == length).select("src", F.col("dst").alias("_mid"))
        rest = known.select(F.col("src").alias("_mid"), "dst", "hops")
        longer = first.join(rest, "_mid").filter("src <> dst").groupBy("src", "dst").agg((F.min("hops") + length).alias("hops"))
        fresh = longer.join(known.select("src", "dst"), ["src", "dst"], "left_anti").checkpoint()
        if fresh.isEmpty():
            return known
        known, length = known.unionByName(fresh), 2 * length


def reached_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Those distinct (a, b) of ``pairs``, of two nodes, that have a path from a to b.

    Only nodes behind an a that still has an open pair are visited; no closure of the whole graph is built."""
    spark = edges.sparkSession
    use_checkpoints(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = edges.select("src", "dst").filter("src <> dst").distinct().checkpoint()
    asked = pairs.select("a", "b").filter("a <> b").distinct().checkpoint()
    frontier = seen = asked.select("a", F.col("a").alias("node")).distinct().checkpoint()
    found = asked.limit(0)
    for turn in count(1):
        near = step.join(small(frontier.withColumnRenamed("node", "src")), "src").select("a", F.col("dst").alias("node")).distinct()
        near = near.join(seen, ["a", "node"], "left_anti").checkpoint()
        if near.isEmpty():
            return found
        hits = near.select("a", F.col("node").alias("b"))
        found = found.unionByName(asked.join(hits, ["a", "b"], "left_semi").checkpoint())
        asked = asked.join(hits, ["a", "b"], "left_anti").checkpoint()
        seen = seen.unionByName(near)
        if turn % 8 == 0:  # long searches would otherwise leave many small parts
            found, seen = found.coalesce(parts).checkpoint(), seen.coalesce(parts).checkpoint()
        frontier = near.join(asked.select("a").distinct(), "a", "left_semi").checkpoint()


def _chains(single: DataFrame, many: int) -> DataFrame:
    """(node, top, steps) of nodes with one parent (node, top, steps): followed to the first that is not one of them, by doubling.

    A chain of ``many`` nodes needs as many rounds as that has binary digits; what is not at its end by then is on a loop and left out."""
    jump = single
    for _ in range(many.bit_length() + 1):
        ahead = jump.select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("steps").alias("_steps"))
        jump = jump.join(ahead, "top", "left").select("node", F.coalesce("_top", "top").alias("top"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_top").isNotNull().alias("_moved")).checkpoint()
        if jump.filter("_moved").isEmpty():
            break
        jump = jump.drop("_moved")
    return jump.select("node", "top", "steps").join(single.select(F.col("node").alias("top")), "top", "left_anti")


def longest_depth(edges: DataFrame) -> DataFrame:
    """(node, depth): longest distance to a root of an acyclic child-parent table; an error if a cycle hangs under a root.

    Chains of nodes with one parent are followed by doubling; what is left are the nodes with several, whose depths are raised
    until none grows, in at most as many rounds as there are such nodes."""
    use_checkpoints(edges.sparkSession)
    edges = edges.select("src", "dst").filter("src is not null and dst is not null").distinct().checkpoint()
    parents = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("top")).checkpoint()
    single = parents.filter("n = 1").select("node", "top", F.lit(1).cast("long").alias("steps")).checkpoint()
    chain, forks = _chains(single, single.count()).checkpoint(), parents.filter("n > 1").select("node").checkpoint()
    best = edges.select(F.col("dst").alias("node")).distinct().join(parents, "node", "left_anti").select("node", F.lit(0).cast("long").alias("depth")).checkpoint()
    up = edges.join(forks.withColumnRenamed("node", "src"), "src", "left_semi")
    direct = up.join(single.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", F.lit(1).cast("long").alias("steps"))
    through = up.join(chain.withColumnRenamed("node", "dst"), "dst").select("src", F.col("top").alias("dst"), F.col("steps") + 1)
    links = direct.union(through).groupBy("src", "dst").agg(F.max("steps").alias("steps")).checkpoint()
    raised, most = best, forks.count()
    for turn in count(1):
        below = links.join(small(raised.withColumnRenamed("node", "dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.max(F.col("depth") + F.col("steps")).alias("depth"))
        raised = below.join(best.withColumnRenamed("depth", "_old"), "node", "left").filter("_old is null or depth > _old").select("node", "depth").checkpoint()
        if raised.isEmpty():
            break
        if turn > most:
            raise ValueError("the longest depth is not defined: the table has a cycle")
        best = best.unionByName(raised).groupBy("node").agg(F.max("depth").alias("depth")).checkpoint()
    hung = chain.join(best.withColumnRenamed("node", "top"), "top").select("node", (F.col("depth") + F.col("steps")).alias("depth"))
    return best.unionByName(hung).select("node", F.col("depth").cast("int").alias("depth"))


def lowest_common_ancestors(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """``sets`` is (set_id, node); a node is its own ancestor; of the common ancestors the deepest wins, then the least name."""
    selves = sets.select("node").distinct().select("node", F.col("node").alias("anc"))
    up = closure(edges).select(F.col("src").alias("node"), F.col("dst").alias("anc")).unionByName(selves)
    size = sets.groupBy("set_id").agg(F.countDistinct("node").alias("n"))
    common = sets.join(up, "node").groupBy("set_id", "anc").agg(F.countDistinct("node").alias("k")).join(size, "set_id").filter("k = n")
    deep = common.join(longest_depth(edges).withColumnRenamed("node", "anc"), "anc", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    order = W.partitionBy("set_id").orderBy(F.desc("depth"), "anc")
    return deep.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("set_id", F.col("anc").alias("lca"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those that lead from a node nothing leads to, or to a node that leads nowhere, until none is left of these."""
    many = edges.count()
    while True:
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst").checkpoint()
        many, before = edges.count(), many
        if many == before:
            return edges


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """Edges on a cycle: both ends reach each other.

    Each node takes the greatest node that reaches it; those of its followers that lead back to that one are a knot.
    Knots are taken out and the rest goes on, so no pairs of nodes are built and a cycle may have any length."""
    use_checkpoints(edges.sparkSession)
    left, found = _trimmed(edges.select("src", "dst").filter("src <> dst").distinct().checkpoint()), []
    while not left.isEmpty():
        label = left.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct().checkpoint()
        while True:
            given = left.join(label.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("label").alias("_m"))
            label = label.join(given, "node").select("node", F.greatest("label", "_m").alias("label"), (F.col("_m") > F.col("label")).alias("_moved")).checkpoint()
            if label.filter("_moved").isEmpty():
                break
            label = label.drop("_moved")
        side = lambda end: label.select(F.col("node").alias(end), F.col("label").alias("_" + end))  # noqa: E731, B023
        left = left.join(side("src"), "src").join(side("dst"), "dst").filter("_src = _dst").select("src", "dst").checkpoint()
        core = frontier = label.filter("node = label").select("node").checkpoint()
        while True:
            above = left.join(frontier.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node")).distinct()
            frontier = above.join(core, "node", "left_anti").checkpoint()
            if frontier.isEmpty():
                break
            core = core.unionByName(frontier)
        start, end = core.withColumnRenamed("node", "src"), core.withColumnRenamed("node", "dst")
        found.append(left.join(start, "src", "left_semi").join(end, "dst", "left_semi").select("src", "dst").checkpoint())
        left = _trimmed(left.join(start, "src", "left_anti").join(end, "dst", "left_anti").select("src", "dst"))
    loops = edges.filter("src = dst")
    return edges.join(reduce(DataFrame.unionByName, found), ["src", "dst"], "left_semi").select(*edges.columns).unionByName(loops) if found else loops


def break_cycles(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) of a table (src, dst, confidence): of every knot of cycles the weakest edge goes, until none is left.

    A cut makes no new cycle, so a round looks only at the knots of the one before it, and all knots are cut in the same round.
    Rows with the same ends go together."""
    spark = edges.sparkSession
    use_checkpoints(spark)
    order = F.struct("confidence", "src", "dst")
    live, cut = cyclic_edges(edges.filter("src <> dst")).checkpoint(), []
    while not live.isEmpty():
        knots = components(live.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        ends = live.join(knots, F.col("src") == F.col("node")).groupBy("root").agg(F.min(order).alias("_e")).select("_e.src", "_e.dst").checkpoint()
        cut.append(ends)
        if len(cut) == 32:
            cut = [reduce(DataFrame.unionByName, cut).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))).checkpoint()]
        live = cyclic_edges(live.join(ends, ["src", "dst"], "left_anti").select(*edges.columns).checkpoint()).checkpoint()
    loops, others = edges.filter("src = dst"), edges.filter("src <> dst")
    if not cut:
        return others, loops
    ends = reduce(DataFrame.unionByName, cut)
    gone = others.join(ends, ["src", "dst"], "left_semi").select(*edges.columns)
    return others.join(ends, ["src", "dst"], "left_anti").select(*edges.columns), loops.unionByName(gone)


def least_by(pairs: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``pairs`` with ``name``, the least ``value`` among the rows of the same ``key``.

    Minima come from partial aggregation, so no task holds a hot key's rows; they are keyed by a struct, so that the join
    deals both sides anew and adaptive execution can split a hot key."""
    least = pairs.groupBy(F.struct(F.col(key).alias("k")).alias("_key")).agg(F.min(value).alias(name))
    return pairs.join(least, F.col(key) == F.col("_key.k")).drop("_key")


def stars(table: DataFrame, key: str, node: str) -> DataFrame:
    """(a, b): every ``node`` joined to the least one that shares its ``key``."""
    return least_by(table.select(key, node), key, node, "_least").filter(F.col(node) != F.col("_least")).select(F.col(node).alias("a"), F.col("_least").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge to another; root is the least node of its component.

    Neighbours hang under the least one in turn above and below each node, until no edge changes."""
    use_checkpoints(edges.sparkSession)

    def least(pairs: DataFrame) -> DataFrame:
        return least_by(pairs, "u", "v", "m").withColumn("m", F.least("u", "m"))

    now, mark = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct().checkpoint(), None
    while True:
        mirrored = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(mirrored).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        seen = least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        small = seen.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(seen.select("u", F.col("m").alias("v")))
        now = small.filter("u <> v").distinct().checkpoint()
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def hops_from(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """(focal, node, hop) within ``k`` steps over undirected ``edges``; ``starts`` has a column focal."""
    use_checkpoints(edges.sparkSession)
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    step = edges.select(F.inline(ways)).checkpoint()  # the edges are read once; rounds end in a distinct
    seen = starts.select("focal", F.col("focal").alias("node")).distinct().withColumn("hop", F.lit(0)).checkpoint()
    frontier = seen
    for hop in range(1, k + 1):
        found = step.join(small(frontier.select("focal", F.col("node").alias("src"))), "src").select("focal", F.col("dst").alias("node")).distinct()
        frontier = found.join(seen, ["focal", "node"], "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """One row (path) along directed edges, the least by its nodes among the shortest; no row if there is none."""
    spark = edges.sparkSession
    use_checkpoints(spark)
    step = edges.select("src", "dst").distinct().checkpoint()
    frontier = spark.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = frontier.select("node").checkpoint()
    while True:
        hit = frontier.filter(F.col("node") == target)
        if not hit.isEmpty():
            return hit.select("path")
        found = step.join(small(frontier.withColumnRenamed("node", "src")), "src")
        found = found.groupBy(F.col("dst").alias("node")).agg(F.min(F.array_append("path", F.col("dst"))).alias("path"))
        frontier = found.join(seen, "node", "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("node"))
    return spark.createDataFrame([], "path array<string>")


def citing_all(edges: DataFrame, targets: DataFrame, years: DataFrame, low: int | None = None, high: int | None = None, limit: int = 20) -> DataFrame:
    """Papers that cite every target (id), newest first."""
    wanted = targets.select(F.col("id").alias("dst")).distinct()
    need = wanted.agg(F.count(F.lit(1)).alias("need"))
    hits = edges.join(wanted, "dst").groupBy("src").agg(F.countDistinct("dst").alias("n"))
    found = hits.join(F.broadcast(need), F.col("n") == F.col("need")).join(years.select(F.col("id").alias("src"), "year"), "src")
    if low is not None:
        found = found.filter(F.col("year").between(low, high if high is not None else low))
    return found.select(F.col("src").alias("id"), "year").orderBy(F.desc_nulls_last("year"), "id").limit(limit)


def bridging(topics: DataFrame, a: str, b: str, limit: int = 20) -> DataFrame:
    """Papers (id) on both topics, from a table (id, topic)."""
    return topics.filter(F.col("topic") == a).select("id").intersect(topics.filter(F.col("topic") == b).select("id")).orderBy("id").limit(limit)


def edge_exists(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``claims`` (src, rel, dst, ..) with a flag ``exists``."""
    known = edges.select("src", "rel", "dst").distinct().withColumn("_hit", F.lit(True))
    return claims.join(known, ["src", "rel", "dst"], "left").withColumn("exists", F.coalesce("_hit", F.lit(False))).drop("_hit")


def neighborhood(edges: DataFrame, types: DataFrame, seeds: DataFrame, hops: int, kind: str = "Paper") -> DataFrame:
    """(node) of one type within ``hops`` of any seed over any relation and direction, seeds included."""
    near = hops_from(edges, seeds.select(F.col("id").alias("focal")), hops).select("node").distinct()
    return near.join(types.filter(F.col("type") == kind).select("node"), "node", "left_semi")
