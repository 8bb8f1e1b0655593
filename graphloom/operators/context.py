"""Knowledge-graph queries: patterns, radius, gate and write-back, context projection and its turns."""

from __future__ import annotations

from functools import reduce
from math import degrees, pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.graph import hops_from

EARTH_M = 6_371_000.0


def union_graph(triples: DataFrame) -> DataFrame:
    """All named graphs read as one."""
    return triples.dropDuplicates(["s", "p", "o"])


def bgp(triples: DataFrame, patterns: list[tuple[str, str, str]], where: str | None = None) -> DataFrame:
    """Conjunctive pattern: terms that begin with ``?`` are variables and become columns; ``where`` filters on them."""

    def one(pattern: tuple[str, str, str]) -> DataFrame:
        terms = dict(zip("spo", pattern, strict=True))
        fixed = [F.col(c) == t for c, t in terms.items() if not t.startswith("?")]
        rows = reduce(lambda d, f: d.filter(f), fixed, triples)
        names: dict[str, str] = {}
        for c, t in terms.items():
            if t.startswith("?"):
                if t[1:] in names:
                    rows = rows.filter(F.col(names[t[1:]]) == F.col(c))
                names.setdefault(t[1:], c)
        return rows.select(*[F.col(c).alias(v) for v, c in names.items()]).distinct()

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            raise ValueError("patterns must share a variable")
        return a.join(b, shared)

    found = reduce(meet, map(one, patterns))
    return found.filter(where) if where else found


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


#: Tasks of the join that gives each spot its points, and parts that the points of one spot are dealt to.
SPOT_TASKS, SPOT_PARTS = 128, 16


def within_radius(centres: DataFrame, points: DataFrame, metres: float, kind: str | None = None, digits: int | None = None) -> DataFrame:
    """(centre, point, metres, rank) strictly nearer than ``metres``, rank 1 the nearest; with ``kind`` only points of that ``type``, with ``digits``
    also ``rounded``, the metres rounded.

    Bands of latitude are cut into cells as wide as the radius at their edge farther from the equator, counted around the globe; a centre
    meets the cells beside its own in three bands. So the join is on equal cells, also across the 180th meridian and at the poles. Cells join
    the distinct spots of both sides, so a distance is worked out once for all that share two spots; ids come back on equal spots, those of a spot dealt to parts, in a fixed number of tasks."""
    arc = metres / EARTH_M
    cell = degrees(arc) * 1.001
    far = lambda y: F.least(F.greatest(F.abs(y * cell), F.abs((y + 1) * cell)) + cell, F.lit(90.0))
    wide = lambda y: F.degrees(F.asin(F.least(F.lit(1.0), sin(min(arc, pi / 2)) / F.greatest(F.cos(F.radians(far(y))), F.lit(1e-12))))) * 1.001
    cells = lambda y: F.when(wide(y) >= 90, 1).otherwise(F.floor(360 / wide(y))).cast("long")
    column = lambda y, lon: F.pmod(F.floor((lon + 180) / 360 * cells(y)).cast("long"), cells(y))
    band = F.floor(F.col("lat") / cell).cast("long")
    given = points if kind is None else points.filter(F.col("type") == kind)
    near = centres.select("lat", "lon").distinct().select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.explode(F.array(*[band + i for i in (-1, 0, 1)])).alias("_y"))
    beside = F.array_distinct(F.array(*[F.pmod(column(F.col("_y"), F.col("_lon")) + i, cells(F.col("_y"))) for i in (-1, 0, 1)]))
    near = near.select("_lat", "_lon", "_y", F.explode(beside).alias("_x"))
    placed = given.select("lat", "lon").distinct().withColumn("_y", band).withColumn("_x", column(F.col("_y"), F.col("lon")))
    spots = placed.join(near, ["_y", "_x"]).select("_lat", "_lon", "lat", "lon", haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")).alias("metres")).filter(F.col("metres") < metres)
    shown = [] if digits is None else ["rounded"]
    spots = spots if digits is None else spots.withColumn("rounded", F.round("metres", digits))
    part = F.pmod(F.xxhash64("id"), F.lit(SPOT_PARTS)).cast("int")
    held = given.select(F.col("id").alias("point"), "lat", "lon", part.alias("_part")).repartition(SPOT_TASKS, "lat", "lon", "_part")
    around = centres.select(F.col("id").alias("centre"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).join(spots, ["_lat", "_lon"])
    around = around.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPOT_PARTS - 1)))).repartition(SPOT_TASKS, "lat", "lon", "_part")
    pairs = held.join(around, ["lat", "lon", "_part"]).select("centre", "point", "metres", *shown)
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("centre").orderBy("metres", "point")))


def ask_gate(requests: DataFrame, active: DataFrame, available: DataFrame) -> DataFrame:
    """``requests`` (seq, vehicle, incident) with ``holds``: the incident is active and the vehicle available."""
    a = active.select("incident").distinct().withColumn("_a", F.lit(True))
    v = available.select("vehicle").distinct().withColumn("_v", F.lit(True))
    return requests.join(a, "incident", "left").join(v, "vehicle", "left").withColumn("holds", F.coalesce(F.col("_a") & F.col("_v"), F.lit(False))).drop("_a", "_v")


def dispatch(gated: DataFrame) -> DataFrame:
    """The first request of each vehicle for which the gate holds is granted; later ones find it busy."""
    order = W.partitionBy("vehicle", "holds").orderBy("seq")
    return gated.withColumn("granted", F.col("holds") & (F.row_number().over(order) == 1))


def write_back(triples: DataFrame, granted: DataFrame) -> DataFrame:
    """Triples (s, p, o) after grants: ``assignedTo`` is added, ``hasAvailability`` becomes ``busy``."""
    done = granted.filter("granted")
    stale = done.select(F.col("vehicle").alias("s"), F.lit("hasAvailability").alias("p"))
    added = done.select(F.col("vehicle").alias("s"), F.lit("assignedTo").alias("p"), F.col("incident").alias("o"))
    busy = done.select(F.col("vehicle").alias("s"), F.lit("hasAvailability").alias("p"), F.lit("busy").alias("o"))
    return triples.select("s", "p", "o").join(stale, ["s", "p"], "left_anti").select("s", "p", "o").unionByName(added).unionByName(busy).distinct()


def graph_statistics(triples: DataFrame, sensor_type: str) -> DataFrame:
    return triples.agg(
        F.count(F.lit(1)).alias("triples"), F.count_distinct("g").alias("named_graphs"),
        F.count_distinct(F.when((F.col("p") == "rdf:type") & (F.col("o") == sensor_type), F.col("s"))).alias("sensor_nodes"),
    )


def entity_edges(triples: DataFrame, unique: bool = True) -> DataFrame:
    """(src, rel, dst) between entities: types and literals are no edges. Walks, which make their own rows distinct, need no ``unique`` edges."""
    edges = triples.filter((F.col("p") != "rdf:type") & (F.col("o_kind") == "iri")).select(F.col("s").alias("src"), F.col("p").alias("rel"), F.col("o").alias("dst"))
    return edges.distinct() if unique else edges


def node_types(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("p") == "rdf:type").groupBy(F.col("s").alias("node")).agg(F.min("o").alias("type"))


def relevance(hop: Column, is_goal: Column, age_min: Column) -> Column:
    """0.4 for nearness, 0.4 for the goal's type, 0.2 for freshness."""
    return 0.4 / (hop + 1) + 0.4 * F.when(is_goal, 1.0).otherwise(0.2) + 0.2 / (age_min + 1)


def context_graph(edges: DataFrame, types: DataFrame, ages: DataFrame, focal: DataFrame, goal_types: list[str], k: int = 3, max_nodes: int = 150) -> DataFrame:
    """(focal, node, type, hop, relevance, rank): the focal node first, then the most relevant within ``k`` hops."""
    near = hops_from(edges, focal, k).join(types, "node", "left").join(ages, "node", "left")
    scored = near.select("focal", "node", F.coalesce("type", F.lit("Thing")).alias("type"), "hop", F.coalesce("age_min", F.lit(0.0)).alias("age_min"))
    scored = scored.withColumn("relevance", F.round(relevance(F.col("hop"), F.col("type").isin(goal_types), F.col("age_min")), 9))
    order = W.partitionBy("focal").orderBy(F.desc(F.col("hop") == 0), F.desc("relevance"), "node")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_nodes).drop("age_min")


def turn_changes(members: DataFrame) -> DataFrame:
    """(turn, node, change) from (turn, node): who is added and who is evicted against the turn before."""
    before = members.select((F.col("turn") + 1).alias("turn"), "node")
    last = members.agg(F.max("turn").alias("_last"))
    added = members.join(before, ["turn", "node"], "left_anti").withColumn("change", F.lit("added"))
    gone = before.join(F.broadcast(last), F.col("turn") <= F.col("_last")).drop("_last").join(members, ["turn", "node"], "left_anti").withColumn("change", F.lit("evicted"))
    return added.select("turn", "node", "change").unionByName(gone.select("turn", "node", "change"))


def advance_clock(ages: DataFrame, refreshed: DataFrame, minutes: float) -> DataFrame:
    """Ages grow by ``minutes`` for nodes that were not refreshed; refreshed nodes are new."""
    hit = refreshed.select("node").distinct().withColumn("_r", F.lit(True))
    return ages.join(hit, "node", "left").select("node", F.when(F.col("_r"), 0.0).otherwise(F.col("age_min") + minutes).alias("age_min"))


def stale_evictions(nodes: DataFrame, limit_min: float = 5.0) -> DataFrame:
    """Stale nodes of (node, type, target, age_min) for which a fresh one of the same type watches the same target."""
    stale, fresh = nodes.filter(F.col("age_min") > limit_min), nodes.filter(F.col("age_min") <= limit_min)
    return stale.join(fresh.select("type", "target").distinct(), ["type", "target"], "left_semi").select("node", "type", "target", "age_min")
