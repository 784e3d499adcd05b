"""Land use of zones from what is near them, what roads leave uncovered, and layers where an analysis is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridion.operators import raster
from meridion.operators import spatial as sp
from meridion.session import materialize


def land_use(flood: Column, river: Column, arterial: Column, collector: Column, local: Column, culdesac: Column, hub: Column, hub_tier: Column, resources: Column, area: Column) -> Column:
    """The first use whose condition holds; distances in metres, area in square metres."""
    return (
        F.when((flood > 0.6) | (river < 12), "green_candidate")
        .when((area > 20_000) & (arterial < 30) & (hub > 180), "industrial_candidate")
        .when(((arterial < 35) | (collector < 24)) & (hub_tier <= 2) & (area > 1_200), "commercial_candidate")
        .when((area > 6_000) & ((resources > 0.45) | (hub < 160)), "public_facility_candidate")
        .when((culdesac < 35) & (arterial > 55), "residential_candidate")
        .when((local > 65) & (collector > 55) & (area > 8_000), "green_candidate")
        .otherwise("residential_candidate")
    )


# How much a site of each kind counts.
KIND_SHARES = {"water": 0.35, "agri": 0.7, "ore": 1.0, "forest": 0.25}


def resource_score(kind: Column, dist: Column, quality: Column, radius: Column) -> Column:
    """What one site adds: its quality, falling off to nothing at one and a half times its radius, by its kind's share."""
    share = F.coalesce(*(F.when(kind == k, x) for k, x in KIND_SHARES.items()), F.lit(0.0))
    return share * F.greatest(F.lit(0.0), 1 - dist / (1.5 * radius)) * quality


FAR = 1e9
#: The class of the roads from which each distance is taken.
ROAD_CLASSES = {"arterial": "arterial", "collector": "major_local", "local": "minor_local"}


def classify_zones(zones: DataFrame, flood: DataFrame, size: float, rivers: DataFrame, roads: DataFrame, hubs: DataFrame, sites: DataFrame) -> DataFrame:
    """(id, land_use) of zones (id, x, y, area): see ``land_use``.

    ``flood``: risk by raster cell (ix, iy, flood) of ``size`` metres; none where a cell is missing.  ``rivers``: points
    (id, x, y).  ``roads``: segments (id, road_class, culdesac, x0, y0, x1, y1); both ends of a local one that is a
    culdesac count.  ``hubs``: (id, x, y, tier), of which the nearest counts (ties: the smaller id).  ``sites``: (id, x,
    y, kind, quality, radius).  Whatever there is none of is far away.
    """
    p = materialize(zones.select("id", "x", "y"))
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    t = zones.withColumns({"ix": at("x"), "iy": at("y")}).join(flood.select("ix", "iy", "flood"), ["ix", "iy"], "left").select("id", "area", F.coalesce("flood", F.lit(0.0)).alias("flood"))
    t = t.join(sp.nearest_distance(p, rivers, 500.0, FAR).withColumnRenamed("dist", "river"), "id")
    for name, kind in ROAD_CLASSES.items():
        road = roads.where(F.col("road_class") == kind).select(F.col("id").alias("seg"), "x0", "y0", "x1", "y1")
        if road.isEmpty():
            t = t.withColumn(name, F.lit(FAR))
        else:
            t = t.join(sp.nearest_segment(p, road, 200.0).select("id", F.col("dist").alias(name)), "id")
    ends = roads.where((F.col("road_class") == "minor_local") & F.col("culdesac"))
    ends = ends.select("id", F.explode(F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1)))).alias("e")).select("id", "e.x", "e.y")
    t = t.join(sp.nearest_distance(p, ends, 200.0, FAR).withColumnRenamed("dist", "culdesac"), "id")
    # Hubs get numbers of their own, so that none is taken for the zone itself.
    tiers = hubs.select((-1 - F.col("id")).alias("hub"), "tier")
    near = hubs.select((-1 - F.col("id")).alias("other"), "x", "y")
    if near.isEmpty():
        t = t.withColumns({"hub": F.lit(FAR), "tier": F.lit(3)})
    else:
        near = sp.knn_join(p, near, 1, 1000.0).select("id", F.col("other").alias("hub"), F.col("dist").alias("to_hub")).join(tiers, "hub")
        t = t.join(near.select("id", F.col("to_hub").alias("hub"), "tier"), "id")
    reach = sites.agg(F.coalesce(F.max("radius"), F.lit(1.0)) * 1.5).head()[0]
    score = sp.within_distance(p, sites.select(F.col("id").alias("site"), "x", "y", "kind", "quality", "radius"), reach)
    score = score.groupBy("id").agg(F.sum(resource_score(F.col("kind"), F.col("dist"), F.col("quality"), F.col("radius"))).alias("resources"))
    t = t.join(score, "id", "left").withColumn("resources", F.coalesce("resources", F.lit(0.0)))
    use = land_use(*(F.col(c) for c in ("flood", "river", "arterial", "collector", "local", "culdesac", "hub", "tier", "resources", "area")))
    return t.select("id", use.alias("land_use"))


def uncovered_patches(buildable: DataFrame, segments: DataFrame, size: float, radius: float, min_area: float) -> DataFrame:
    """(zone, n_cells, area, min_x, max_x, min_y, max_y): connected buildable cells that no segment is near, from ``min_area`` on."""
    left = buildable.select("ix", "iy").join(sp.rasterize(segments, size, radius), ["ix", "iy"], "left_anti")
    return raster.zone_summary(raster.label_zones(materialize(left)), size).where(F.col("area") >= min_area)


def _scaled(cells: DataFrame, *names: str) -> DataFrame:
    """Columns put between 0 and 1 by their range over all cells."""
    ends = cells.agg(*(f(n).alias(f"_{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))))
    t = cells.join(F.broadcast(ends))
    return t.withColumns({n: (F.col(n) - F.col(f"_lo_{n}")) / F.greatest(F.lit(1e-6), F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) for n in names}).drop(*ends.columns)


def fallback_layers(cells: DataFrame) -> DataFrame:
    """(ix, iy, flood, population, green, degraded): layers as they are, or made of suitability and accumulation.

    ``cells``: ix, iy, suit, accum and the layers flood, population and green, null where the analysis has none.
    """
    t = _scaled(cells, "suit", "accum")
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    made = {"flood": F.col("accum"), "population": unit(0.75 * F.col("suit") + 0.25 * (1 - F.col("accum"))), "green": unit(0.55 * F.col("accum") + 0.45 * (1 - F.col("suit")))}
    degraded = F.array_compact(F.array(*(F.when(F.col(n).isNull(), n) for n in made)))
    return t.select("ix", "iy", *(F.coalesce(n, c).alias(n) for n, c in made.items()), degraded.alias("degraded"))


# Flow and capacity by class where no traffic was assigned.
FALLBACK_FLOW = {"arterial": 150.0, "major_local": 90.0}
FALLBACK_CAPACITY = {"arterial": 1100.0, "major_local": 700.0}


def fallback_traffic(edges: DataFrame) -> DataFrame:
    """(id, road_class, flow, capacity, congestion): flows guessed from weights, the lighter the more."""
    ends = edges.agg(F.least(F.min("weight"), F.lit(0.0)).alias("_lo"), F.greatest(F.max("weight"), F.lit(1.0)).alias("_hi"))
    by_class = lambda values, other: F.coalesce(*(F.when(F.col("road_class") == k, x) for k, x in values.items()), F.lit(other))
    light = 1 - (F.col("weight") - F.col("_lo")) / F.greatest(F.lit(1e-6), F.col("_hi") - F.col("_lo"))
    t = edges.join(F.broadcast(ends)).withColumn("flow", F.greatest(F.lit(0.0), by_class(FALLBACK_FLOW, 45.0) * (0.3 + light)))
    t = t.withColumn("capacity", by_class(FALLBACK_CAPACITY, 420.0) * F.greatest(F.lit(0.6), F.least(F.lit(1.8), F.col("length_m") / 140)))
    return t.select("id", "road_class", "flow", "capacity", (F.col("flow") / F.greatest("capacity", F.lit(1e-6))).alias("congestion"))
