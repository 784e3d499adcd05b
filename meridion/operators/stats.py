"""Distribution metrics, ranked selection and small reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridion.session import materialize

# Smallest scale at which minor classes are drawn; order of drawing.
LOD_SCALE = 1.35
RENDER_ORDER = {"minor_local": 0, "major_local": 1, "arterial": 2}


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """(.., name): each row's place from 1 in an order without ties; rows are ranged over tasks, none sees them all."""
    place = F.monotonically_increasing_id()  # partition and place in it, after the sort
    t = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place))
    t = t.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    before, starts = 0, []
    for r in t.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each partition
        starts.append((r["_part"], before))
        before += r.n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    return t.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_at", "_part", "_row", "_before")


def lod_filter(edges: DataFrame, scale: float) -> DataFrame:
    """Edges that are drawn at a scale, with their order of drawing."""
    rank = F.coalesce(*(F.when(F.col("road_class") == k, n) for k, n in RENDER_ORDER.items()), F.lit(2))
    t = edges if scale >= LOD_SCALE else edges.where("road_class <> 'minor_local'")
    return numbered(t.withColumn("_rank", rank), [F.asc("_rank"), F.desc("length_m"), F.asc("id")], "draw_order").drop("_rank")


def first_per_bucket(points: DataFrame, size: float) -> DataFrame:
    """(.., alias): the smallest id of each point's square."""
    w = Window.partitionBy(F.floor(F.col("x") / size), F.floor(F.col("y") / size))
    return points.withColumn("alias", F.min("id").over(w))


def snap_network(nodes: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """Edges after their nodes are snapped to squares: no loops, one edge per pair and class, flags united."""
    alias = first_per_bucket(nodes, size).select("id", "alias")
    end = lambda c: alias.select(F.col("id").alias(c), F.col("alias").alias(f"{c}2"))
    t = edges.join(end("u"), "u").join(end("v"), "v").where("u2 <> v2")
    return t.groupBy(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"), "road_class").agg(
        F.min("id").alias("id"), F.min("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"), F.count("*").alias("merged")
    )


def assign_tiers(points: DataFrame, score: Column, sizes: tuple[int, ...]) -> DataFrame:
    """The best rows by score, in tiers of the given sizes; ties by id."""
    n, tier, total = F.col("_n"), F.lit(None).cast("int"), sum(sizes)
    for k in range(len(sizes), 0, -1):
        tier = F.when(n <= sum(sizes[:k]), k).otherwise(tier)
    best = points.withColumn("_score", score).orderBy(F.desc("_score"), "id").limit(total)
    return best.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("_score"), "id"))).withColumn("tier", tier).drop("_n", "_score")


def main_and_branches(lines: DataFrame, key: str, branches: int) -> DataFrame:
    """The main line by (flow, length) and the branches that are long and strong enough beside it."""
    order = [F.desc("flow"), F.desc("length"), F.asc(key)]
    main = lines.orderBy(*order).limit(1).select(F.struct(key, "flow", "length")).scalar()
    t = lines.withColumn("_m", main)
    good = (F.col(key) == F.col(f"_m.{key}")) | ((F.col("length") >= F.greatest(F.lit(120.0), 0.2 * F.col("_m.length"))) & (F.col("flow") >= F.greatest(F.lit(2.0), 0.06 * F.col("_m.flow"))))
    return t.where(good).orderBy(*order).limit(branches + 1).withColumn("main", F.col(key) == F.col(f"_m.{key}")).drop("_m")


def priority_select(items: DataFrame, most: int, min_length: float, with_grid: bool) -> DataFrame:
    """(.., priority): connectors first, then spines, then long ones; grid pieces last; ties by id."""
    p = F.when(F.col("connector"), 3000.0).otherwise(0.0) + F.when(F.col("spine"), 2000.0).otherwise(0.0) + F.least(F.lit(1000.0), "length_m") - F.when(F.col("grid"), 250.0).otherwise(0.0)
    t = items.where((F.col("length_m") >= min_length) | F.col("connector") | F.col("spine"))
    t = t if with_grid else t.where(~F.col("grid"))
    return t.withColumn("priority", p).orderBy(F.desc("priority"), "id").limit(most)


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p90 and p99 with linear interpolation."""
    return df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("p")).select(*by, *(F.col("p")[k].alias(n) for k, n in enumerate(("p50", "p90", "p99"))))


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The value at the half-even rounded place (n - 1) * q of each group.

    Equal values are counted first; the counts are ranged over tasks by group and value and added up range by range, so
    neither a group with most rows nor one with many values has to pass one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    t = materialize(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    sums = t.groupBy(*by, "_part").agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*(F.col(c) for c in by))
    sums = sums.withColumn("_n", F.sum("_s").over(group)).withColumn("_before", F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s"))
    place = F.rint((F.col("_n") - 1) * q)
    hit = sums.where((place >= F.col("_before")) & (place < F.col("_before") + F.col("_s")))  # a row for each group
    hit = hit.select(*(F.col(c).alias(f"_h{k}") for k, c in enumerate(by)), F.col("_part").alias("_at"), (place - F.col("_before")).alias("_k"))
    same = F.col("_part") == F.col("_at")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_h{k}"))
    rows = t.join(hit, same).select(*by, F.col(value).alias("q"), "_c", "_k")
    upto = F.sum("_c").over(group.orderBy("q").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_upto", upto).where((F.col("_k") >= F.col("_upto") - F.col("_c")) & (F.col("_k") < F.col("_upto"))).select(*by, "q")


def band_rates(df: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    c = F.col(value)
    return df.groupBy(*by).agg(share(c < low).alias("short"), share(c.between(low, high)).alias("in_band"), share(c > high).alias("long"))


# Reasons for which a trace may end early.
EXEMPT_REASONS = ("river_blocked", "block_exit", "near_network", "road_too_far", "boundary")


def trace_rates(df: DataFrame, by: list[str], low: float, high: float, small_block: float) -> DataFrame:
    """Shares of traces (length_m, culdesac, reason, block_axis) that are short, in the band, long, over 1 and 3 km.

    ``culdesac_short``: of the culdesacs.  ``strict_band``: of the traces that had no excuse: no culdesac, a block that
    is not small, no exempt reason.  A share of nothing is 0.
    """
    m, cul = F.col("length_m"), F.col("culdesac")
    strict = ~cul & (F.coalesce("block_axis", F.lit(0.0)) >= small_block) & ~F.coalesce(F.col("reason").isin(*EXEMPT_REASONS), F.lit(False))
    share = lambda c, of=F.lit(True): F.coalesce(F.avg(F.when(of, F.when(c, 1.0).otherwise(0.0))), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), share(m < low).alias("short"), share(m.between(low, high)).alias("in_band"), share(m > high).alias("long"), share(m > 1000).alias("over_1km"),
        share(m > 3000).alias("over_3km"), share(m < low, cul).alias("culdesac_short"), share(m.between(low, high), strict).alias("strict_band")
    )


def dominant(df: DataFrame, by: list[str], category: str, weight: Column | None = None) -> DataFrame:
    """The category with the most rows (or weight) of each group; ties to the smallest name."""
    n = F.count("*") if weight is None else F.sum(weight)
    t = df.groupBy(*by, category).agg(n.alias("_w"))
    return t.groupBy(*by).agg(F.min(F.struct((-F.col("_w")).alias("w"), category)).alias("m")).select(*by, F.col(f"m.{category}").alias("dominant"), (-F.col("m.w")).alias("weight"))


def circular_mean(df: DataFrame, by: list[str], degrees: str) -> DataFrame:
    a = F.degrees(F.atan2(F.sum(F.sin(F.radians(degrees))), F.sum(F.cos(F.radians(degrees)))))
    return df.groupBy(*by).agg(a.alias("mean")).withColumn("mean", F.when(F.col("mean") < 0, F.col("mean") + 360).otherwise(F.col("mean")))


def count_map(df: DataFrame, by: list[str], category: str) -> DataFrame:
    t = df.groupBy(*by, category).agg(F.count("*").alias("n"))
    return t.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "n")))).alias("counts"))


def notes(metrics: DataFrame, parts: list[tuple[str, Column, Column]]) -> DataFrame:
    """One ordered list of notes per row: (format with one %s, value, condition)."""
    return metrics.withColumn("notes", F.array_compact(F.array(*(F.when(c, F.format_string(f, x)) for f, x, c in parts))))


def convex_hulls(points: DataFrame, by: str) -> DataFrame:
    """(by, ring, area): the hull of each group's points.

    Hulls are made in two steps, of parts of bounded size and then of the parts' corners, so no group is in one task.
    """
    import pandas as pd

    def hull(pts: list[tuple[float, float]]) -> list[tuple[float, float]]:
        pts = sorted(set(pts))
        if len(pts) < 3:
            return pts

        def half(seq):
            out = []
            for q in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out[:-1]

        return half(pts) + half(reversed(pts))

    def corners(t: pd.DataFrame) -> pd.DataFrame:
        ring = hull(list(zip(t["x"], t["y"], strict=True)))
        return pd.DataFrame({"g": t["g"].iloc[0], "x": [a for a, _ in ring], "y": [b for _, b in ring], "k": range(len(ring))})

    t = points.select(F.col(by).alias("g"), "x", "y").withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    kind = points.schema[by].dataType.simpleString()
    schema = f"g {kind}, x double, y double, k long"
    first = t.groupBy("g", "part").applyInPandas(lambda t: corners(t), schema)
    second = first.groupBy("g").applyInPandas(lambda t: corners(t), schema)
    ring = F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    from meridion.functions.geometry import ring_area

    out = second.groupBy("g").agg(ring.alias("ring"))
    return out.select(F.col("g").alias(by), "ring", ring_area(F.col("ring")).alias("area"))


def oriented_box(zones: DataFrame) -> DataFrame:
    """(zone_id, min_dim, max_dim, aspect, angle): the smallest rotated rectangle round each convex ring."""
    following = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    edges = F.zip_with("ring", following, lambda a, b: F.atan2(b["y"] - a["y"], b["x"] - a["x"]))
    t = zones.select("zone_id", "ring", F.posexplode(edges).alias("k", "a"))
    at = lambda f, g: F.transform("ring", lambda p: f(p["x"], p["y"])) if g is None else g(F.transform("ring", lambda p: f(p["x"], p["y"])))
    along, over = (lambda x, y: x * F.cos("a") + y * F.sin("a")), (lambda x, y: y * F.cos("a") - x * F.sin("a"))
    t = t.withColumn("w", at(along, F.array_max) - at(along, F.array_min)).withColumn("h", at(over, F.array_max) - at(over, F.array_min))
    best = t.groupBy("zone_id").agg(F.min(F.struct(F.round(F.col("w") * F.col("h"), 6).alias("area"), "k", "w", "h", "a")).alias("m"))
    low, high = F.least("m.w", "m.h"), F.greatest("m.w", "m.h")
    angle = F.degrees(F.when(F.col("m.w") >= F.col("m.h"), F.col("m.a")).otherwise(F.col("m.a") + F.pi() / 2))
    return best.select("zone_id", low.alias("min_dim"), high.alias("max_dim"), (high / F.when(low > 1e-9, low)).alias("aspect"), F.pmod(angle, F.lit(180.0)).alias("angle"))
