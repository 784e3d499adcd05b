"""String, digest and small numeric functions of the log and configuration layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def world_to_screen(x: Column, y: Column, cx: float, cy: float, scale: float, width: float, height: float) -> tuple[Column, Column]:
    """Screen position; the y axis points down."""
    return (x - cx) * scale + width / 2, F.lit(height / 2) - (y - cy) * scale


def screen_to_world(sx: Column, sy: Column, cx: float, cy: float, scale: float, width: float, height: float) -> tuple[Column, Column]:
    return (sx - width / 2) / scale + cx, (F.lit(height / 2) - sy) / scale + cy


def fingerprint(columns: list[str], digits: int = 16) -> Column:
    """First hex digits of the SHA-256 of the columns in the order of their names."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in sorted(columns)]
    return F.substring(F.sha2(F.concat_ws(";", *parts), 256), 1, digits)


def truncate(c: Column, limit: int) -> Column:
    n = F.char_length(c)
    return F.when(n > limit, F.concat(F.substring(c, 1, limit), F.lit("...(truncated:"), n.cast("string"), F.lit(")"))).otherwise(c)


def truncate_list(c: Column, limit: int) -> Column:
    more = F.concat(F.lit("...(+"), (F.size(c) - limit).cast("string"), F.lit(" items)"))
    return F.when(F.size(c) > limit, F.concat(F.slice(c, 1, limit), F.array(more))).otherwise(c)


def normal_level(c: Column) -> Column:
    up = F.upper(F.trim(c))
    return F.when(up == "WARNING", "WARN").when(up != "", up)


def alias_of(c: Column, names: dict[str, str]) -> Column:
    """A name's usual form; names that have none pass through in lower case."""
    key = F.lower(F.trim(c))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(table, key), key)


def expand_stages(df: DataFrame, column: str, stages: dict[str, list[str]], last: int = 1000) -> DataFrame:
    """(.., stage, place): a legacy stage becomes its stages in their order; unknown ones stay and come last."""
    order = {s: n + 1 for n, s in enumerate(x for xs in stages.values() for x in xs)}
    whole = F.coalesce(*(F.when(F.col(column) == k, F.array(*map(F.lit, xs))) for k, xs in stages.items()), F.array(F.col(column)))
    place = F.coalesce(*(F.when(F.col("stage") == s, n) for s, n in order.items()), F.lit(last))
    return df.withColumn("stage", F.explode(whole)).withColumn("place", place)


def append_suffix(c: Column, suffix: str) -> Column:
    return F.when(F.contains(c, F.lit(suffix)), c).otherwise(F.concat(c, F.lit(suffix)))


def reason_key(c: Column) -> Column:
    """A reason without the measure behind its colon."""
    return F.split_part(c, F.lit(":"), F.lit(1))


def jitter(seed: Column) -> Column:
    return F.pmod(seed, F.lit(997)) / 997.0 - 0.5


def merge_metrics(first: dict[str, Column], second: dict[str, Column]) -> Column:
    """One struct of both; where a metric is in both, the second holds."""
    return F.struct(*(c.alias(k) for k, c in (first | second).items()))


def river_width(flow: Column, main: bool) -> Column:
    low, high, base, gain = (22.0, 48.0, 22.0, 8.5) if main else (8.0, 20.0, 8.0, 4.2)
    return F.least(F.lit(high), F.greatest(F.lit(low), base + gain * F.log1p(flow)))


def taper(t: Column) -> Column:
    """Share of the full width along a line, t in [0, 1]: narrow at the head."""
    return 0.45 + 0.55 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
