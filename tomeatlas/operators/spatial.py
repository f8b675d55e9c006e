"""Nearest city, radius and nearest-neighbour joins, bounds, clusters, stacks, density, tours.

Point-to-point work is an equi-join on grid cells followed by an exact distance filter. The
smaller side is repeated over its neighbouring cells and over a few salts, so that a cell which
holds a large share of all points is spread over several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions.expr import let, records, text
from tomeatlas.functions.geo import (
    EARTH_KM,
    EARTH_M,
    haversine,
    grid_cell,
    neighbour_cells,
    wrapped_lon_cell,
)
from tomeatlas.operators.dedup import top_k_per_group
from tomeatlas.plans.scratch import materialise
from tomeatlas.schema import ensure

# ---- nearest of a short list of cities ----


def nearest_seed_city(
    lon: Column | str, lat: Column | str, seeds: Sequence[Sequence[str]] = vocab.SEED_CITIES
) -> Column:
    """``struct(city, region, country, distance_km)`` of the nearest city of a constant list.

    The list is part of the expression, so no join and no shuffle is needed. Candidates are ordered
    by the half chord, which grows with distance; the distance is computed once for the winner.
    """
    lon = F.col(lon) if isinstance(lon, str) else lon
    lat = F.col(lat) if isinstance(lat, str) else lat
    table = records(
        [
            {"lon": float(r[1]), "lat": float(r[2]), "cos": math.cos(math.radians(float(r[2]))), "i": i}
            for i, r in enumerate(seeds)
        ],
        "lon:double,lat:double,cos:double,i:int",
    )
    names = records(
        [{"city": r[0], "region": r[3], "country": r[4]} for r in seeds], "city:string,region:string,country:string"
    )

    def best(point: Column) -> Column:
        def score(c: Column) -> Column:
            s1 = F.sin((c["lat"] - point["lat"]) * (math.pi / 360))
            s2 = F.sin((c["lon"] - point["lon"]) * (math.pi / 360))
            return F.struct((s1 * s1 + point["cos"] * c["cos"] * s2 * s2).alias("h"), c["i"].alias("i"))

        return F.array_min(F.transform(table, score))["i"]

    point = F.struct(lon.alias("lon"), lat.alias("lat"), F.cos(F.radians(lat)).alias("cos"))

    def result(i: Column) -> Column:
        found, at = F.get(names, i), F.get(table, i)
        return F.struct(
            found["city"].alias("city"),
            found["region"].alias("region"),
            found["country"].alias("country"),
            haversine(at["lon"], at["lat"], lon, lat, EARTH_KM).alias("distance_km"),
        )

    located = lon.isNotNull() & lat.isNotNull()
    return F.when(located, let(let(point, best), result))


# ---- radius join ----


def _salted(df: DataFrame, key: str, salts: int) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))


def _over_salts(df: DataFrame, salts: int) -> DataFrame:
    """Rows repeated over the salts. Spark's size estimate leaves out the repeats here and in cells, so the join is told to shuffle."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")


def within_radius(
    points: DataFrame, centres: DataFrame, radius_m: float, key: str = "ord", salts: int = 8
) -> DataFrame:
    """Every (centre, point) pair within ``radius_m`` with its distance.

    ``centres`` has centre_id, centre_lon, centre_lat.
    """
    degrees = max(math.degrees(radius_m / EARTH_M), 0.01)
    cells = centres.select(
        "centre_id", "centre_lon", "centre_lat",
        F.inline(neighbour_cells("centre_lon", "centre_lat", radius_m, degrees)),
    )
    located = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumns(
        {"cx": wrapped_lon_cell("lon", degrees), "cy": grid_cell("lat", degrees)}
    )
    joined = _salted(located, key, salts).join(_over_salts(cells, salts), ["cx", "cy", "_salt"])
    return (
        joined.withColumn("distance_m", haversine("centre_lon", "centre_lat", "lon", "lat", EARTH_M))
        .filter(F.col("distance_m") <= radius_m)
        .drop("cx", "cy", "_salt")
    )


def in_box(lon: float, lat: float, radius_m: float) -> Column:
    """Bounding box of a circle as a predicate that the file scan can use to skip data."""
    dlat = math.degrees(radius_m / EARTH_M) * 1.000001
    low, high = lat - dlat, lat + dlat
    band = F.col("lat").between(low, high)
    ratio = math.sin(min(math.radians(dlat), math.pi / 2)) / max(math.cos(math.radians(lat)), 1e-12)
    if low <= -90 or high >= 90 or ratio >= 1:
        return band
    dlon = math.degrees(math.asin(ratio)) * 1.000001
    west, east = lon - dlon, lon + dlon
    spans = F.col("lon").between(west, east)
    if west < -180:
        spans = spans | (F.col("lon") >= west + 360)
    if east > 180:
        spans = spans | (F.col("lon") <= east - 360)
    return band & spans


def near_point(
    df: DataFrame, lon: float, lat: float, radius_m: float = 50_000, k: int = 20, min_hits: int = 3
) -> DataFrame:
    """Nearest rows inside the radius, or the nearest anywhere when fewer than ``min_hits`` are inside.

    The rows in the box around the circle are read first. Only if they hold too few hits does a guard let the other rows
    pass: it is one number, known before they are read.
    """
    located = df.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    exact = haversine(F.lit(lon), F.lit(lat), "lon", "lat", EARTH_M)
    near = located.filter(in_box(lon, lat, radius_m))
    if min_hits > 0:
        few = near.agg(F.count_if(exact <= radius_m) < min_hits).scalar()
        near = near.unionByName(located.filter(few & ~F.coalesce(in_box(lon, lat, radius_m), F.lit(False))))
    ranked = (
        near.withColumn("_exact", exact)
        .withColumn("distance_m", F.round("_exact", 1))
        .orderBy("_exact", "ord")
        .limit(max(k, min_hits))
    )
    inside = F.col("_exact") <= radius_m
    enough = ranked.agg(F.count_if(inside) >= min_hits).scalar()
    return (
        ranked.withColumn("fallback", ~enough)
        .filter(inside | F.col("fallback"))
        .orderBy("distance_m", "ord")
        .limit(k)
        .drop("_exact")
    )


# ---- nearest-neighbour join ----

_LEVELS = range(1, 11)  # cell width 360 / 2**level degrees: 180 down to 0.35


def _width(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _cell(c: Column, level: Column, offset: float) -> Column:
    return F.floor((c + offset) / _width(level)).cast("bigint")


def _block_counts(points: DataFrame) -> DataFrame:
    """Number of points per grid cell on every level, rolled up from the finest one."""
    finest = max(_LEVELS)
    level = F.lit(finest)
    columns = F.pmod(_cell(F.col("lon"), level, 180.0), F.lit(2**finest))
    fine = points.groupBy(columns.alias("fx"), _cell(F.col("lat"), level, 90.0).alias("fy")).count()
    rolled = fine.withColumn("level", F.explode(F.sequence(F.lit(0), level)))
    shift = F.lit(finest) - F.col("level")

    def up(c: str) -> Column:
        return F.floor(F.col(c) / F.pow(F.lit(2.0), shift)).cast("bigint")

    return rolled.groupBy("level", up("fx").alias("bx"), up("fy").alias("by")).agg(F.sum("count").alias("n"))


def _reach(lon: Column, lat: Column, fit: Column) -> Column:
    """Metres within which all points of the 3 x 3 block of level ``fit`` around a point lie."""
    width, across = _width(fit), F.least(_cell(lon, fit, 180.0), F.pow(F.lit(2.0), fit).cast("bigint") - 1)

    def farthest(c: Column, offset: float, cell: Column) -> Column:
        inside = c + offset - cell * width
        return F.least(width + F.greatest(inside, width - inside), F.lit(180.0))

    dlon, dlat = farthest(lon, 180.0, across), farthest(lat, 90.0, _cell(lat, fit, 90.0))
    # longitudes are closest together at the latitude of the block that is nearest to a pole; the widest one counts
    widest = F.cos(F.radians(F.greatest(F.abs(lat) - dlat, F.lit(0.0))))
    narrowing = F.when(F.abs(lat) > 90, F.lit(1.0)).otherwise(F.greatest(F.cos(F.radians(lat)) * widest, F.lit(0.0)))
    s1, s2 = F.sin(F.radians(dlat / 2)), F.sin(F.radians(dlon / 2))
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(s1 * s1 + narrowing * s2 * s2, F.lit(1.0)))) * 1.000001 + 0.01


def knn(points: DataFrame, centres: DataFrame, k: int, key: str = "ord", salts: int = 8) -> DataFrame:
    """The ``k`` nearest points of every centre, ties in list order, with rank and distance.

    For each centre the finest grid level is found whose 3 x 3 block holds k points. The farthest
    corner of that block bounds the k-th distance; a radius join with that bound then yields the
    exact answer: only cells that the circle meets are asked for, and pairs beyond it are dropped
    where they meet, before any is sorted or shuffled. Points sharing a coordinate beyond the first k in list
    order can never be chosen and are dropped first, so crowded coordinates stay small.
    """
    located = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    located = top_k_per_group(located, ["lon", "lat"], [key], k, rank="_copy").drop("_copy")
    counts = _block_counts(located.select("lon", "lat").filter((F.abs("lat") <= 90) & (F.abs("lon") < math.inf)))

    level = F.col("level")
    ring = F.pow(F.lit(2.0), level).cast("bigint")
    steps = F.array(*[F.lit(i).cast("bigint") for i in (-1, 0, 1)])
    cx = F.least(_cell(F.col("centre_lon"), level, 180.0), ring - 1)
    cy = _cell(F.col("centre_lat"), level, 90.0)
    block = F.array_distinct(
        F.flatten(
            F.transform(
                steps,
                lambda i: F.transform(
                    steps, lambda j: F.struct(F.pmod(cx + i, ring).alias("bx"), (cy + j).alias("by"))
                ),
            )
        )
    )
    around = centres.withColumn("level", F.explode(F.array(*[F.lit(i) for i in _LEVELS]))).select(
        "centre_id", "level", F.inline(block)
    )
    enough = (
        around.hint("merge").join(counts, ["level", "bx", "by"])
        .groupBy("centre_id", "level")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= k)
        .groupBy("centre_id")
        .agg(F.max("level").alias("fit"))
    )
    # join level: two above, where one cell is wider than the bound; level 0 is the whole globe
    join_level = F.greatest(F.coalesce(F.col("fit"), F.lit(0)) - 2, F.lit(0))
    reach = F.coalesce(_reach(F.col("centre_lon"), F.col("centre_lat"), F.col("fit")), F.lit(math.inf))
    # centres that share an id are answered together
    together = F.max(reach).over(Window.partitionBy("centre_id"))
    asked = centres.join(enough, "centre_id", "left").withColumns({"level": join_level, "_reach": together})
    covering = F.when(
        level == 0, F.array(F.struct(F.lit(0).cast("bigint").alias("cx"), F.lit(0).cast("bigint").alias("cy")))
    )
    for m in range(1, max(_LEVELS) - 1):
        cells = neighbour_cells("centre_lon", "centre_lat", F.col("_reach"), 360.0 / 2**m)
        covering = covering.when(
            level == m,
            F.transform(cells, lambda c: F.struct(c["cx"].alias("cx"), c["cy"].alias("cy"))),
        )
    wanted = asked.select("centre_id", "centre_lon", "centre_lat", "level", "_reach", F.inline(covering))
    used = F.array(*[F.lit(m) for m in range(0, max(_LEVELS) - 1)])
    placed = located.withColumn("level", F.explode(used)).withColumns(
        {
            "cx": F.when(level == 0, F.lit(0).cast("bigint")).otherwise(
                F.pmod(_cell(F.col("lon"), level, 180.0), ring)
            ),
            "cy": F.when(level == 0, F.lit(0).cast("bigint")).otherwise(
                F.floor(F.col("lat") / _width(level)).cast("bigint")
            ),
        }
    )
    # copies of a point on levels and in cells that nobody asks for go before the shuffle
    placed = placed.join(wanted.select("level", "cx", "cy").distinct().hint("merge"), ["level", "cx", "cy"], "left_semi")
    joined = _salted(placed, key, salts).join(_over_salts(wanted, salts), ["level", "cx", "cy", "_salt"])
    joined = joined.withColumn("distance_m", haversine("centre_lon", "centre_lat", "lon", "lat", EARTH_M))
    # pairs whose distance is unknown stay
    joined = joined.filter(F.coalesce((F.col("distance_m") <= F.col("_reach")) | F.isnan("distance_m"), F.lit(True))).drop("level", "cx", "cy", "_salt", "_reach")
    return top_k_per_group(joined, ["centre_id"], ["distance_m", key], k)


def nearest_city(df: DataFrame, cities: DataFrame, key: str = "ord") -> DataFrame:
    """Each row with its nearest city of a table: the columns of ``cities`` with ``near_`` before their names, and near_km.

    ``cities`` has lon, lat and ``key``, by which equally near ones are ordered; it may be large and is not broadcast as such.
    Each coordinate is looked up once, so rows that share one cost a join on it. A row without a coordinate, or with no city
    to be near to, has nulls. Cities without a coordinate are left out.
    """
    asked = df.select(F.col("lon").alias("centre_lon"), F.col("lat").alias("centre_lat")).filter("centre_lon is not null and centre_lat is not null").distinct()
    asked = materialise(asked.withColumn("centre_id", F.monotonically_increasing_id()), "coordinates")
    named = cities.select(*[F.col(c).alias(f"near_{c}") for c in cities.columns], "lon", "lat")
    # the asked coordinates are the large side here, so they are not repeated over salts
    found = knn(named, asked, 1, f"near_{key}", salts=1)
    found = found.select("centre_lon", "centre_lat", *[f"near_{c}" for c in cities.columns], (F.col("distance_m") / 1000).alias("near_km"))
    here = (F.col("lon") == F.col("centre_lon")) & (F.col("lat") == F.col("centre_lat"))
    return df.join(found, here, "left").drop("centre_lon", "centre_lat")


def nearby(
    points: DataFrame, centres: DataFrame, radius_m: float, k: int, min_hits: int = 3, key: str = "ord"
) -> DataFrame:
    """Per centre the ``k`` nearest points inside the radius, or, with fewer than ``min_hits``
    inside, the ``k`` nearest anywhere (``fallback``).

    The nearest ``max(k, min_hits)`` points anywhere say both, so a circle that holds many points is not gone through. A
    centre without an id is not counted as served.
    """
    near = knn(points, centres, max(k, min_hits), key)
    inside = F.coalesce(F.col("distance_m") <= radius_m, F.lit(False))
    hits = F.count_if(inside).over(Window.partitionBy("centre_id"))
    fallback = (hits < max(min_hits, 1)) | F.col("centre_id").isNull()
    near = near.withColumn("fallback", fallback).filter(F.col("rank") <= k)
    return near.filter(F.col("fallback") | inside)


# ---- bounds, clusters, stacks, density ----

# Smallest span in degrees, padding, box shown when there is nothing to show.
MIN_SPAN, PADDING = 0.02, 0.15
DEFAULT_BOX = {"min_lng": 72.7277, "max_lng": 73.0277, "min_lat": 18.976, "max_lat": 19.176}


def bounds(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Padded bounding box per group, the default box when there is no point at all."""
    box = df.groupBy(*by).agg(
        F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")
    )
    pad_x = F.greatest(F.col("e") - F.col("w"), F.lit(MIN_SPAN)) * PADDING
    pad_y = F.greatest(F.col("n") - F.col("s"), F.lit(MIN_SPAN)) * PADDING
    edges = {
        "min_lng": F.col("w") - pad_x, "max_lng": F.col("e") + pad_x,
        "min_lat": F.col("s") - pad_y, "max_lat": F.col("n") + pad_y,
    }
    return box.select(*by, *[F.coalesce(v, F.lit(DEFAULT_BOX[k])).alias(k) for k, v in edges.items()])


def city_clusters(df: DataFrame, min_entries: int = 2) -> DataFrame:
    """Entries, distinct authors and first coordinates of every city with several entries."""
    return (
        df.groupBy("place_name")
        .agg(
            F.count("*").alias("entries"),
            F.count_distinct(text("author")).alias("authors"),
            F.min_by(F.struct("lon", "lat"), "ord").alias("at"),
        )
        .filter(F.col("entries") >= min_entries)
        .select("place_name", "entries", "authors", F.col("at.lon").alias("lon"), F.col("at.lat").alias("lat"))
    )


def _stacks(df: DataFrame, representative: Column) -> DataFrame:
    first = F.struct("id", "lon", "lat")
    return (
        df.groupBy("place_name", F.round("lon", 6).alias("_lon6"), F.round("lat", 6).alias("_lat6"))
        .agg(
            F.count("*").alias("entries"),
            F.avg(F.coalesce("polarity", F.lit(0.0))).alias("avg_polarity"),
            F.max_by(first, representative).alias("rep"),
        )
        .select(
            "place_name", F.col("rep.lon").alias("lon"), F.col("rep.lat").alias("lat"), "entries",
            "avg_polarity", F.col("rep.id").alias("representative_id"),
        )
    )


def scatter_stacks(df: DataFrame) -> DataFrame:
    """Entries that share place and point; represented by gold, then the longest passage."""
    df = ensure(df, "quality_tier")
    gold = F.coalesce("quality_tier", F.lit("stub")) == "gold"
    return _stacks(df, F.struct(gold, F.length(text("passage")), -F.col("ord")))


def background_stacks(everything: DataFrame, filtered: DataFrame) -> DataFrame:
    """Stacks of the entries that the filter left out, represented by the first one."""
    rest = everything.join(filtered.select("id").distinct(), "id", "left_anti")
    return _stacks(rest, -F.col("ord"))


def density_grid(df: DataFrame, degrees: float) -> DataFrame:
    """Weight per grid cell: 3 for a primary setting, 1 otherwise."""
    weight = F.when(text("setting_type") == "primary", F.lit(3)).otherwise(F.lit(1))
    return (
        ensure(df, "setting_type")
        .filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .groupBy(grid_cell("lon", degrees).alias("cx"), grid_cell("lat", degrees).alias("cy"))
        .agg(F.sum(weight).alias("weight"))
    )


# ---- walking tours ----


def _walk(stops: Column) -> Column:
    """Visit order (stop, id, leg_m, total_m) over stops sorted by rank, always on to the nearest one left."""

    def entry(n: Column, stop: Column, leg: Column, total: Column) -> Column:
        return F.struct(n.alias("stop"), stop["id"].alias("id"), leg.alias("leg_m"), total.alias("total_m"))

    def on(state: Column, n: Column) -> Column:
        here = state["here"]
        legs = F.transform(
            state["left"],
            lambda s: F.struct(haversine(here["lon"], here["lat"], s["lon"], s["lat"], EARTH_M).alias("leg"), s["rank"].alias("rank"), s.alias("to")),
        )
        return let(
            F.array_min(legs),
            lambda best: F.struct(
                F.filter(state["left"], lambda s: s["rank"] != best["rank"]).alias("left"),
                best["to"].alias("here"),
                F.concat(state["tour"], F.array(entry(n, best["to"], best["leg"], F.element_at(state["tour"], -1)["total_m"] + best["leg"]))).alias("tour"),
            ),
        )

    first = F.get(stops, F.lit(0))
    begun = F.struct(
        F.slice(stops, 2, F.size(stops)).alias("left"), first.alias("here"),
        F.array(entry(F.lit(1), first, first["distance_m"], first["distance_m"])).alias("tour"),
    )
    return F.aggregate(F.sequence(F.lit(2), F.size(stops)), begun, on, lambda state: state["tour"])


def walking_tours(near: DataFrame, reach_m: float = 5_000, stops: int = 8) -> DataFrame:
    """Tour per centre over its closest places (centre_id, id, lon, lat, distance_m, ord): start at
    the closest, then always the nearest one left; at least two stops."""
    close = top_k_per_group(near.filter(F.col("distance_m") <= reach_m).drop("rank"), ["centre_id"], ["distance_m", "ord"], stops)
    packed = (
        close.groupBy("centre_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "id", "lon", "lat", "distance_m"))).alias("stops"))
        .filter(F.size("stops") >= 2)
    )
    return packed.select("centre_id", F.inline(_walk(F.col("stops"))))


