"""Nearest, box, polygon and interval joins; none of them forms a cartesian product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasontide.config import LATITUDE_BANDS
from seasontide.functions import scalars as S
from seasontide.functions.ordering import keep_first
from seasontide.sources.schemas import WEATHER_ALIASES, WEATHER_KEPT

# ---------------------------------------------------------------- request windows


def location_year_windows(
    events: DataFrame, window: tuple[str, str] = ("03-01", "06-01")
) -> DataFrame:
    """One request per (location, year), spanning the season, with first-seen coordinates."""
    coords = keep_first(
        events.select("location_id", "latitude", "longitude", "stage_date"),
        ["location_id"],
        ["stage_date", "latitude", "longitude"],
    ).select("location_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    years = events.select("location_id", F.year("stage_date").alias("pull_year")).distinct()

    def day(md: str) -> Column:
        month, dom = (int(x) for x in md.split("-"))
        return F.make_date("pull_year", F.lit(month), F.lit(dom))

    return years.where("pull_year IS NOT NULL").join(coords, "location_id").select(
        F.col("location_id").cast("string").alias("location_id"),
        "lat",
        "lon",
        day(window[0]).alias("start_date"),
        day(window[1]).alias("end_date"),
        F.concat_ws("__", F.col("location_id").cast("string"), F.col("pull_year")).alias(
            "location_year_key"
        ),
        "pull_year",
    )


def location_windows(locations: DataFrame, start: str, end: str) -> DataFrame:
    """One request with the same explicit range per location."""
    first = keep_first(
        locations.select(
            F.col("location_id").cast("string").alias("location_id"),
            S.number(F.col("latitude")).alias("lat"),
            S.number(F.col("longitude")).alias("lon"),
        ),
        ["location_id"],
        ["lat", "lon"],
    )
    start_day = F.lit(start).cast("date")
    return first.withColumns(
        {
            "start_date": start_day,
            "end_date": F.lit(end).cast("date"),
            "pull_year": F.year(start_day),
            "location_year_key": F.concat_ws("__", "location_id", F.year(start_day)),
        }
    )


# ---------------------------------------------------------------- nearest point

# Cell sizes from the root down; each level splits a cell axis in four.  A level
# coarser than one degree has at most 64,800 cells whatever the data size.
DEGREE_LEVELS = (64.0, 16.0, 4.0, 1.0, 0.25)
SPHERE_LEVELS = (0.5, 0.125, 0.03125, 0.0078125)


def _cells(axes: Sequence[Column], size: float) -> list[Column]:
    return [F.floor(a / size).cast("int").alias(f"_c{i}") for i, a in enumerate(axes)]


def _box_bounds(axes: Sequence[Column], size: float) -> tuple[Column, Column]:
    """Smallest and largest squared distance from the point to its candidate cell."""
    near, far = F.lit(0.0), F.lit(0.0)
    for i, x in enumerate(axes):
        low = F.col(f"_c{i}") * F.lit(size)
        high = low + size
        gap = F.greatest(low - x, x - high, F.lit(0.0))
        reach = F.greatest(F.abs(x - low), F.abs(high - x))
        near, far = near + gap * gap, far + reach * reach
    return near, far


def _nearest(
    points: DataFrame,
    key: Sequence[str],
    grid: DataFrame,
    point_axes: Sequence[str],
    grid_axes: Sequence[str],
    levels: Sequence[float],
    extent: Sequence[tuple[float, float]],
) -> DataFrame:
    """Candidate (point, grid row) pairs that surely contain the nearest grid row.

    Walks down a tree of cells.  At each level a point keeps the non-empty cells
    that may hold something nearer than the worst case of its best cell; that is
    a handful per point, at any grid size.
    """
    dims = len(point_axes)
    axes = [F.col(a) for a in point_axes]
    per_point = Window.partitionBy(*key)
    cells = [f"_c{i}" for i in range(dims)]
    found = points
    for depth, size in enumerate(levels):
        for i, c in enumerate(cells):
            if depth == 0:
                low, high = extent[i]
                ids = F.sequence(
                    F.lit(int(low // size)), F.lit(int(high // size))
                )
                found = found.withColumn(c, F.explode(ids))
            else:
                base = F.col(c) * 4
                found = found.withColumn(c, F.explode(F.sequence(base, base + 3)))
        occupied = grid.select(*_cells([F.col(a) for a in grid_axes], size)).distinct()
        near, far = _box_bounds(axes, size)
        found = (
            found.join(occupied, cells, "left_semi")
            .withColumns({"_near": near, "_far": far})
            .withColumn("_limit", F.min("_far").over(per_point) * (1 + 1e-9) + 1e-15)
            .where(F.col("_near") <= F.col("_limit"))
            .drop("_near", "_far", "_limit")
        )
    placed = grid.select("*", *_cells([F.col(a) for a in grid_axes], levels[-1]))
    return found.join(placed, cells).drop(*cells)


def _distinct_grid(grid: DataFrame, lat: str, lon: str) -> DataFrame:
    """One grid row per place, coordinates as ``g_lat`` and ``g_lon``."""
    rows = grid.select(
        F.col("place_id").cast("string").alias("place_id"),
        S.number(F.col(lat)).alias("g_lat"),
        S.number(F.col(lon)).alias("g_lon"),
    ).where("place_id IS NOT NULL AND g_lat IS NOT NULL AND g_lon IS NOT NULL")
    return keep_first(rows, ["place_id"], ["g_lat", "g_lon"])


def _extent(grid: DataFrame) -> list[tuple[float, float]]:
    """Range of the grid's coordinates: its root cells, whatever the longitudes' convention.

    Coordinates of no map are rejected, as their root cells could not be listed.
    """
    finite = grid.where(~F.isnan("g_lat") & ~F.isnan("g_lon"))
    low, high, west, east = finite.agg(
        F.min("g_lat"), F.max("g_lat"), F.min("g_lon"), F.max("g_lon")
    ).first()
    if low is None:
        return [(0.0, 0.0), (0.0, 0.0)]
    if max(abs(low), abs(high)) > 90 or max(abs(west), abs(east)) > 720:
        raise ValueError(f"coordinates outside a map: latitude {low}..{high}, longitude {west}..{east}")
    return [(low, high), (west, east)]


def _with_nearest(
    points: DataFrame, grid: DataFrame, lat: str, lon: str, sphere: bool
) -> DataFrame:
    """Attach place_id, g_lat, g_lon and distance of the nearest grid row (ties: smaller id).

    The search runs once per distinct coordinate pair.
    """
    spots = points.select(F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon")).distinct()
    spots = spots.where("p_lat IS NOT NULL AND p_lon IS NOT NULL")
    if sphere:
        for df_name in ("p", "g"):
            vector = S.unit_vector(F.col(f"{df_name}_lat"), F.col(f"{df_name}_lon"))
            named = {f"{df_name}_{a}": v for a, v in zip("xyz", vector)}
            if df_name == "p":
                spots = spots.withColumns(named)
            else:
                grid = grid.withColumns(named)
        pairs = _nearest(
            spots,
            ["p_lat", "p_lon"],
            grid,
            ["p_x", "p_y", "p_z"],
            ["g_x", "g_y", "g_z"],
            SPHERE_LEVELS,
            [(-1.0, 1.0)] * 3,
        )
        distance = S.haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("g_lat"), F.col("g_lon"))
    else:
        pairs = _nearest(
            spots,
            ["p_lat", "p_lon"],
            grid,
            ["p_lat", "p_lon"],
            ["g_lat", "g_lon"],
            DEGREE_LEVELS,
            _extent(grid),
        )
        distance = F.pow(F.col("g_lat") - F.col("p_lat"), 2) + F.pow(
            F.col("g_lon") - F.col("p_lon"), 2
        )
    best = (
        pairs.withColumn("distance", distance)
        .groupBy("p_lat", "p_lon")
        .agg(
            F.min_by(
                F.struct("place_id", "g_lat", "g_lon", "distance"),
                F.struct("distance", "place_id"),
            ).alias("_best")
        )
        .select("p_lat", "p_lon", "_best.*")
    )
    # the same expressions produced both sides, so float equality is exact here
    return points.join(
        best, (F.col(lat) == F.col("p_lat")) & (F.col(lon) == F.col("p_lon"))
    ).drop("p_lat", "p_lon")


def nearest_centroid(
    locations: DataFrame, grid: DataFrame, lat: str = "centroid_lat", lon: str = "centroid_lon"
) -> DataFrame:
    """Nearest grid place of each location by squared degree distance.

    One location maps to one place; a place may serve many locations.
    """
    first = keep_first(
        locations.select(
            F.col("location_id").cast("string").alias("location_id"),
            S.number(F.col("latitude")).alias("latitude"),
            S.number(F.col("longitude")).alias("longitude"),
        ),
        ["location_id"],
        ["latitude", "longitude"],
    )
    matched = _with_nearest(
        first, _distinct_grid(grid, lat, lon), "latitude", "longitude", sphere=False
    )
    return matched.select(
        "location_id",
        "place_id",
        "latitude",
        "longitude",
        F.col("g_lat").alias("centroid_lat"),
        F.col("g_lon").alias("centroid_lon"),
        F.col("distance").alias("distance_sq_deg"),
    )


def remap_locations(weather: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-attach location ids to weather by place; unmapped places keep NULL."""
    pairs = mapping.select("place_id", "location_id").distinct()
    return weather.drop("location_id").join(pairs, "place_id", "left")


def nearest_haversine(requests: DataFrame, grid: DataFrame) -> DataFrame:
    """Nearest grid place of each ``loc`` by great-circle distance in km."""
    locs = keep_first(
        requests.select(
            "loc",
            S.number(F.col("latitude")).alias("input_lat"),
            S.number(F.col("longitude")).alias("input_lon"),
        ).where("loc IS NOT NULL AND input_lat IS NOT NULL AND input_lon IS NOT NULL"),
        ["loc"],
        ["input_lat", "input_lon"],
    )
    matched = _with_nearest(
        locs, _distinct_grid(grid, "centroid_lat", "centroid_lon"), "input_lat", "input_lon", True
    )
    return matched.select(
        "loc",
        "input_lat",
        "input_lon",
        "place_id",
        F.col("g_lat").alias("centroid_lat"),
        F.col("g_lon").alias("centroid_lon"),
        F.col("distance").alias("distance_km"),
    )


# ---------------------------------------------------------------- box search


def nearest_in_box(
    points: DataFrame, weather: DataFrame, start: str, end: str, box: float = 0.5
) -> DataFrame:
    """Per point and day, the nearest weather row inside a +-``box`` degree square.

    Only distinct coordinate pairs and distinct centroids are searched: points are
    copied to the nine cells around them, centroids stay in one cell, so the join is an
    equi-join on the cell that no day multiplies.  A centroid brings its days as one
    array, bounded by the calendar; per point and day the least (distance, place_id)
    wins as a partial aggregate of four narrow values.  Weather values are fetched for
    winners only, by centroid and date.  Of several weather rows of one centroid and
    date the least in the order of the columns counts.
    """
    days = (F.lit(start).cast("date"), F.lit(end).cast("date"))

    def cell(c: Column) -> Column:
        return F.floor(c / box).cast("int")

    around = F.sequence(F.lit(-1), F.lit(1))
    named = points.select(
        "point_id", F.col("latitude").alias("_plat"), F.col("longitude").alias("_plon")
    ).distinct()
    spread = (
        named.select("_plat", "_plon")
        .distinct()
        .withColumn("_dy", F.explode(around))
        .withColumn("_dx", F.explode(around))
        .select(
            "_plat",
            "_plon",
            (cell(F.col("_plat")) + F.col("_dy")).alias("_cy"),
            (cell(F.col("_plon")) + F.col("_dx")).alias("_cx"),
        )
    )
    daily = weather.where(F.col("date").between(*days))
    centroids = (
        daily.groupBy(
            F.col("place_id").alias("_place"),
            F.col("centroid_lat").alias("_clat"),
            F.col("centroid_lon").alias("_clon"),
        )
        .agg(F.collect_set("date").alias("_days"))
        .withColumns({"_cy": cell(F.col("_clat")), "_cx": cell(F.col("_clon"))})
    )
    inside = F.col("_clat").between(F.col("_plat") - box, F.col("_plat") + box) & F.col(
        "_clon"
    ).between(F.col("_plon") - box, F.col("_plon") + box)
    distance = S.haversine_km(F.col("_plat"), F.col("_plon"), F.col("_clat"), F.col("_clon"))
    winners = (
        spread.join(centroids, ["_cy", "_cx"])
        .where(inside)
        .withColumn("distance_km", distance)
        .withColumn("_near", F.struct("distance_km", "_place", "_clat", "_clon"))
        .select("_plat", "_plon", "_near", F.explode("_days").alias("_date"))
        .groupBy("_plat", "_plon", "_date")
        .agg(F.min("_near").alias("_near"))
        .select("_plat", "_plon", "_date", "_near.*")
    )
    kept = [F.col(c) for c in weather.columns if c != "date"]
    at = (
        F.col("place_id").eqNullSafe(F.col("_place"))
        & (F.col("centroid_lat") == F.col("_clat"))
        & (F.col("centroid_lon") == F.col("_clon"))
        & (F.col("date") == F.col("_date"))
    )
    nearest = (
        daily.join(winners, at)
        .groupBy("_plat", "_plon", "date")
        .agg(F.min(F.struct(*kept, "distance_km")).alias("_row"))
    )
    return named.join(nearest, ["_plat", "_plon"]).select("point_id", "date", "_row.*")


# ---------------------------------------------------------------- polygons


def polygon_rings(wkt: Column) -> Column:
    """Rings of a WKT polygon or multipolygon as arrays of (x, y) vertices."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def vertex(pair: Column) -> Column:
        xy = F.split(F.trim(pair), r"\s+")
        return F.struct(
            F.get(xy, F.lit(0)).cast("double").alias("x"),
            F.get(xy, F.lit(1)).cast("double").alias("y"),
        )

    return F.transform(rings, lambda r: F.transform(F.split(r, ","), vertex))


def ring_edges(rings: Column) -> Column:
    """All edges (x1, y1, x2, y2) of all rings."""

    def edges(ring: Column) -> Column:
        tails = F.slice(ring, F.lit(1), F.size(ring) - 1)
        heads = F.slice(ring, F.lit(2), F.size(ring) - 1)
        return F.zip_with(
            tails,
            heads,
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )

    return F.flatten(F.transform(rings, edges))


def within(x: Column, y: Column, edges: Column) -> Column:
    """Strictly inside by the even-odd rule; a point on an edge is outside."""

    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (cross == 0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
        return straddles & (x < at + e["x1"])

    return ~F.exists(edges, touches) & (F.size(F.filter(edges, crosses)) % 2 == 1)


def locate_in_cells(locations: DataFrame, cells: DataFrame) -> DataFrame:
    """Place whose polygon contains each location; unmatched locations keep NULL.

    A polygon lives at the power-of-two cell size that spans its bounding box,
    so it covers at most four cells; a location is looked up once per size in use.
    """
    vertices = F.flatten(F.col("_rings"))
    xs = F.transform(vertices, lambda v: v["x"])
    ys = F.transform(vertices, lambda v: v["y"])
    bounds = {
        "_x0": F.array_min(xs),
        "_x1": F.array_max(xs),
        "_y0": F.array_min(ys),
        "_y1": F.array_max(ys),
    }
    span = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(2.0**-10))
    shapes = (
        cells.select(
            F.col("place_id").cast("string").alias("place_id"),
            polygon_rings(F.col("boundary")).alias("_rings"),
        )
        .withColumns(bounds)
        .withColumn("_level", F.greatest(S.log2_ceil(span), F.lit(-10)))
        .withColumn("_edges", ring_edges(F.col("_rings")))
        .drop("_rings")
    )

    def cell(value: Column) -> Column:
        return F.floor(value / F.pow(F.lit(2.0), F.col("_level"))).cast("int")

    covered = shapes.withColumn(
        "_cx", F.explode(F.sequence(cell(F.col("_x0")), cell(F.col("_x1"))))
    ).withColumn("_cy", F.explode(F.sequence(cell(F.col("_y0")), cell(F.col("_y1")))))
    # at most twenty sizes exist between 2^-10 and 2^9 degrees
    levels = shapes.agg(F.collect_set("_level").alias("levels")).scalar()
    spots = (
        locations.select("location_id", "latitude", "longitude")
        .distinct()
        .withColumn("_level", F.explode(levels))
        .withColumns({"_cx": cell(F.col("longitude")), "_cy": cell(F.col("latitude"))})
    )
    hits = (
        spots.join(covered, ["_level", "_cx", "_cy"])
        .where(
            F.col("longitude").between(F.col("_x0"), F.col("_x1"))
            & F.col("latitude").between(F.col("_y0"), F.col("_y1"))
        )
        .where(within(F.col("longitude"), F.col("latitude"), F.col("_edges")))
        .select("location_id", "latitude", "longitude", "place_id")
    )
    return locations.join(hits, ["location_id", "latitude", "longitude"], "left")


# ---------------------------------------------------------------- interval joins


def trim_to_windows(weather: DataFrame, windows: DataFrame) -> DataFrame:
    """Weather rows inside the requested window of their location and year."""
    w = windows.select(
        F.col("location_id").alias("_loc"),
        F.col("pull_year").alias("_year"),
        F.col("start_date").alias("_start"),
        F.col("end_date").alias("_end"),
    )
    condition = (
        (F.col("location_id") == F.col("_loc"))
        & (F.year("date") == F.col("_year"))
        & F.col("date").between(F.col("_start"), F.col("_end"))
    )
    return weather.join(w, condition, "left_semi")


def interval_join(weather: DataFrame, windows: DataFrame, loc_map: DataFrame) -> DataFrame:
    """Every (weather row, request window) pair of a place, bounds included, with audit columns.

    Windows are copied to the calendar months they touch, so the join key is
    (place, month) and a long history is never paired with every window of its place.
    """
    month = F.trunc("date", "month")
    mapped = windows.join(
        loc_map.select("loc", "place_id", "input_lat", "input_lon", "distance_km"), "loc"
    ).select("loc", "place_id", "start_date", "end_date", "input_lat", "input_lon", "distance_km")
    spread = mapped.where("start_date <= end_date").withColumn(
        "_month",
        F.explode(
            F.sequence(
                F.trunc("start_date", "month"),
                F.trunc("end_date", "month"),
                F.expr("INTERVAL '1' MONTH"),
            )
        ),
    )
    return (
        weather.withColumn("_month", month)
        .join(spread, ["place_id", "_month"])
        .where(F.col("date").between(F.col("start_date"), F.col("end_date")))
        .drop("_month")
    )


def request_summary(strict: DataFrame, loc_map: DataFrame) -> DataFrame:
    """Rows, date range and distinct places per request location."""
    summary = strict.groupBy("loc").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.countDistinct("place_id").alias("n_place_ids"),
    )
    audit = loc_map.select("loc", "place_id", "centroid_lat", "centroid_lon", "distance_km")
    return summary.join(audit, "loc", "left")


# ---------------------------------------------------------------- scope and coverage


def custom_location_id(lat: Column, lon: Column) -> Column:
    return F.format_string("custom_gridpoint_%09.5f_%010.5f", lat, lon)


def map_custom_points(points: DataFrame, coverage: DataFrame) -> DataFrame:
    """Nearest coverage centroid of each custom point, with a synthetic id where none exists."""
    typed = points.select(
        F.col("name").alias("input_name"),
        S.number(F.col("latitude")).alias("input_latitude"),
        S.number(F.col("longitude")).alias("input_longitude"),
    )
    cover = coverage.select(
        "centroid_lat", "centroid_lon", "location_id", "place_id", "latitude", "longitude"
    )
    centroids = keep_first(
        cover, ["centroid_lat", "centroid_lon"], ["place_id", "location_id"]
    ).withColumns({"g_lat": F.col("centroid_lat"), "g_lon": F.col("centroid_lon")})
    matched = _with_nearest(
        typed,
        centroids.select("place_id", "g_lat", "g_lon"),
        "input_latitude",
        "input_longitude",
        False,
    )
    details = centroids.select(
        F.col("place_id").alias("_pid"),
        "g_lat",
        "g_lon",
        F.col("location_id").alias("source_location_id"),
        F.col("latitude").alias("_lat"),
        F.col("longitude").alias("_lon"),
    )
    full = matched.join(details, ["g_lat", "g_lon"])
    return full.select(
        "input_name",
        "input_latitude",
        "input_longitude",
        F.col("g_lat").alias("mapped_centroid_latitude"),
        F.col("g_lon").alias("mapped_centroid_longitude"),
        F.col("source_location_id").cast("string").alias("source_location_id"),
        F.coalesce(
            F.col("source_location_id").cast("string"),
            custom_location_id(F.col("g_lat"), F.col("g_lon")),
        ).alias("location_id"),
        F.col("_pid").cast("string").alias("place_id"),
        F.coalesce("_lat", "g_lat").alias("latitude"),
        F.coalesce("_lon", "g_lon").alias("longitude"),
    )


def resolve_scope(
    coverage: DataFrame, ids: DataFrame | None = None, mapped: DataFrame | None = None
) -> DataFrame:
    """Prediction scope: selected ids and mapped points, or the whole coverage."""
    cols = ["centroid_lat", "centroid_lon", "place_id", "location_id", "latitude", "longitude"]
    parts = []
    if ids is not None:
        parts.append(coverage.join(ids.select("location_id"), "location_id", "left_semi").select(cols))
    if mapped is not None:
        parts.append(
            mapped.withColumnsRenamed(
                {
                    "mapped_centroid_latitude": "centroid_lat",
                    "mapped_centroid_longitude": "centroid_lon",
                }
            ).select(cols)
        )
    if not parts:
        parts = [coverage.select(cols)]
    scope = parts[0].withColumn("_part", F.lit(0))
    for part in parts[1:]:
        scope = scope.unionByName(part.withColumn("_part", F.lit(1)))
    scope = scope.dropna(subset=["location_id", "latitude", "longitude"])
    return keep_first(scope, ["location_id"], ["_part", "place_id", "centroid_lat"]).drop("_part")


def normalize_weather(df: DataFrame) -> DataFrame:
    """Short measure names and only the kept columns."""
    renamed = df.withColumnsRenamed(WEATHER_ALIASES)
    return renamed.select(*[c for c in WEATHER_KEPT if c in renamed.columns])


def grid_points(weather: DataFrame, day: str) -> DataFrame:
    """Distinct places with a centroid on one day."""
    rows = (
        weather.where(F.col("date") == F.lit(day).cast("date"))
        .select("place_id", "centroid_lat", "centroid_lon")
        .dropna()
    )
    return keep_first(rows, ["place_id"], ["centroid_lat", "centroid_lon"])


def latitude_band(latitude: Column, bands=LATITUDE_BANDS) -> Column:
    label = F.lit(None).cast("string")
    for low, high, name in bands:
        label = F.when((latitude >= low) & (latitude < high), name).otherwise(label)
    return label


def band_coverage(
    coverage: DataFrame, states: Sequence[str], bands=LATITUDE_BANDS, north: float = 45.0
) -> DataFrame:
    """Coverage of the chosen states south of a limit, with its latitude band, one row per place."""
    banded = (
        coverage.where(
            F.col("state_code").cast("string").isin(list(states))
            & (F.col("centroid_lat") < north)
        )
        .withColumn("lat_band", latitude_band(F.col("centroid_lat"), bands))
        .where("lat_band IS NOT NULL")
    )
    return keep_first(banded, ["place_id"], ["centroid_lat", "centroid_lon", "state_code"])


def enrich_weather(weather: DataFrame, coverage: DataFrame) -> DataFrame:
    """Weather with its coverage metadata; joined on place_id, never on float centroids."""
    extra = [c for c in coverage.columns if c == "place_id" or c not in weather.columns]
    return weather.join(coverage.select(*extra), "place_id")
