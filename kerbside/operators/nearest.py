"""Nearest postcodes (NEAR1): distance <= radius, nearest ``limit`` per origin.

Spark would run the raw predicate as a nested-loop join, so the plan is an
equi-join on the cells of a grid on the sphere:

* A level cuts the latitudes into bands of equal height, and every band into
  its own number of cells, each at least as wide as high.  Columns count
  modulo that number, so cells go on across the antimeridian, and a band at a
  pole is a few cells around it.  Level 0 has half the radius, and every next
  level half the height.
* The level of an origin comes from counts: the finest one whose cell around
  the origin holds ``limit`` points.  All of them lie within the farthest
  corner of that cell, so the search may stop at that distance (the origin's
  *reach*); elsewhere the reach is the radius.  Levels are counted four at a
  time, and only among points whose last counted cell was dense.
* The origins of one cell of their level are a *tile*, in parts of about
  ``TILE_ORIGINS`` if they are many.  A tile gets one copy of every point in
  the cells that its origins' reach can touch (about 25 cells for an origin
  away from the poles, some 100 at one).  All pairs of an origin so come about
  in one task, and none is ever shuffled.
* Pairs are met twice.  The first time they are only counted by rings around
  the origin, and the reach shrinks to the smallest ring with ``limit`` points;
  the second time the pairs within it, hardly more than ``limit``, are ranked.

What is exchanged and sorted thus grows with the points and the result, not
with the pairs.  A cluster holding a third of all postcodes is met tile by tile.
Postcodes sharing one exact point are cut to the ``limit`` smallest names
(the rest can never rank).  What stays unbounded is a cell with many distinct
points next to an origin whose own cell is not dense: those distances must be
looked at.

With given origins the points are first cut to the box and then to the level-0
cells around them, before anything is counted or staged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.plans.stage import materialize

TILE = ["lv", "trow", "tcol", "part"]
TILE_ORIGINS = 512  # origins of one part of a tile, about
TASK_ORIGINS = 8192  # origins whose pairs one task ranks: some hundred MB to sort
RINGS = [0.8**i for i in range(16)]  # areas of the rings, of the circle within reach

# Fixed values of the nearby search.
NEARBY_LIMIT = 100
NEARBY_RADIUS_M = 2000.0
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0

MAX_LEVEL = 18  # cells of a few millimetres at the default radius
STEP = 4  # levels counted in one pass
PAD = 1e-10  # degrees (0.01 mm): rounding never loses a cell
RESULT = "origin string, rank int, postcode string, latitude double, longitude double, distance double"


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dl = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


class Grid:
    """Cells of the sphere at every level, for one search radius."""

    def __init__(self, radius_m: float):
        self.top = min(radius_m / METRES_PER_DEGREE / 2.0, 90.0)  # height of a level-0 band in degrees

    def height(self, level: Column) -> Column:
        return F.lit(self.top) / F.pow(F.lit(2.0), level)

    def row(self, lat: Column, level: Column) -> Column:
        return F.floor((lat + 90.0) / self.height(level))

    def _edges(self, row: Column, level: Column) -> tuple[Column, Column]:
        """Latitudes where a band begins and ends."""
        low = row * self.height(level) - 90.0
        return low, F.least(low + self.height(level), F.lit(90.0))

    def columns(self, row: Column, level: Column) -> Column:
        """Cells of a band: as wide as high where the band is shortest."""
        low, high = self._edges(row, level)
        narrow = F.cos(F.radians(F.greatest(F.abs(low), F.abs(high))))
        return F.greatest(F.floor(narrow * 360.0 / self.height(level)), F.lit(1))

    def column(self, lon: Column, row: Column, level: Column) -> Column:
        n = self.columns(row, level)
        return F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n), n - 1)

    def far_corner(self, lat: Column, lon: Column, level: Column) -> Column:
        """No point of the cell around a place is farther from it (metres)."""
        row = self.row(lat, level)
        low, high = self._edges(row, level)
        width = F.lit(360.0) / self.columns(row, level)
        inside = F.pmod(F.pmod(lon + 180.0, F.lit(360.0)), width)
        dlat = F.greatest(lat - low, high - lat) + PAD
        dlon = F.least(F.greatest(inside, width - inside) + PAD, F.lit(180.0))
        wide = F.cos(F.radians(F.when(low * high <= 0, F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))))
        a = F.pow(F.sin(F.radians(dlat) / 2), 2) + F.cos(F.radians(lat)) * wide * F.pow(F.sin(F.radians(dlon) / 2), 2)
        return F.lit(2 * EARTH_RADIUS_M * (1 + 1e-9)) * F.asin(F.sqrt(F.least(a, F.lit(1.0)))) + 1e-4

    def around(self, lat: Column, lon: Column, reach_m: Column, level: Column) -> Column:
        """Array of (row, col): the cells within reach of a place, each once."""
        reach = reach_m / METRES_PER_DEGREE + PAD
        rows = F.sequence(
            self.row(F.greatest(lat - reach, F.lit(-90.0)), level), self.row(F.least(lat + reach, F.lit(90.0)), level)
        )
        # the widest a circle gets in longitude; one that holds a pole has every longitude
        swing = F.when(F.abs(lat) + reach >= 90.0, F.lit(360.0)).otherwise(
            F.degrees(F.asin(F.least(F.sin(F.radians(reach)) / F.cos(F.radians(lat)), F.lit(1.0)))) + PAD
        )

        def cells(row: Column) -> Column:
            n = self.columns(row, level)
            first = F.floor((lon - swing + 180.0) / 360.0 * n)
            last = F.floor((lon + swing + 180.0) / 360.0 * n)
            every = last - first + 1 >= n
            spanned = F.sequence(F.when(every, F.lit(0)).otherwise(first), F.when(every, n - 1).otherwise(last))
            return F.transform(spanned, lambda c: F.struct(row.alias("row"), F.pmod(c, n).alias("col")))

        return F.flatten(F.transform(rows, cells))


def _cell(grid: Grid, level: Column) -> list[Column]:
    row = grid.row(F.col("latitude"), level)
    return [row.alias("row"), grid.column(F.col("longitude"), row, level).alias("col")]


def _box(asked: DataFrame, radius_m: float) -> Column | None:
    """The latitudes and longitudes within the radius of the origins, as literal
    bounds that reach the scan; None without an origin."""
    lat, lon = F.col("latitude"), F.col("longitude")
    b = asked.agg(*[f(c).alias(n) for n, f, c in (("s", F.min, lat), ("n", F.max, lat), ("w", F.min, lon), ("e", F.max, lon))]).first()
    if b["s"] is None:
        return None
    reach = radius_m / METRES_PER_DEGREE + PAD
    south, north = b["s"] - reach, b["n"] + reach
    box = lat.between(south, north)
    pole = max(abs(south), abs(north)) >= 90.0
    if not pole:
        swing = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(max(abs(b["s"]), abs(b["n"]))))))) + PAD
        if b["w"] - swing > -180.0 and b["e"] + swing < 180.0:
            box = box & lon.between(b["w"] - swing, b["e"] + swing)
    return box


def _dense(points: DataFrame, grid: Grid, limit: int) -> DataFrame | None:
    """(lv, row, col) of the cells that hold ``limit`` points, or None.  Every
    pass counts ``STEP`` more levels, among points of cells dense so far."""
    found, inside = [], points.select("latitude", "longitude")
    for first in range(0, MAX_LEVEL + 1, STEP):
        last = min(first + STEP - 1, MAX_LEVEL)
        tried = inside.select("latitude", "longitude", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("lv"))
        counts = tried.select("lv", *_cell(grid, F.col("lv"))).groupBy("lv", "row", "col").agg(F.count(F.lit(1)).alias("_n"))
        cells = materialize(counts.where(F.col("_n") >= limit).drop("_n"), "near-dense")
        deepest = cells.agg(F.max("lv")).first()[0]  # one row
        if deepest is None:
            break
        found.append(cells)
        if deepest < last:
            break
        keep = cells.where(F.col("lv") == last).select("row", "col")
        inside = points.select("latitude", "longitude", *_cell(grid, F.lit(last))).join(keep, ["row", "col"], "left_semi")
    if not found:
        return None
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _in_parts(org: DataFrame) -> DataFrame:
    """Origins with the part of their tile: only points of one place (a few
    millimetres) can be more than some hundreds."""
    tile = TILE[:3]
    crowd = org.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / TILE_ORIGINS).alias("_parts")).where(F.col("_parts") > 1)
    part = F.pmod(F.xxhash64("origin"), F.coalesce("_parts", F.lit(1)))
    return org.join(crowd, tile, "left").withColumn("part", part).drop("_parts")


def _in_tiles(points: DataFrame, org: DataFrame, grid: Grid) -> DataFrame:
    """(tile, point): the points in the cells that a tile's origins can reach,
    once for each tile."""
    place = [F.col("olat"), F.col("olon"), F.col("reach")]
    used = org.select("lv", F.inline(grid.around(*place, F.lit(0)))).distinct()
    copies = (
        points.select("*", *_cell(grid, F.lit(0)))
        .join(used, ["row", "col"])
        .select(*points.columns, "lv", *_cell(grid, F.col("lv")))
    )
    needs = org.select(*TILE, F.inline(grid.around(*place, F.col("lv")))).distinct()
    return needs.join(copies, ["lv", "row", "col"]).drop("row", "col")


def _sphere(lat: Column, lon: Column, prefix: str) -> list[Column]:
    """A place on the unit sphere."""
    p, m = F.radians(lat), F.radians(lon)
    return [c.alias(prefix + a) for a, c in (("x", F.cos(p) * F.cos(m)), ("y", F.cos(p) * F.sin(m)), ("z", F.sin(p)))]


def _tighten(org: DataFrame, targets: DataFrame, grid: Grid, limit: int, n: int) -> DataFrame:
    """Origins with their reach cut to the smallest ring that holds ``limit``
    points, the origin's own among them.  Squares of chords are compared; the
    ring is wider by 0.1 mm, so rounding never loses a point."""
    columns = ["origin", "olat", "olon", "reach", "copies", *TILE]
    lat, lon = F.col("latitude"), F.col("longitude")
    met = _in_tiles(targets.select("latitude", "longitude"), org, grid).repartition(n, *TILE).select(*TILE, *_sphere(lat, lon, "p"))
    half = F.least(F.col("reach") / (2 * EARTH_RADIUS_M), F.lit(math.pi / 2))
    far = F.pow(2 * F.sin(half), 2)
    seen = org.repartition(n, *TILE).select(*columns, *_sphere(F.col("olat"), F.col("olon"), "o"), far.alias("far"))
    square = sum(((F.col("p" + a) - F.col("o" + a)) * (F.col("p" + a) - F.col("o" + a)) for a in "xyz"), F.lit(0.0))
    counts = (
        met.join(seen.hint("shuffle_hash"), TILE)
        .withColumn("square", square)
        .where(F.col("square") <= F.col("far"))
        .groupBy(*columns, "far")
        .agg(*[F.count_if(F.col("square") <= F.col("far") * area).alias(f"n{i}") for i, area in enumerate(RINGS)])
    )
    reach = F.col("reach")
    for i, area in enumerate(RINGS[1:], 1):  # the smallest is asked first
        ring = F.lit(2 * EARTH_RADIUS_M * (1 + 1e-9)) * F.asin(F.sqrt(F.col("far") * area) / 2) + 1e-4
        reach = F.when(F.col(f"n{i}") >= limit, F.least(ring, F.col("reach"))).otherwise(reach)
    return counts.select(*[reach.alias(c) if c == "reach" else c for c in columns])


def nearest_postcodes(
    postcodes: DataFrame,
    origins: DataFrame | None = None,
    limit: int = NEARBY_LIMIT,
    radius_m: float = NEARBY_RADIUS_M,
) -> DataFrame:
    """Up to ``limit`` postcodes within ``radius_m`` of each origin, nearest
    first (ties by postcode), the origin itself first at distance 0.

    ``postcodes``: (id, latitude, longitude); longitudes may lie on either side
    of the antimeridian.  ``origins``: a DataFrame with a ``postcode`` column
    (default: every postcode).  Origins without a geocode get no rows.  Output:
    (origin, rank, postcode, latitude, longitude, distance) with 0-based
    ``rank``.
    """
    spark = postcodes.sparkSession
    grid = Grid(radius_m)
    lat, lon = F.col("latitude"), F.col("longitude")
    every = postcodes.select(F.col("id").alias("postcode"), "latitude", "longitude").where(lat.between(-90.0, 90.0) & lon.isNotNull())
    if origins is None:
        asked = near = materialize(every, "near-asked")
    else:
        wanted = origins.select(F.col("postcode").alias("_want")).distinct()
        asked = materialize(every.join(wanted, F.col("postcode") == F.col("_want"), "left_semi"), "near-asked")
        box = _box(asked, radius_m)
        if box is None:
            return spark.createDataFrame([], RESULT)
        cells = asked.select(F.inline(grid.around(lat, lon, F.lit(radius_m), F.lit(0)))).distinct()
        near = (
            every.where(box).select("*", *_cell(grid, F.lit(0))).join(cells, ["row", "col"], "left_semi").drop("row", "col")
        )
    at_point = Window.partitionBy("latitude", "longitude").orderBy("postcode")
    named = near.where(F.col("postcode").isNotNull())  # only these can be a neighbour
    cut = named.withColumn("_n", F.row_number().over(at_point)).where(F.col("_n") <= limit).drop("_n")
    # pairs are far more work than the points' bytes suggest: as many files as tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    targets = materialize(cut.repartition(tasks, "postcode"), "near-points")

    # every origin's level and reach
    dense = _dense(targets, grid, limit)
    org = asked.select(F.col("postcode").alias("origin"), lat.alias("olat"), lon.alias("olon"))
    if dense is None:
        org = org.select("*", F.lit(0).alias("lv"), F.lit(radius_m).alias("reach"))
    else:
        levels = dense.agg(F.max("lv")).first()[0]
        own = asked.select("postcode", "latitude", "longitude", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("lv"))
        finest = (
            own.select("postcode", "lv", *_cell(grid, F.col("lv")))
            .join(dense, ["lv", "row", "col"])
            .groupBy(F.col("postcode").alias("origin"))
            .agg(F.max("lv").alias("_lv"))
        )
        corner = grid.far_corner(F.col("olat"), F.col("olon"), F.col("_lv"))
        org = org.join(finest, "origin", "left").select(
            "origin", "olat", "olon",
            F.coalesce("_lv", F.lit(0)).alias("lv"),
            F.when(F.col("_lv").isNull(), F.lit(radius_m)).otherwise(F.least(corner, F.lit(radius_m))).alias("reach"),
        )
    row = grid.row(F.col("olat"), F.col("lv"))
    org = org.groupBy(*org.columns).agg(F.count(F.lit(1)).cast("int").alias("copies"))  # rows alike are met as one
    org = materialize(org.select("*", row.alias("trow"), grid.column(F.col("olon"), row, F.col("lv")).alias("tcol")), "near-origins")
    own_row = org.where(F.lit(limit) > 0).select(
        "origin", F.lit(0).alias("rank"), F.col("origin").alias("postcode"), F.col("olat").alias("latitude"), F.col("olon").alias("longitude"), F.lit(0.0).alias("distance"), "copies"
    )
    twice = org.groupBy(F.col("origin").alias("_twice")).agg(F.sum("copies").alias("_n")).where(F.col("_n") > 1).select("_twice")
    twice = materialize(twice, "near-twice")
    n = max(tasks, math.ceil(org.count() / TASK_ORIGINS))
    org = materialize(_tighten(_in_parts(org), targets, grid, limit, n), "near-reach")

    met = _in_tiles(targets.select("postcode", "latitude", "longitude"), org, grid).repartition(n, *TILE)
    pairs = (
        met.join(org.repartition(n, *TILE).hint("shuffle_hash"), TILE)
        .where(F.col("postcode") != F.col("origin"))
        .withColumn("distance", haversine_m(F.col("olat"), F.col("olon"), lat, lon))
        .where(F.col("distance") <= F.least("reach", F.lit(radius_m)))
    )
    order = [F.col("distance").asc(), F.col("postcode").asc()]
    of_origin = Window.partitionBy(*TILE, "origin", "olat", "olon").orderBy(*order)  # in the tile's task
    others = pairs.withColumn("rank", F.row_number().over(of_origin)).where(F.col("rank") < limit)
    ranked = others.select(*own_row.columns).unionByName(own_row)
    if twice.isEmpty():
        return ranked.drop("copies")
    # an id on several rows: the nearest of all its places
    several = F.col("origin").eqNullSafe(F.col("_twice"))
    by_id = Window.partitionBy("origin").orderBy(order[0], (F.col("postcode") != F.col("origin")).asc(), order[1])
    again = ranked.join(twice, several, "left_semi").withColumn("_c", F.explode(F.sequence(F.lit(1), "copies"))).drop("_c")
    merged = again.withColumn("rank", F.row_number().over(by_id) - 1).where(F.col("rank") < limit)
    return ranked.join(twice, several, "left_anti").unionByName(merged).drop("copies")
