"""Population grids, nearest sites and coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km
from ..runtime import cut_lineage

SPLIT_BITS = 2  # a square is split into four by four; a power of two, so that halves of doubles are exact
FEW = 8  # places of a square that are few enough to be met one by one
LEAST_DEG = 1e-9  # a tenth of a millimetre: places within it are not told apart by squares


def grid_cells(pixels: DataFrame, height: int, width: int, origin_lat: float, origin_lng: float, pixel_deg: float,
               block: int = 50, least: int = 10) -> DataFrame:
    """Population summed over square blocks of pixels, with the centre of each block; thin blocks are dropped.

    Rows and columns beyond the last whole block are left out.
    """
    rows, cols = height // block, width // block
    inside = pixels.where((F.col("row") < rows * block) & (F.col("col") < cols * block))
    r, c = F.floor(F.col("row") / block), F.floor(F.col("col") / block)
    cells = inside.groupBy(r.alias("r"), c.alias("c")).agg(F.sum("pop").alias("pop")).where(F.col("pop") >= least)
    size = pixel_deg * block
    return cells.select(
        "r", "c", "pop", F.round(F.lit(origin_lat) - (F.col("r") + 0.5) * size, 4).alias("lat"),
        F.round(F.lit(origin_lng) + (F.col("c") + 0.5) * size, 4).alias("lng"))


def _boxes(points: DataFrame, side: str, index: Callable[[str], Column]) -> DataFrame:
    """Squares that hold any point: the square each was split from, how many points, the strongest, and the box that they fill."""
    boxes = points.groupBy(index("lat").alias(f"{side}_i"), index("lng").alias(f"{side}_j")).agg(
        F.count(F.lit(1)).alias(f"{side}_n"), *[f(c).alias(f"{side}_{n}") for c, f, n in (
            ("lat", F.min, "south"), ("lat", F.max, "north"), ("lng", F.min, "west"), ("lng", F.max, "east"))],
        *([F.max("strength").alias("strength")] if "strength" in points.columns else []))
    return boxes.withColumns({f"{side}_of_{k}": F.shiftright(f"{side}_{k}", SPLIT_BITS) for k in "ij"})


def _box_km() -> tuple[Column, Column]:
    """Least and largest distance that a point of the cells' box and one of the places' box may have, on the whole globe."""
    def sides(side: str) -> list[Column]:
        return [F.col(f"{side}_{n}") for n in ("south", "north", "west", "east")]

    def gaps(low1: Column, high1: Column, low2: Column, high2: Column) -> tuple[Column, Column]:
        return F.greatest(low2 - high1, low1 - high2, F.lit(0.0)), F.greatest(high2 - low1, high1 - low2)

    def square(deg: Column) -> Column:
        return F.pow(F.sin(F.radians(deg) / 2), F.lit(2.0))

    def cosines(south: Column, north: Column) -> tuple[Column, Column]:
        a, b = F.cos(F.radians(south)), F.cos(F.radians(north))
        return F.least(a, b), F.when((south <= 0) & (north >= 0), 1.0).otherwise(F.greatest(a, b))

    def km(h: Column) -> Column:
        return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))))

    (s1, n1, w1, e1), (s2, n2, w2, e2) = sides("c"), sides("p")
    (up, most_up), (along, most_along) = gaps(s1, n1, s2, n2), gaps(w1, e1, w2, e2)
    (low1, high1), (low2, high2) = cosines(s1, n1), cosines(s2, n2)
    # Half the difference of longitudes runs from 0 to 180 degrees: its sine is least at an end of the range, largest at 90 or at an end.
    widest = F.when((along <= 180) & (most_along >= 180), 1.0).otherwise(F.greatest(square(along), square(most_along)))
    near = km(square(up) + low1 * low2 * F.least(square(along), square(most_along)))
    far = km(square(most_up) + high1 * high2 * widest)
    return F.greatest(near * (1 - 1e-9) - 1e-6, F.lit(0.0)), far * (1 + 1e-9) + 1e-6


def squares_that_meet(cells: DataFrame, places: DataFrame, order: Callable[[Column, Column], Column]
                      ) -> Iterator[tuple[Callable[[str], Column], DataFrame]]:
    """Pairs of a square of cells and a square of places that may hold the best place of one of these cells.

    ``order`` takes a distance in km and a strength, falls with the distance and rises with the strength. From one
    square over all, both sides are split into sixteen at a time. A pair goes when what its strongest place could
    give at the least distance is below what some other pair is sure to give at its largest distance. Pairs whose places are
    few are done and handed out, with the rule that numbers the squares; only the others are split again, so squares are small where places are dense
    and empty ones never exist. What is left of each round is written.
    """
    ends = [f(c) for f in (F.min, F.max) for c in ("lat", "lng")]
    low_lat, low_lng, high_lat, high_lng = cells.select("lat", "lng").unionByName(places.select("lat", "lng")).agg(*ends).first()
    if low_lat is None:
        return
    low = {"lat": low_lat, "lng": low_lng}
    deg = max(high_lat - low_lat, high_lng - low_lng, LEAST_DEG) * 1.001
    keys = ["c_i", "c_j", "p_i", "p_j"]
    pairs = cells.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(k) for k in keys], F.lit(float("-inf")).alias("sure"))
    while True:
        deg /= 1 << SPLIT_BITS

        def index(c: str, deg: float = deg) -> Column:
            return F.floor((F.col(c) - low[c]) / deg)

        near, far = _box_km()
        split = pairs.select(*[F.col(k).alias(k.replace("_", "_of_")) for k in keys], "sure")
        met = split.join(_boxes(cells, "c", index), ["c_of_i", "c_of_j"]).join(_boxes(places, "p", index), ["p_of_i", "p_of_j"])
        given = F.max(order(far, F.col("strength"))).over(Window.partitionBy("c_i", "c_j"))
        met = met.withColumns({"most": order(near, F.col("strength")), "sure": F.greatest("sure", given)}).where(F.col("most") >= F.col("sure"))
        met = cut_lineage(met.select(*keys, "sure", "c_n", "p_n"))
        few = F.col("p_n") <= (FEW if deg > LEAST_DEG else 1 << 62)
        yield index, met.where(few)
        pairs = met.where(~few)
        if pairs.isEmpty():
            return


def _best(cells: DataFrame, places: DataFrame, value: Callable[[Column, Column], Column], order: Callable[[Column, Column], Column]) -> DataFrame:
    """``(lat, lng, best)``: the largest ``value`` of any place for every distinct cell, exactly; no rows without places.

    ``order`` ranks places as ``value`` does. Points without coordinates or strength take no part.
    """
    whole = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    open_cells = cut_lineage(cells.select("lat", "lng").where(whole).distinct())
    known = cut_lineage(places.select("lat", "lng", "strength").where(whole & F.col("strength").isNotNull()))
    found = open_cells.withColumn("best", F.lit(0.0)).where("false")
    for index, met in squares_that_meet(open_cells, known, order):
        asked = open_cells.withColumns({"c_i": index("lat"), "c_j": index("lng")})
        held = known.withColumns({"p_i": index("lat"), "p_j": index("lng")}).withColumnsRenamed({"lat": "p_lat", "lng": "p_lng"})
        best = met.join(asked, ["c_i", "c_j"]).join(held, ["p_i", "p_j"]).groupBy("lat", "lng").agg(
            F.max(value(haversine_km("lat", "lng", "p_lat", "p_lng"), F.col("strength"))).alias("best"))
        found = found.unionByName(best)
    return found.groupBy("lat", "lng").agg(F.max("best").alias("best"))


def nearest_by_rings(cells: DataFrame, places: DataFrame) -> DataFrame:
    """Distance from every cell to its nearest place; cells drop out when there is no place at all."""
    def closer(km: Column, _: Column) -> Column:
        return -km

    settled = _best(cells, places.select("lat", "lng").distinct().withColumn("strength", F.lit(1.0)), closer, closer)
    return cells.join(settled.select("lat", "lng", (-F.col("best")).alias("dist_km")), ["lat", "lng"])


def nearest_site(cells: DataFrame, sites: DataFrame, none_km: float = 500.0) -> DataFrame:
    """Distance from every cell to its nearest site; ``none_km`` when there is no site at all."""
    found = nearest_by_rings(cells.select("lat", "lng").distinct(), sites)
    out = cells.join(found, ["lat", "lng"], "left").withColumn("dist_km", F.coalesce("dist_km", F.lit(float(none_km))))
    return out.select(*cells.columns, "dist_km")


def need(cells: DataFrame) -> DataFrame:
    """Population times distance to the nearest site, and as a share of the largest such product."""
    out = cells.withColumn("raw", F.col("pop") * F.col("dist_km"))
    top = out.agg(F.max("raw")).scalar()
    return out.withColumn("score", F.when(top > 0, F.col("raw") / top).otherwise(0.0))


def coverage(cells: DataFrame, sites: DataFrame, decay_km: float = 50.0) -> DataFrame:
    """Largest strength of any site after exponential decay with distance, at most 1; 0 without sites.

    Sites at one place with one strength count once; sites without strength give nothing. Squares of sites are ranked by the
    logarithm, which tells even those apart whose strength has decayed to nothing.
    """
    places = sites.where(F.col("strength") > 0).groupBy("lat", "lng").agg(F.max("strength").alias("strength"))
    settled = _best(cells, places, lambda km, strength: strength * F.exp(-km / decay_km), lambda km, strength: F.log(strength) - km / decay_km)
    out = cells.join(settled, ["lat", "lng"], "left")
    return out.select(*cells.columns, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0)))).alias("coverage"))
