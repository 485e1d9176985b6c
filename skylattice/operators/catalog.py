"""Catalogues of scenes and tiles: filters, keyed merges, reports and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, times
from .ranking import quantiles, running_sums

# Accepted names of the sensors, with short tag and label.
SENSORS = {
    "sentinel-2": ("s2", "Sentinel-2"), "s2": ("s2", "Sentinel-2"), "sentinel2": ("s2", "Sentinel-2"),
    "landsat": ("ls", "Landsat"), "ls": ("ls", "Landsat"),
    "sentinel-1": ("s1", "Sentinel-1"), "s1": ("s1", "Sentinel-1"), "sentinel1": ("s1", "Sentinel-1"),
}
FULL_NAME = {"s2": "sentinel-2", "ls": "landsat", "s1": "sentinel-1"}


def sensor_name(alias: str) -> str:
    tag = SENSORS.get(alias.strip().lower())
    if tag is None:
        raise ValueError(f"unknown sensor {alias!r}")
    return FULL_NAME[tag[0]]


def sensor_names(aliases: list[str]) -> list[str]:
    """Full names in the order given, each once."""
    return list(dict.fromkeys(map(sensor_name, aliases)))


def normalised_sensor(alias: Column) -> Column:
    """Full name of an alias column; null if unknown."""
    pairs = [x for a, (tag, _) in SENSORS.items() for x in (F.lit(a), F.lit(FULL_NAME[tag]))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(alias)))


def by_sensor(df: DataFrame, sensor: str) -> DataFrame:
    return df.filter(F.lower(F.coalesce("sensor", F.lit(""))) == sensor.lower())


def cloud_filter(df: DataFrame, most: float | None) -> DataFrame:
    """Unknown cloud passes and is flagged."""
    out = df.withColumn("cloud_unknown", F.col("cloud").isNull())
    return out if most is None else out.filter(F.col("cloud").isNull() | (F.col("cloud") <= most))


def select_scenes(
    df: DataFrame, sensor: str | None = None, start: str | None = None, end: str | None = None, box=None, most_cloud: float | None = None,
    strict_cloud: bool = False, downloaded: bool | None = None, region: str | None = None,
) -> DataFrame:
    """All filters that are given; each is a plain predicate, so scans can push them down."""
    if sensor is not None:
        df = by_sensor(df, sensor_name(sensor))
    if start is not None or end is not None:
        df = df.filter(times.in_range(F.col("acquired"), start, end))
    if box is not None:
        df = df.filter(geo.intersects(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")), box))
    if most_cloud is not None:
        df = df.filter(F.col("cloud") < most_cloud) if strict_cloud else df.filter(F.col("cloud").isNull() | (F.col("cloud") <= most_cloud))
    if downloaded is not None:
        df = df.filter(F.col("downloaded") if downloaded else ~F.col("downloaded"))
    if region is not None:
        df = df.filter(F.startswith(F.lower("region"), F.lit(region.lower())))
    return df


def in_crs_box(df: DataFrame, box: tuple[float, float, float, float], samples: int = 22) -> DataFrame:
    """Rows whose bounds (left, bottom, right, top, in metres of the UTM ``zone``, ``north``) meet a box in degrees. The box is
    transformed once for each of the 120 reference systems, with ``samples`` steps along each side; where a system's
    projection does not reach (80 degrees from its meridian) the side does not count. Rows without a zone go."""
    geo.check_box(box)
    k = F.col("id")
    step, far = F.explode(F.array(*(F.lit(i / samples) for i in range(samples + 1)))), F.explode(F.array(*map(F.lit, range(4))))
    sides = df.sparkSession.range(120).select((k % 60 + 1).cast("int").alias("zone"), (k < 60).alias("north"), step.alias("f")).withColumn("side", far)
    lng = F.when(F.col("side") == 0, box[0]).when(F.col("side") == 1, box[2]).otherwise(box[0] + (box[2] - box[0]) * F.col("f"))
    lat = F.when(F.col("side") == 2, box[1]).when(F.col("side") == 3, box[3]).otherwise(box[1] + (box[3] - box[1]) * F.col("f"))
    sides = sides.withColumn("lng", lng).withColumn("lat", lat).filter(F.abs(F.col("lng") - (F.col("zone") * 6 - 183)) < 80)
    at = sides.select("zone", "north", geo.utm(F.col("lat"), F.col("lng"), F.col("zone"), F.col("north")).alias("m"))
    bounds = at.groupBy("zone", "north").agg(
        F.min("m.easting").alias("_w"), F.min("m.northing").alias("_s"), F.max("m.easting").alias("_e"), F.max("m.northing").alias("_n")
    )
    near = df.join(F.broadcast(bounds), ["zone", "north"])
    return near.filter("left <= _e AND right >= _w AND bottom <= _n AND top >= _s").drop("_w", "_s", "_e", "_n")


#: Regions that are broadcast at most.
MAX_REGIONS = 100_000


def nearest_region(places: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """(key, region_id): the region (region_id, lat, lng) nearest to each place (key, y, x), of equally near ones the least."""
    few = regions.limit(MAX_REGIONS + 1).count() <= MAX_REGIONS
    d = F.round(geo.nearest_distance(F.col("y"), F.col("x"), F.col("lat"), F.col("lng")), 9)
    both = places.select(key, "y", "x").join(F.broadcast(regions) if few else regions)
    return both.groupBy(key).agg(F.min(F.struct(d.alias("d"), "region_id"))["region_id"].alias("region_id"))


def insert_absent(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``; of equal keys in the batch the first by ``order``."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.withColumn("_n", first).filter("_n = 1").drop("_n").join(old.select(key), key, "left_anti")


def merge_actions(old: DataFrame, new: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """(key, action): add, update or same; the last of equal keys in the batch wins."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    batch = new.withColumn("_n", last).filter("_n = 1").select(key, F.struct(*values).alias("new"))
    both = batch.join(old.select(key, F.struct(*values).alias("old")), key, "left")
    return both.select(key, F.when(F.col("old").isNull(), "add").when(~F.col("old").eqNullSafe(F.col("new")), "update").otherwise("same").alias("action"))


def merge(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` with the rows of ``new`` put over those of the same key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    batch = new.withColumn("_n", last).filter("_n = 1").drop("_n")
    return old.join(batch.select(key), key, "left_anti").unionByName(batch)


def duplicate_keys(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, kept): the first by ``order`` is kept, keys that come once are left out."""
    w = Window.partitionBy(key)
    return df.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy(order))).filter("n > 1").select(key, order, (F.col("i") == 1).alias("kept"))


def day_cloud(scenes: DataFrame) -> DataFrame:
    """Cloud of (sensor, day) groups that hold exactly one value."""
    groups = scenes.filter("acquired IS NOT NULL").groupBy("sensor", F.to_date("acquired").alias("day"))
    return groups.agg(F.countDistinct("cloud").alias("n"), F.max("cloud").alias("day_cloud")).filter("n = 1").drop("n")


def timeline(df: DataFrame, by: str) -> DataFrame:
    """Scenes of each group by time, and where they lie between the first and the last; 0.5 if there is one time. Ranks come from
    running counts over range partitions: a group may hold any share of the archive. A scene_id that comes twice at one time is not expected."""
    t = F.unix_timestamp("acquired").cast("double")
    known = df.filter("acquired IS NOT NULL").select(by, "scene_id", t.alias("t"), F.struct("acquired", "scene_id").alias("_at"), F.lit(1).alias("_one"))
    spans = known.groupBy(F.col(by).alias("_by")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    rows = running_sums(known, [by], "_at", ["_one"]).join(spans, F.col(by).eqNullSafe(F.col("_by")))
    place = F.when(F.col("last") > F.col("first"), (F.col("t") - F.col("first")) / (F.col("last") - F.col("first"))).otherwise(F.lit(0.5))
    return rows.select(by, "scene_id", F.col("_one_upto").cast("int").alias("rank"), F.round(place, 6).alias("place"))


SORTS = {
    "similarity": [F.desc_nulls_last, "score"], "newest": [F.desc_nulls_last, "acquired"], "oldest": [F.asc_nulls_last, "acquired"],
    "cloud": [F.asc_nulls_last, "cloud"],
}


def sort_order(mode: str) -> Column:
    how, column = SORTS[mode]
    return how(column)


def sort_by(df: DataFrame, mode: str, tie: str) -> DataFrame:
    return df.orderBy(sort_order(mode), tie)


GRID = ("crs", "size", "transform", "bounds", "band_count", "dtypes")
#: Time bins of pairs, in spans of the days that a pair may lie apart. The first span of a bin is sent to the bin before as well.
BIN_SPANS = 2


def _code(rows: DataFrame, *columns: str) -> Column:
    """64 bits for the values of ``columns``: equal values have equal codes (null is a value, 0.0 is -0.0), others differ but for collisions."""

    def plain(c: str) -> Column:
        kind = rows.schema[c].dataType
        if isinstance(kind, T.FractionalType):
            return F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FractionalType):
            return F.transform(c, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
        return F.col(c)

    if all(isinstance(rows.schema[c].dataType, (T.StringType, T.IntegralType)) for c in columns):
        return F.xxhash64(*(x for c in columns for x in (F.col(c), F.isnull(c))))
    return F.xxhash64(F.to_json(F.struct(*(plain(c).alias(c) for c in columns)), {"ignoreNullFields": "false"}))


def temporal_pairs(rasters: DataFrame, by: str = "tile_id", within_days: int | None = None, reversed_too: bool = False, least_bands: int = 4) -> DataFrame:
    """Pairs of rasters of one place with ``reasons``, the checks that a pair fails, comma-joined and empty if it fits.

    ``rasters``: raster_id, the place, acquired, sensor, crs, width, height, transform, bounds, band_count, dtypes. A pair is
    two rasters of one place, sensor apart or not, the earlier first; with ``reversed_too`` also the later first. Equal times pair in the order
    of raster_id and fail. With ``within_days`` only rasters that near in time pair: each is sent to its bin of ``BIN_SPANS`` times that
    many days, and to the bin before if it is near it, so that a long history of one place costs no square. Rasters without a time pair with none.

    Both sides come from one shuffle, of what a raster is compared by alone: headers travel as 64-bit codes, but for the columns of the first
    raster that are asked for. The rasters of a place and bin meet as one list, in the order of time, so rows that are alike follow each other.
    """
    codes = {"sensor": ["sensor"], "size": ["width", "height"], "transform": ["transform"], "bounds": ["bounds"], "dtypes": ["dtypes"]}
    shown = ("sensor", "crs", "transform", "bounds", "height", "width")
    seconds = F.unix_timestamp("acquired")
    known = rasters.filter(seconds.isNotNull() & F.col(by).isNotNull())
    crs = F.when(F.col("crs").isNotNull(), _code(rasters, "crs"))
    rows = known.select(by, "raster_id", "acquired", *shown, "band_count", crs.alias("_crs"), *(_code(rasters, *c).alias(f"_{k}") for k, c in codes.items()))
    home = F.lit(0)
    if within_days is not None:
        width = BIN_SPANS * 86400 * max(within_days, 1)
        home = F.floor(seconds / F.lit(width))
        near = seconds - home * width <= 86400 * within_days
        rows = rows.withColumn("_bin", F.explode(F.when(near, F.array(home, home - 1)).otherwise(F.array(home))))
    else:
        rows = rows.withColumn("_bin", home)
    spark, on = rasters.sparkSession, [by, "_bin"]
    dealt = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *on)
    # what a raster says by itself is made once for it: a pair only compares and puts together
    compared = ["acquired", "raster_id", "seconds", "home", "day", "band_count", "_crs", *(f"_{k}" for k in codes)]
    day = F.date_format("acquired", "yyyyMMdd")
    told = dealt.withColumn("seconds", seconds).withColumn("home", F.col("_bin") == home).withColumn("day", day)
    head = F.concat(F.col(by).cast("string"), F.lit("__"), F.col("day"), F.lit("_"))
    first = told.sortWithinPartitions(*on, "acquired", "raster_id").select(*on, head.alias("head"), *shown, *(F.col(c).alias(f"{c}_1") for c in compared))
    second = told.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*compared))).alias("_others"))
    both = first.join(second.hint("merge"), on).withColumn("_2", F.explode("_others"))
    one, two = (lambda c: F.col(f"{c}_1")), (lambda c: F.col("_2")[c])
    meets = (one("acquired") != two("acquired")) if reversed_too else (one("acquired") < two("acquired"))
    pairs = (one("home") | two("home")) & (meets | ((one("acquired") == two("acquired")) & (one("raster_id") < two("raster_id"))))
    if within_days is not None:
        pairs = (F.abs(two("seconds") - one("seconds")) <= 86400 * within_days) & pairs

    def differ(c: str) -> Column:
        return ~one(c).eqNullSafe(two(c))

    checks = [
        ("same_time", one("acquired") == two("acquired")), ("sensor", differ("_sensor")), ("no_crs", one("_crs").isNull() | two("_crs").isNull()), ("crs", differ("_crs")),
        ("size", differ("_size")), ("transform", differ("_transform")), ("bounds", differ("_bounds")), ("band_count", differ("band_count")), ("dtypes", differ("_dtypes")),
        ("bands", (one("_sensor") == F.xxhash64(F.lit("sentinel-2"), F.lit(False))) & (F.least(one("band_count"), two("band_count")) < least_bands)),
    ]
    failed = F.lit(0)
    for k, (_, c) in enumerate(checks):
        failed = failed + F.when(c, 1 << k).otherwise(0)
    texts = [",".join(n for k, (n, _) in enumerate(checks) if code >> k & 1) for code in range(1 << len(checks))]
    reasons = F.array(*map(F.lit, texts))[failed]
    return both.filter(pairs).select(
        F.concat("head", two("day")).alias("pair_id"), by, one("raster_id").alias("raster_1"), two("raster_id").alias("raster_2"), one("acquired").alias("acquired_1"), two("acquired").alias("acquired_2"),
        *shown, reasons.alias("reasons"),
    )


def _observation_side(ids: DataFrame, observations: DataFrame, k: int) -> DataFrame:
    """``ids`` (t<k> and what else they have) with what the checks ask of that side."""
    side = observations.select(F.col("id").alias(f"t{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("role", "pair_id", "sensor")), F.lit(True).alias(f"known_{k}"))
    return ids.join(side, f"t{k}", "left")


def _observation_reason() -> Column:
    return (
        F.when(F.col("t1").isNull() | F.col("t2").isNull(), "missing_id").when(F.col("known_1").isNull() | F.col("known_2").isNull(), "unknown_id")
        .when(~(F.col("role_1").eqNullSafe("T1") & F.col("role_2").eqNullSafe("T2")), "role").when(~F.col("pair_id_1").eqNullSafe(F.col("pair_id_2")), "pair")
        .when(~F.col("sensor_1").eqNullSafe(F.col("sensor_2")), "sensor")
    )


def observation_pairs(asked: DataFrame, observations: DataFrame) -> DataFrame:
    """``asked`` (t1, t2: observation ids) with ``reason``, the first check that fails, null if the pair may be analysed.
    ``observations``: id, role, pair_id, sensor."""
    rows = _observation_side(_observation_side(asked, observations, 1), observations, 2)
    return rows.select("t1", "t2", _observation_reason().alias("reason"))


def observation_products(first: DataFrame, second: DataFrame, on: list[str], observations: DataFrame) -> DataFrame:
    """The same for all pairs of ``first`` (t1, ``on``) and ``second`` (t2, ``on``) that agree ``on`` those columns. Each side meets the observations before
    the sides meet, so that no pair is shuffled: what travels grows with the rows, while the pairs may grow with their square."""
    sides = _observation_side(first, observations, 1).join(_observation_side(second, observations, 2).hint("merge"), on)
    return sides.select("t1", "t2", _observation_reason().alias("reason"))


def public_result(tiles: DataFrame) -> DataFrame:
    """Search results as they are shown: centre of the tile in degrees (null without bounds or system), day, sensor as name, tag and
    label, cloud, rank. ``tiles``: tile_id, source_scene_id, sensor, acquired, bounds (metres), zone, north, score, cloud."""
    b = F.col("bounds")
    centre = geo.from_utm((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, F.col("zone"), F.col("north"))
    key = F.lower(F.coalesce("sensor", F.lit("")))
    labels = {FULL_NAME[tag]: (tag, label) for tag, label in SENSORS.values()}
    tag, label = (F.create_map(*(x for full, v in labels.items() for x in (F.lit(full), F.lit(v[k])))) for k in (0, 1))
    sensor = F.struct(F.coalesce(F.try_element_at(tag, key), key).alias("id"), F.coalesce(F.try_element_at(label, key), key).alias("name"), F.upper(F.coalesce(F.try_element_at(tag, key), key)).alias("tag"))
    return tiles.select(
        "tile_id", centre["lat"].alias("lat"), centre["lng"].alias("lng"), F.coalesce("source_scene_id", F.lit("Local archive")).alias("region"), F.date_format("acquired", "yyyy-MM-dd").alias("day"),
        sensor.alias("sensor"), F.col("score").alias("sim"), "cloud",
    )


def observation_checks(observations: DataFrame) -> DataFrame:
    """``observations`` (id, role and what else they have) with ``reason``, the first rule that a row breaks: id, duplicate, role."""
    copies = observations.groupBy("id").agg(F.count("*").alias("_n"))
    reason = F.when(F.col("id").isNull(), "id").when(F.col("_n") > 1, "duplicate").when(~F.coalesce(F.col("role").isin("T1", "T2"), F.lit(False)), "role")
    return observations.join(copies, "id", "left").withColumn("reason", reason).drop("_n")


def index_status(catalogue: DataFrame, index: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """One row: catalogued, indexed and staged keys, staged keys that are indexed, and those that wait."""
    flag = lambda df, name: df.select(key, F.lit(True).alias(name)).distinct()
    rows = flag(catalogue, "c").join(flag(index, "i"), key, "full").join(flag(staged, "s"), key, "full")
    return rows.agg(
        F.count("c").alias("catalogued"), F.count("i").alias("indexed"), F.count("s").alias("staged"), F.count_if(F.col("s") & F.col("i")).alias("staged_indexed"),
        F.count_if(F.col("s") & F.col("i").isNull()).alias("waiting"),
    )


def gap_report(pairs: DataFrame, by: str) -> DataFrame:
    """Of pairs (at_1, at_2: days; acquisition_1, acquisition_2): least, median and largest gap in days, how many have either member first, the
    same day, and the same acquisition."""
    gap, order = F.abs(F.datediff("at_2", "at_1")), F.datediff("at_2", "at_1")
    rows = pairs.filter("at_1 IS NOT NULL AND at_2 IS NOT NULL").select(by, gap.cast("double").alias("gap"), order.alias("order"), F.col("acquisition_1").eqNullSafe(F.col("acquisition_2")).alias("same"))
    counts = rows.groupBy(by).agg(
        F.min("gap").alias("low"), F.max("gap").alias("high"), F.count_if(F.col("order") > 0).alias("first_earlier"), F.count_if(F.col("order") < 0).alias("second_earlier"),
        F.count_if(F.col("order") == 0).alias("same_day"), F.count_if((F.col("order") == 0) & F.col("same")).alias("same_acquisition"),
    )
    return counts.join(quantiles(rows, [by], "gap", [0.5]).select(by, F.col("q")[0].alias("median")), by)
