"""Scans of catalogues, tile manifests and small text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCENE = """scene_id string, sensor string, collection string, acquisition_datetime string, bbox array<double>, cloud_cover double,
 orbit_direction string, polarization array<string>, source_url string, local_path string, downloaded boolean, resolution_m double,
 crs string, metadata map<string,string>"""
TILE = """tile_id string, source_scene_id string, sensor string, acquisition_datetime string, tile_path string, width int, height int,
 crs string, resolution array<double>, bounds array<double>, transform array<double>, band_count int, dtype array<string>, valid_fraction double"""
MANIFEST = "source string, tiles array<struct<path:string, source_scene:string, sensor:string, acquisition_date:string, valid_fraction:double>>"


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON list of records; anything malformed fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_tile_catalog(spark: SparkSession, path: str) -> DataFrame:
    return read_json_list(spark, path, TILE).orderBy("tile_id")


def read_manifests(spark: SparkSession, root: str, names: str = "tiles.json") -> DataFrame:
    """Tiles of all ``tiles.json`` below ``root``, with the folder that their paths start from. A manifest that is no JSON fails. Other ``names``, such as
    those of files that Spark has written, may hold a manifest in each line."""
    rows = spark.read.schema(MANIFEST).option("multiLine", names == "tiles.json").option("recursiveFileLookup", True).option("pathGlobFilter", names).option("mode", "FAILFAST").json(root)
    folder = F.regexp_replace(F.input_file_name(), "/[^/]*$", "")
    return rows.select("source", folder.alias("folder"), F.explode("tiles").alias("t")).select("source", "folder", "t.*", F.concat_ws("/", "folder", "t.path").alias("resolved"))


def list_files(spark: SparkSession, root: str, names: str = "*") -> DataFrame:
    """(file): all files below ``root`` but those without content, which Spark's file sources pass over; nothing of them is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root).select(F.col("path").alias("file"))


def _bare(path: Column) -> Column:
    """A path without its scheme."""
    return F.regexp_replace(path, "^[a-z0-9]+:(//)?(?=/)", "")


def resolve_tiles(rows: DataFrame, files: DataFrame, base: str) -> DataFrame:
    """The records of ``read_manifests`` that name a file of ``files``, once for each file, with ``file`` and ``how``. An absolute path is the file itself;
    another is looked up below ``base``, then by its bare name beside its manifest. Of records of one file that of the last manifest counts,
    by source if one folder holds them."""
    path = F.col("path")
    option = lambda k, how, at: F.struct(F.lit(k).alias("k"), F.lit(how).alias("how"), at.alias("at"))
    below, beside = F.concat(F.lit(base.rstrip("/") + "/"), path), F.concat(_bare(F.col("folder")), F.lit("/"), F.regexp_extract(path, "[^/]*$", 0))
    options = F.when(path.startswith("/"), F.array(option(0, "absolute", path))).otherwise(F.array(option(1, "below", below), option(2, "beside", beside)))
    asked = rows.drop("resolved").filter(path.isNotNull()).withColumn("_row", F.struct(*(c for c in rows.columns if c != "resolved"))).select("_row", F.explode(options).alias("o"))
    known = files.select(_bare(F.col("file")).alias("file")).distinct()
    hits = asked.join(known, F.col("o.at") == F.col("file")).groupBy("_row").agg(F.min_by(F.struct("file", F.col("o.how").alias("how")), "o.k").alias("hit"))
    last = hits.groupBy("hit.file").agg(F.max_by(F.struct("_row", F.col("hit.how").alias("how")), F.struct("_row.folder", "_row.source", "_row.path")).alias("r"))
    return last.select("r._row.*", "file", "r.how")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers from text, separated by commas or lines."""
    return spark.read.text(path).select(F.explode(F.split("value", ",")).alias("id")).select(F.trim("id").alias("id")).filter("id <> ''")


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """``two_dates`` of the files of a folder, a file for each place."""
    return two_dates(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): small text files held together as JSON lines, many to a file, so that the number of files does not grow with
    the number of places. A line that is no JSON fails."""
    return spark.read.schema("file string, value string").option("mode", "FAILFAST").json(path)


def two_dates(texts: DataFrame) -> DataFrame:
    """(file, dates): the two dates of each ``label: date`` text (file, value), in order; another number fails."""
    lines = texts.select("file", F.split("value", r"\r?\n").alias("lines"))
    found = F.transform(F.filter("lines", lambda x: F.contains(x, F.lit(":"))), lambda x: F.trim(F.element_at(F.split(x, ":", 2), 2)))
    fail = F.raise_error(F.lit("a date file needs two dates")).cast("array<string>")
    return lines.select("file", F.when(F.size(found) == 2, found).otherwise(fail).alias("dates"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair metadata from CSV with a header; a byte-order mark is no part of the first name."""
    schema = "im_idx string, pair_idx string, filename string, date string, time string, system_idx string, city string, city_ascii string, country string, lat double, lng double"
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def stable_id(path: Column) -> Column:
    """Path without suffix; folders joined by two underscores, other signs one each."""
    bare = F.regexp_replace(path, "[.][^./]*$", "")
    return F.regexp_replace(F.replace(bare, F.lit("/"), F.lit("__")), "[^A-Za-z0-9_.-]", "_")


def fingerprint(path: Column, size: Column, modified: Column) -> Column:
    return F.concat_ws(":", path, size.cast("string"), modified.cast("string"))
