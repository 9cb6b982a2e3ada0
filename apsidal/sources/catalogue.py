"""Catalogue files: three-line element sets, the object catalogue as CSV, scenarios as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encounters import catalogue_number
from ..operators.graph import checkpoint
from ..operators.ordered import with_neighbours


def element_sets(lines: DataFrame) -> DataFrame:
    """file, line_no, name, norad_id, line1, line2 of every complete triple of lines (file, line_no, line).

    Blank lines do not count. A triple is a line ``0 ``, one ``1 `` and one ``2 `` in a row; whatever
    else stands between is skipped. An unreadable number is 0. Triples cannot overlap, so a look back
    of two lines is the sliding match; a file's lines are spread over tasks.
    """
    kept = lines.select("file", "line_no", F.trim("line").alias("line2")).where("line2 <> ''")
    back = lambda w: {"line": F.lag("line2", 2).over(w), "line1": F.lag("line2", 1).over(w), "top": F.lag("line_no", 2).over(w)}
    rows = with_neighbours(kept, ["file"], ["line_no"], back, 2).drop("line_no").withColumnRenamed("top", "line_no")
    rows = rows.where(F.col("line").startswith("0 ") & F.col("line1").startswith("1 ") & F.col("line2").startswith("2 "))
    number = F.coalesce(F.trim(F.substring("line1", 3, 5)).try_cast("int"), F.lit(0))
    return rows.select("file", "line_no", F.trim(F.substring("line", 3, 1000)).alias("name"), number.cast("long").alias("norad_id"), "line1", "line2")


def element_names(lines: DataFrame) -> DataFrame:
    """norad_id, name, line1 of every readable line 1: the name is that of the last line ``0 `` above it in its file.

    Of a number that occurs more often the last line in file order counts; unreadable numbers are left out.
    The name is carried along by blocks of lines: a block knows its last name, and blocks are few.
    """
    rows = lines.withColumn("block", F.floor(F.col("line_no") / 4096))
    named = F.when(F.col("line").startswith("0 "), F.struct("line_no", F.trim(F.substring("line", 3, 1000)).alias("name")))
    own = Window.partitionBy("file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("file", "block").agg(F.max(named).alias("top")).withColumn("carried", F.max("top").over(before)).drop("top")
    number = catalogue_number(F.trim(F.substring("line", 3, 5)))
    ones = rows.withColumn("own", F.max(named).over(own)).where(F.col("line").startswith("1 ")).withColumn("norad_id", number.cast("long")).where("norad_id is not null")
    met = ones.join(tops, ["file", "block"]).select("norad_id", F.struct("file", "line_no").alias("at"), F.coalesce("own.name", "carried.name", F.lit("")).alias("name"), F.rtrim("line").alias("line1"))
    return met.groupBy("norad_id").agg(F.max_by("name", "at").alias("name"), F.max_by("line1", "at").alias("line1"))


def read_element_files(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Element sets of all files under a path; with ``first`` only so many, in file order (an interactive cap).

    A file is one row until its lines are cut, so files should stay within what a task holds.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    sets = element_sets(whole)
    return sets if first is None else sets.orderBy("file", "line_no").limit(first)


def typed_catalogue(raw: DataFrame) -> DataFrame:
    """Typed records of catalogue rows read as strings; rows without a readable id go, other bad fields are null."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = raw.select(F.trim("norad_id").try_cast("long").alias("norad_id"), text("name").alias("name"), F.upper(text("object_type")).alias("object_type"), text("owner").alias("owner"), F.substring("launch_date", 1, 4).try_cast("int").alias("launch_year"), F.trim("rcs_m2").try_cast("double").alias("rcs_m2"))
    return out.where("norad_id is not null")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue from CSV with a header, after comment lines that begin with #; columns go by name, further ones are not read."""
    return typed_catalogue(spark.read.csv(path, header=True, comment="#", escape='"'))


def snapshot(full: DataFrame, tracked: DataFrame) -> DataFrame:
    """Records of tracked objects only, by a semi-join on the id, in its order."""
    return full.join(tracked.select("norad_id"), "norad_id", "left_semi").orderBy("norad_id")


def write_snapshot(full: DataFrame, tracked: DataFrame, path: str) -> None:
    snapshot(full, tracked).write.mode("overwrite").option("header", True).csv(path)


# Columns of the public catalogue file and their names in a snapshot, in order.
SNAPSHOT_COLUMNS = {
    "NORAD_CAT_ID": "norad_id", "OBJECT_NAME": "name", "OBJECT_ID": "intl_designator", "OBJECT_TYPE": "object_type",
    "OPS_STATUS_CODE": "ops_status", "OWNER": "owner", "LAUNCH_DATE": "launch_date", "LAUNCH_SITE": "launch_site",
    "DECAY_DATE": "decay_date", "PERIOD": "period_min", "INCLINATION": "inclination_deg", "APOGEE": "apogee_km",
    "PERIGEE": "perigee_km", "RCS": "rcs_m2",
}


def snapshot_lines(raw: DataFrame, tracked: DataFrame) -> DataFrame:
    """norad_id, line: CSV lines of the tracked objects in a catalogue file read as strings (further columns are left out).

    A missing column is an error. Texts are trimmed; a null is an empty field. Rows without a readable id go;
    repeated ids stay.
    """
    gone = [c for c in SNAPSHOT_COLUMNS if c not in raw.columns]
    if gone:
        raise ValueError(f"catalogue file lacks the columns {gone}")
    fields = F.struct(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(n) for c, n in SNAPSHOT_COLUMNS.items()])
    line = F.to_csv(fields, {"escape": '"', "emptyValue": ""})
    rows = raw.select(F.trim(F.col("NORAD_CAT_ID").cast("string")).try_cast("long").alias("norad_id"), line.alias("line")).where("norad_id is not null")
    return rows.join(tracked.select("norad_id").distinct(), "norad_id", "left_semi")


def write_catalogue_snapshot(raw: DataFrame, tracked: DataFrame, path: str, source: str, retrieved: str) -> None:
    """Write the lines by id, each file with a line on where they come from, then the header; ``read_catalogue`` reads them.

    Both stand before the first line of every partition, so files can be read alone. No tracked object leaves no line at all.
    """
    lines = checkpoint(snapshot_lines(raw, tracked))
    top = f"# source={source} retrieved={retrieved} rows={lines.count()} filter=ids of element files ({tracked.select('norad_id').distinct().count()})\n" + ",".join(SNAPSHOT_COLUMNS.values()) + "\n"
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines.orderBy("norad_id", "line").select(F.when(first, F.concat(F.lit(top), "line")).otherwise(F.col("line")).alias("value")).write.mode("overwrite").text(path)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario files by name: one JSON object a file."""
    return spark.read.json(path, multiLine=True).withColumn("scenario", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
