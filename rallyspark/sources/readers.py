"""Reading clip folders (per-frame Parquet, event documents, label worksheets) and writing tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION, STAGE_VERSION = 1, "1.0.0"


def clip_of_path():
    """The clip's number: the last run of digits in the name of the folder that holds a file."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]+)[^0-9/]*/[^/]*$", 1).cast("long")


def nan_as_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


def read_stream(spark: SparkSession, pattern: str, columns: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Per-frame Parquet files of many clip folders (``.../clip_7/ball.parquet``) as one table with clip_id.

    Only the columns asked for are read; a required one that is missing fails, an optional one is null. NaN is null."""
    files = spark.read.option("mergeSchema", "true").parquet(pattern)
    if missing := [c for c in columns if c not in files.columns]:
        raise ValueError(f"{pattern} lacks the columns {', '.join(missing)}")
    wanted = [F.col(c) for c in columns] + [F.col(c) if c in files.columns else F.lit(None).alias(c) for c in optional]
    return nan_as_null(files.select(clip_of_path().alias("clip_id"), *wanted))


def read_events(spark: SparkSession, pattern: str, name: str, fields: str) -> DataFrame:
    """The list ``name`` of one JSON document per clip folder: a row per event. ``fields`` is the events' schema (DDL)."""
    docs = spark.read.schema(f"schema_version int, fps double, {name} array<struct<{fields}>>").option("multiLine", "true").json(pattern)
    return docs.select(clip_of_path().alias("clip_id"), "schema_version", "fps", F.explode(name).alias("e")).select("clip_id", "schema_version", "fps", "e.*")


def read_roles(spark: SparkSession, pattern: str) -> DataFrame:
    """Roles, an object keyed by track: a row per track."""
    docs = spark.read.schema("track_roles map<string,struct<role:string,confidence:double>>").option("multiLine", "true").json(pattern)
    return docs.select(clip_of_path().alias("clip_id"), F.explode("track_roles").alias("track_id", "r")).select("clip_id", F.col("track_id").cast("long").alias("track_id"), "r.role", F.col("r.confidence").alias("role_confidence"))


def read_labels_csv(spark: SparkSession, pattern: str, fps: DataFrame) -> DataFrame:
    """Label worksheets (with or without a byte-order mark): a row per label with a type and a place in time.

    The frame is the ``frame`` column where it is all digits, else the clock ``mm:ss.s`` times ``fps(clip_id, fps)``."""
    # Names are ASCII: what remains of a mark or of odd spaces goes.
    raw = spark.read.option("header", "true").option("encoding", "UTF-8").csv(pattern)
    sheet = raw.select(clip_of_path().alias("clip_id"), *[F.col(f"`{c}`").alias(c.encode("ascii", "ignore").decode().strip().lower()) for c in raw.columns])
    text = lambda c: F.trim(F.col(c)) if c in sheet.columns else F.lit(None).cast("string")
    clock = F.regexp_extract(F.coalesce(text("time"), F.lit("")), r"^([0-9]+):([0-9]+(?:[.][0-9]*)?)$", 1)
    seconds = F.when(clock != "", clock.cast("int") * 60 + F.regexp_extract(text("time"), r"^([0-9]+):([0-9]+(?:[.][0-9]*)?)$", 2).cast("double"))
    frame = F.when(F.coalesce(text("frame").rlike("^[0-9]+$"), F.lit(False)), text("frame").cast("long")).otherwise(F.bround(seconds * F.col("fps")).cast("long"))
    rows = sheet.join(fps.select("clip_id", "fps"), "clip_id").select("clip_id", frame.alias("frame"), F.lower(text("true_type")).alias("true_type"), text("hitter_role").alias("role"))
    return rows.filter("frame is not null and coalesce(true_type, '') <> ''")


def write_table(df: DataFrame, path: str, force: bool = False, by: str | None = None) -> None:
    """Writes Parquet with the versions added; an existing table is kept unless ``force`` is set."""
    writer = df.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "stage_version": F.lit(STAGE_VERSION)}).write.mode("overwrite" if force else "errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares (spark.checkpoint.dir), for tables on the way. A local session without
    that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from it, and lost executors don't undo it."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
