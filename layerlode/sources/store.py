"""Fitted models on disk: a folder of Parquet tables with a version; reports and debug events beside them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlode.functions.ids import topic_uid
from layerlode.functions.text import truncate_middle

VERSION = "1"
MEMBER = 255


def membership(assignments: DataFrame) -> DataFrame:
    """(object_id, layer, cluster, member): a cell of 255 for each member; noise has none."""
    return assignments.where("cluster >= 0").select("object_id", "layer", "cluster", F.lit(MEMBER).alias("member"))


def topic_rows(topics: DataFrame) -> DataFrame:
    return topics.withColumn("uid", topic_uid(F.col("layer"), F.col("cluster")))


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    """Each table to a folder of its own, then the version; a path that exists is refused."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(VERSION, sorted(tables))], "serial_version string, tables array<string>").coalesce(1).write.mode("errorifexists").parquet(f"{path}/metadata")


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    meta = spark.read.parquet(f"{path}/metadata").first()
    if meta["serial_version"] != VERSION:
        raise ValueError(f"the model has version {meta['serial_version']}, this reads {VERSION}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}


def write_reports(sheets: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """A folder for each sheet; lists become text where the format has none."""
    for name, df in sheets.items():
        if format == "csv":
            df = df.select(*[F.array_join(F.col(f"`{c}`").cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes])
        df.write.mode("errorifexists").format(format).option("header", "true").save(f"{path}/{name.lower().replace(' ', '_')}")


def write_events(events: DataFrame, path: str, most: int = 2000) -> None:
    """Debug events as lines of JSON, prompts and replies cut in the middle to ``most`` characters."""
    cut = events.withColumns({c: truncate_middle(F.col(c), most) for c in ("prompt", "reply") if c in events.columns})
    cut.write.mode("append").json(path)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; unset, a temporary folder where all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="layerlode-model-")
        atexit.register(shutil.rmtree, _own.removeprefix("file://"), ignore_errors=True)
    return _own


_own: str | None = None


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut, safe when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if path.startswith("file://"):
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def round_trip(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n, same) after the tables were written as a model and read again."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    once = {k: written(v, k) for k, v in tables.items()}
    write_model(once, path)
    again = read_model(spark, path)
    out = None
    for name, df in once.items():
        both = df.withColumn("_side", F.lit(1)).unionByName(again[name].withColumn("_side", F.lit(-1)))
        odd = both.groupBy(*df.columns).agg(F.sum("_side").alias("d")).where("d <> 0").agg(F.count("*").alias("odd"))
        row = again[name].agg(F.count("*").alias("n")).crossJoin(odd).select(F.lit(name).alias("table_name"), "n", (F.col("odd") == 0).alias("same"))
        out = row if out is None else out.unionByName(row)
    return out
