"""Session settings and the shared staging folder."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_LOCAL_STAGING: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a temporary folder, because there
    driver and executors are one machine. On a cluster the setting is required.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_STAGING:
        _LOCAL_STAGING[app] = tempfile.mkdtemp(prefix="barloom-")
    return _LOCAL_STAGING[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the staging folder that nothing has written to yet."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the staging folder and return a scan of it.

    Cuts the lineage where several jobs read the same intermediate rows (model fits, fold
    loops). Unlike a cached frame it survives lost executors, and later readers still get
    column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` dealt by ``keys`` to a fixed number of partitions, several for each of the session's.

    For groups that are small but slow to compute: adaptive execution would merge their tasks by
    size, down to a single one.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(4 * partitions, *keys)
