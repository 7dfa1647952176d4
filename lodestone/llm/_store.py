"""Where intermediate tables go: the shared folder named by spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths of tables made since the innermost `scratch` began.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Deletes what operators wrote inside it: for work whose result is written elsewhere before it ends."""
    start = len(_made)
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for path in _made[start:]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        del _made[start:]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that one task works through.
TASK_ROWS = 50_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df in one partition where it has few rows, so that joins and sums of such tables need no exchange."""
    return df.coalesce(1) if rows <= TASK_ROWS else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys with over 1 / MANY of all rows are joined apart from the others; there are MANY at most.
MANY = 1000


def joined_by_size(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of total rows with a table of one row for each key that has `size` of them: large keys by broadcast, so that no task gets all of one."""
    least = total // MANY + 1
    many, few = F.broadcast(table.where(F.col(size) >= least)), table.where(F.col(size) < least)
    return rows.join(many, key).unionByName(rows.join(F.broadcast(many.select(key)), key, "left_anti").join(few, key))
