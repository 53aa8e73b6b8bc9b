"""Folders that every executor sees, and tables in them that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


FILE_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, in local mode only, a temporary one, set here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kindred-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


OPEN: list[Scratch] = []


@atexit.register
def leave() -> None:
    for scratch in OPEN:
        with contextlib.suppress(Exception):  # the session may have ended before
            scratch.drop()


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Scratch tables made inside are dropped at the end: what is to stay must be written to others by then."""
    first = len(OPEN)
    yield
    for scratch in OPEN[first:]:
        scratch.drop()
    del OPEN[first:]


class Scratch:
    """Parquet tables in the shared folder that belong to one run of an operator.

    They stay while results that read them may be used; the driver removes them when it ends, and drop() before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kindred-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        OPEN.append(self)

    def freeze(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write df and read it back: later jobs start from the files, whichever executors are lost.

        rows, an upper bound if it is known, spares small tables many small files and tasks.
        """
        path = f"{self.root}/{name}"
        if rows is not None:
            df = gathered(df, rows)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Write df with all rows of a key in one file, so that grouping by the key needs no shuffle later."""
        table = f"kindred_{uuid.uuid4().hex}"
        (
            df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
            .option("path", f"{self.root}/{table}").option("compression", "zstd").format("parquet").saveAsTable(table)
        )
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Delete what was written (everything without names); only what no later job reads."""
        jvm = self.spark._jvm
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        if not names:
            for t in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as rows, an upper bound, need: a table of few rows is grouped and joined without a shuffle."""
    return df.coalesce(1 + rows // FILE_ROWS)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
