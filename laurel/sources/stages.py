"""Written stages: Parquet tables that cut lineage and are reused when unchanged."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from laurel.config import MetricConfig


@dataclass(frozen=True)
class Layout:
    """How the files of a stage are divided.

    ``split_by`` names an integer column with few values: each value has files of its own, a
    filter on it reads only those and tells Catalyst their size. ``bucket_by`` names a key:
    its rows lie in sorted buckets, as many as the store makes, and later joins, windows and
    sums by that key read them without an exchange.
    """

    split_by: str | None = None
    bucket_by: str | None = None


PLAIN = Layout()

# Stages are written once and read a few times: smaller files are worth the slower codec.
COMPRESSION = "zstd"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def file_identity(df: DataFrame) -> str:
    """Digest of the files that a table is read from; empty for a table that is not read from files."""
    files = sorted(df.inputFiles())
    return hashlib.sha256("\n".join(files).encode()).hexdigest()[:16] if files else ""


class StageStore:
    """Parquet stages below ``root``, keyed by name, configuration, inputs and layout.

    ``partitions`` is what the size of the inputs calls for: stages are written with so many
    shuffle partitions and buckets, or with the session's number if that is greater.
    """

    def __init__(self, spark: SparkSession, root: str, inputs: str = "", partitions: int = 0) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.inputs = inputs
        self.partitions = partitions

    @property
    def buckets(self) -> int:
        return max(int(self.spark.conf.get(SHUFFLE_PARTITIONS)), self.partitions)

    @contextmanager
    def _enough_partitions(self) -> Iterator[None]:
        """As many shuffle partitions as buckets while a stage is written; the session's number after it."""
        usual = self.spark.conf.get(SHUFFLE_PARTITIONS)
        self.spark.conf.set(SHUFFLE_PARTITIONS, str(self.buckets))
        try:
            yield
        finally:
            self.spark.conf.set(SHUFFLE_PARTITIONS, usual)

    def path(self, name: str, cfg: MetricConfig, layout: Layout = PLAIN) -> str:
        divided = [layout.split_by] if layout.split_by else []
        if layout.bucket_by:
            divided += [layout.bucket_by, str(self.buckets)]
        return f"{self.root}/{name}-{cfg.fingerprint(name, self.inputs, *divided)}"

    @staticmethod
    def table_name(path: str) -> str:
        """The name of a stage in buckets in the session's catalog."""
        return f"laurel_{hashlib.sha256(path.encode()).hexdigest()[:24]}"

    def is_complete(self, path: str) -> bool:
        """A stage exists once its job has committed, not while it is being written."""
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return marker.getFileSystem(conf).exists(marker)

    def get_or_build(
        self,
        name: str,
        cfg: MetricConfig,
        build: Callable[[], DataFrame],
        layout: Layout = PLAIN,
    ) -> DataFrame:
        """Read the stage, writing it first unless a complete one is there.

        Stages belong on storage that all executors share.

        File count and size follow the shuffle partitions AQE settles on; reading
        back gives Catalyst the true size of the stage for its join choices.
        """
        path = self.path(name, cfg, layout)
        if layout.bucket_by:
            return self._bucketed(path, build, layout.bucket_by)
        if not self.is_complete(path):
            with self._enough_partitions():
                writer = build().write.option("compression", COMPRESSION).mode("overwrite")
                if layout.split_by:
                    writer = writer.partitionBy(layout.split_by)
                writer.parquet(path)
        return self.spark.read.parquet(path)

    def _bucketed(self, path: str, build: Callable[[], DataFrame], key: str) -> DataFrame:
        """A stage in sorted buckets: external files under a name of the session's catalog.

        A run that resumes finds the files and names them again.
        """
        name = self.table_name(path)
        if not self.is_complete(path):
            with self._enough_partitions():
                (
                    build().repartition(self.buckets, key)
                    .write.bucketBy(self.buckets, key).sortBy(key)
                    .option("path", path).option("compression", COMPRESSION).format("parquet").mode("overwrite").saveAsTable(name)
                )
        elif not self.spark.catalog.tableExists(name):
            columns = ", ".join(
                f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema
            )
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{path}' "
                f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {self.buckets} BUCKETS"
            )
        return self.spark.table(name)
