"""Parquet tables with insert-or-replace: the store of chunks, vectors, nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.graph import latest


class TableStore:
    """Versions of tables below one folder; the last committed version of each is read, the one before stays for its readers."""

    KEPT = 2

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not self.fs.exists(path):
            return []
        found = [s.getPath() for s in self.fs.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and self.fs.exists(done(p, "_SUCCESS")))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise ValueError(f"no table {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{versions[-1]}")

    def overwrite(self, name: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        version = (self._versions(name) or [0])[-1] + 1
        rows.write.partitionBy(*partition_by).parquet(f"{self.root}/{name}/v{version}")
        for old in self._versions(name)[: -self.KEPT]:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v{old}"), True)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], order: str, partition_by: tuple[str, ...] = ()) -> None:
        """Rows with the same keys are replaced, by ``order``; writing the same rows again changes nothing."""
        every = self.read(name).unionByName(rows, allowMissingColumns=True) if self.exists(name) else rows
        self.overwrite(name, latest(every, keys, order), partition_by)

    def clear(self, name: str) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)

    def collections(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def healthy(self) -> bool:
        """Whether the session runs queries and the folder of the store is there and can be listed."""
        try:
            self.spark.sql("SELECT 1").collect()
            self.fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.root))
            return True
        except Exception:  # noqa: BLE001 - whatever it is, it isn't healthy
            return False


def scroll(rows: DataFrame, limit: int, cursor: str | None = None, identity: str = "id", **equal: str) -> DataFrame:
    """A page by identity from the cursor on, with ``is_next`` on the row whose identity is the next page's cursor."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    if cursor is not None:
        rows = rows.where(F.col(identity) >= cursor)
    return rows.orderBy(identity).limit(limit + 1)


def collection_info(points: DataFrame, vector: str = "embedding") -> DataFrame:
    return points.agg(F.count("*").alias("points_count"), F.max(F.size(vector)).alias("vector_size"), F.count(vector).alias("with_vector")).withColumn("distance", F.lit("Cosine"))


def duplicate_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of uniqueness: keys and how often they occur."""
    return rows.groupBy(*keys).count().where("count > 1")
