"""Collections: named tables with fixed fields in a folder that all executors share, written version by version.

A version is a Parquet folder; the newest complete one is what readers see, so a lost executor or a failed write leaves
the version before in place. The KEPT versions before the newest stay, so that readers that have begun can end. Upserts are one aggregation by key over the stored rows and the new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of the four kinds of collections.
KINDS = {
    "chunk": "uuid string, chunk_id string, book_id string, context string, section string, text string, token_count int, vector array<double>",
    "tree": "uuid string, chunk_id string, book_id string, context string, section string, text string, token_count int, tree_level int, is_summary boolean, parent_ids array<string>, child_ids array<string>, cluster_id string, source_chunk_ids array<string>, vector array<double>",
    "community": "uuid string, community_id string, summary string, member_count int, relationship_count int, level int, members_json string, relationships_json string, vector array<double>",
    "entity": "uuid string, entity_name string, normalized_name string, entity_type string, description string, vector array<double>",
}


#: Versions that stay besides the newest one.
KEPT = 2


class Collection:
    """A table of one folder. fields is a DDL string or one of KINDS; key is what rows are told apart by."""

    def __init__(self, spark: SparkSession, root: str, name: str, fields: str, key: str = "uuid") -> None:
        self.spark, self.path, self.fields, self.key = spark, f"{root.rstrip('/')}/{name}", KINDS.get(fields, fields), key
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, oldest first; empty if the collection doesn't exist."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def _write(self, rows: DataFrame, old: list[int]) -> None:
        names = [f.name for f in self.spark.createDataFrame([], self.fields).schema]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.path}/v{old[-1] + 1 if old else 0}")
        for v in old[:-KEPT]:
            self._fs.delete(self._at(f"{self.path}/v{v}"), True)

    def create(self) -> bool:
        """An empty collection; tells whether there was none."""
        if self.versions():
            return False
        self._write(self.spark.createDataFrame([], self.fields), [])
        return True

    def drop(self) -> bool:
        """Tells whether there was one."""
        found = bool(self.versions())
        self._fs.delete(self._at(self.path), True)
        return found

    def rows(self) -> DataFrame:
        old = self.versions()
        if not old:
            raise ValueError(f"no collection at {self.path}")
        return self.spark.read.schema(self.fields).parquet(f"{self.path}/v{old[-1]}")

    def _filled(self, new: DataFrame) -> DataFrame:
        """new with all fields, those it lacks null; other columns are left out, but for seq."""
        given = set(new.columns)
        fields = self.spark.createDataFrame([], self.fields).schema
        filled = [(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        return new.select(*filled, (F.col("seq") if "seq" in given else F.lit(0)).cast("long").alias("_seq"))

    def upsert(self, new: DataFrame) -> None:
        """Rows of new replace stored ones of their key; of equal keys in new the one of largest seq wins."""
        old, fresh = self.versions(), self._filled(new).withColumn("_late", F.lit(1))
        rows = fresh.unionByName(self.rows().withColumns({"_seq": F.lit(0).cast("long"), "_late": F.lit(0)})) if old else fresh
        names = [c for c in rows.columns if c not in ("_seq", "_late")]
        best = rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*names), F.struct("_late", "_seq")).alias("_row"))
        self._write(best.select("_row.*"), old)

    def insert(self, new: DataFrame) -> None:
        """Rows of new whose key isn't stored yet; of equal keys in new the one of smallest seq. Rows without a vector are skipped where there are vectors."""
        old, fresh = self.versions(), self._filled(new)
        names = [c for c in fresh.columns if c != "_seq"]
        if "vector" in names:
            fresh = fresh.where("vector IS NOT NULL")
        fresh = fresh.groupBy(F.col(self.key).alias("_key")).agg(F.min_by(F.struct(*names), "_seq").alias("_row")).select("_row.*")
        if old:
            stored = self.rows()
            fresh = stored.unionByName(fresh.join(stored.select(self.key), self.key, "left_anti").select(*stored.columns))
        self._write(fresh, old)

    def clear(self) -> int:
        """Number of rows that were deleted."""
        n, old = self.rows().count(), self.versions()
        self._write(self.spark.createDataFrame([], self.fields), old)
        return n
