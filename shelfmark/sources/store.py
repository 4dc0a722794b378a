"""The tables of a run that goes on over many waves.

Every table lies under one shared folder and is partitioned by wave, so that a
wave writes its own partition and nothing else, and writes the same rows to the
same place if it is repeated after a crash. Tables that later waves look rows
up in are bucketed by their key as well: a join with them moves the new rows
only. The catalog entries are made from the folder whenever a session opens it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind -> (columns, key that the table is bucketed by)
TABLES: dict[str, tuple[str, str | None]] = {
    "files": (
        "path string, filename string, extension string, parent_folder string, relative_path string, size_bytes bigint, modified_time timestamp_ntz",
        None,
    ),
    "decisions": (
        "path string, category string, confidence int, entity_detected string, reasoning string, action string, decided_by string, "
        "original_category string, original_confidence int, changed_after_critique boolean, critique string, alternatives array<string>, processed_at timestamp_ntz",
        "path",
    ),
    "variants": ("group_key string, path string, not_final int, draft int, below decimal(38,0), age bigint", "group_key"),
    "names": ("name string", None),
    "moves": ("path string, category string, filename string, dest string", None),
    "log": ("action string, source string, dest string, level string, ts timestamp_ntz", None),
    "worksheet": ("path string, filename string, size_bytes bigint, category string, alternatives array<string>, bucket string, row_no bigint, page bigint", None),
    "waves": ("arrived bigint, bytes bigint, decided bigint, errors bigint, seconds double", None),
}


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    names: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def open(spark: SparkSession, root: str, buckets: int | None = None) -> Store:
        """The store in ``root``, created there if it is new; ``buckets`` counts for a new one only."""
        root = root.rstrip("/")
        of = spark._jvm.org.apache.hadoop.fs.Path
        files = of(root).getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(of(f"{root}/buckets")):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(n).alias("buckets")).coalesce(1).write.parquet(f"{root}/buckets")
        n = spark.read.parquet(f"{root}/buckets").first()["buckets"]
        names = {}
        for kind, (columns, key) in TABLES.items():
            name = f"shelfmark_{hashlib.md5(root.encode()).hexdigest()[:12]}_{kind}"
            files.mkdirs(of(f"{root}/{kind}"))
            clustered = f"clustered by ({key}) into {n} buckets" if key else ""
            spark.sql(f"create table if not exists {name} ({columns}, wave int) using parquet partitioned by (wave) {clustered} location '{root}/{kind}'")
            spark.sql(f"alter table {name} recover partitions")
            names[kind] = name
        return Store(spark, root, names)

    def put(self, kind: str, rows: DataFrame, wave: int) -> None:
        """Make ``rows`` the wave's part of a table, whatever an earlier attempt has left there."""
        columns, key = TABLES[kind]
        picked = [c.split()[0] for c in columns.replace("decimal(38,0)", "decimal").split(", ")]
        rows = rows.select(*picked)
        if key:
            n = rows.sparkSession.read.parquet(f"{self.root}/buckets").first()["buckets"]
            rows = rows.repartition(n, key)
        view = f"{self.names[kind]}_rows"
        rows.createOrReplaceTempView(view)
        rows.sparkSession.sql(f"insert overwrite table {self.names[kind]} partition (wave = {int(wave)}) select * from {view}")
        rows.sparkSession.catalog.dropTempView(view)

    def before(self, kind: str, wave: int, spark: SparkSession | None = None) -> DataFrame:
        """Rows of earlier waves; what an attempt at this wave has left is not seen."""
        return (spark or self.spark).table(self.names[kind]).filter(F.col("wave") < wave)

    def all(self, kind: str) -> DataFrame:
        return self.spark.table(self.names[kind])

    def forget(self) -> None:
        """Drop the catalog entries; the folder stays."""
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")
