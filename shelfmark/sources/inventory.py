"""Inventory sources: manifest tables, binary file listings, many roots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths as P

LISTING = "path string, size_bytes long, modified_time timestamp_ntz"


def inventory_from_manifest(manifest: DataFrame, root_col: str | None = None) -> DataFrame:
    """Inventory columns from ``(path, size_bytes, modified_time[, root])`` rows.

    ``relative_path`` is taken from the manifest, or cut from ``path`` by ``root_col``.
    """
    df = manifest
    if root_col:
        df = df.withColumn(
            "relative_path", F.substring("path", F.length(root_col) + 2, F.length("path"))
        )
    name = P.filename_of(F.col("relative_path"))
    return df.select(
        "path",
        name.alias("filename"),
        P.extension_of(name).alias("extension"),
        "size_bytes",
        "modified_time",
        P.parent_name_of(F.col("path")).alias("parent_folder"),
        "relative_path",
    )


def list_binary_files(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of visible files below ``root``; file content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    clean = F.regexp_replace("path", "^file:/*", "/")
    return files.select(
        clean.alias("path"),
        F.col("length").alias("size_bytes"),
        F.to_timestamp_ntz(F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias(
            "modified_time"
        ),
    )


LIST_ROWS = 50_000


def _list_folder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One level of listing for each folder, hidden names included, in bounded chunks."""
    import datetime as dt
    import itertools
    import os

    def entries(folder):
        try:
            with os.scandir(folder) as found:
                for e in found:
                    try:
                        if e.is_symlink() and e.is_dir():
                            continue  # a link to a folder is neither a file nor entered
                        st = e.stat()
                        when = dt.datetime.fromtimestamp(st.st_mtime, dt.timezone.utc).replace(tzinfo=None)
                        yield e.path, e.is_dir(follow_symlinks=False), st.st_size, when, None
                    except OSError as err:
                        yield e.path, False, None, None, str(err)
        except OSError as err:
            yield folder, True, None, None, str(err)

    rows = itertools.chain.from_iterable(entries(f) for batch in batches for f in batch["path"])
    while chunk := list(itertools.islice(rows, LIST_ROWS)):
        out = pd.DataFrame(chunk, columns=["path", "is_dir", "size_bytes", "modified_time", "error"])
        out["size_bytes"] = out["size_bytes"].astype("Int64")
        out["modified_time"] = pd.to_datetime(out["modified_time"])
        yield out


def list_all_files(spark: SparkSession, root: str, skip_folders: Sequence[str] = ()) -> DataFrame:
    return list_tree(spark, root, skip_folders)[0]


def list_tree(spark: SparkSession, root: str, skip_folders: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Files of a mounted file system, hidden ones included, and (path, message) of what could not be read.

    Spark's own file index drops names that begin with ``_`` or ``.``. The tree
    is listed level by level: each level's folders are spread over the tasks.
    Skipped folders are pruned before they are entered.
    """
    from shelfmark.session import materialize

    schema = "path string, is_dir boolean, size_bytes long, modified_time timestamp_ntz, error string"
    skip = [s.lower() for s in skip_folders]
    level = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    files = errors = None
    while not level.isEmpty():
        found = materialize(level.mapInPandas(_list_folder, schema), "listing")
        here = found.filter(~F.col("is_dir") & F.col("error").isNull()).select(
            "path", "size_bytes", "modified_time"
        )
        files = here if files is None else files.unionByName(here)
        failed = found.filter(F.col("error").isNotNull()).select("path", F.col("error").alias("message"))
        errors = failed if errors is None else errors.unionByName(failed)
        folders = found.filter(F.col("is_dir") & F.col("error").isNull())
        if skip:
            folders = folders.filter(~F.lower(P.filename_of(F.col("path"))).isin(skip))
        level = folders.select("path").repartition(
            spark.sparkContext.defaultParallelism, F.xxhash64("path")
        )
    return files, errors


def multi_root_inventory(
    manifest: DataFrame, roots: DataFrame, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Inventory of every declared root plus one error row per unusable root.

    ``manifest`` has ``(root, path, relative_path, size_bytes, modified_time)``,
    ``roots`` has ``(root, kind)`` with kind ``dir``, ``file`` or ``missing``.
    ``limit`` keeps the first rows by path over all roots.
    """
    usable = roots.filter("kind = 'dir'").select("root").distinct()
    files = manifest.join(usable, "root", "left_semi")
    if limit:
        files = files.orderBy("path").limit(limit)
    errors = roots.filter("kind <> 'dir'").select(
        "root",
        F.when(F.col("kind") == "missing", F.concat(F.lit("Root does not exist: "), "root"))
        .otherwise(F.concat(F.lit("Root is not a directory: "), "root"))
        .alias("message"),
    )
    return inventory_from_manifest(files), errors


def probe_roots(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """``(root, kind)`` for configured roots, asked of the Hadoop file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = []
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            kind = "missing"
        else:
            kind = "dir" if fs.getFileStatus(path).isDirectory() else "file"
        rows.append((root, kind))
    return spark.createDataFrame(rows, "root string, kind string")
