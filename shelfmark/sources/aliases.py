"""Alias store: canonical names with aliases, plus learned names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("entity_mappings", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("learned_entities", T.ArrayType(T.StringType())),
        T.StructField(
            "fuzzy_matches_pending_confirmation",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("detected", T.StringType()),
                        T.StructField("possible_match", T.StringType()),
                        T.StructField("confidence", T.IntegerType()),
                        T.StructField("file_path", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(mappings, learned, pending)`` tables of one JSON store file."""
    store = spark.read.schema(STORE).json(path, multiLine=True)
    mappings = store.select(F.posexplode_outer("entity_mappings").alias("ord", "canonical", "aliases"))
    learned = store.select(F.posexplode_outer("learned_entities").alias("ord", "name"))
    pending = store.select(F.inline("fuzzy_matches_pending_confirmation"))
    return (
        mappings.filter(F.col("canonical").isNotNull()),
        learned.filter(F.col("name").isNotNull()),
        pending,
    )


def flatten_aliases(mappings: DataFrame, learned: DataFrame) -> DataFrame:
    """``(alias, canonical, ord)`` with lower-cased unique aliases.

    ``mappings``: (ord, canonical, aliases); ``learned``: (ord, name). A later
    entry with an equal alias takes over its canonical name, but the alias
    keeps the place in the order where it first appeared.
    """
    listed = mappings.select(
        F.lit(0).alias("part"),
        F.col("ord").cast("long").alias("major"),
        F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("minor", "alias"),
        "canonical",
    )
    names = learned.select(
        F.lit(1).alias("part"),
        F.col("ord").cast("long").alias("major"),
        F.lit(0).alias("minor"),
        F.col("name").alias("alias"),
        F.col("name").alias("canonical"),
    )
    place = F.struct("part", "major", "minor")
    return (
        listed.unionByName(names)
        .groupBy(F.lower("alias").alias("alias"))
        .agg(F.min(place).alias("ord"), F.max_by("canonical", place).alias("canonical"))
    )
