"""Readers. Every CSV is read with a fixed schema: no inference pass, pruned at the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardwise.operators.shapes import plans_to_long
from wardwise.schemas import CENSUS_BLOCKS, PRECINCTS, SCENARIO, fill_counts, require_columns, to_long_names


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV with a header, its columns matched to the schema by position and checked by name."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def read_precincts(spark: SparkSession, path: str) -> DataFrame:
    """Precincts from Parquet, or from CSV in the standard column order."""
    df = read_csv(spark, path, PRECINCTS) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return require_columns(df, ["precinct_id", "population"])


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """A shape file's attribute table under short names, with derivable counts filled in."""
    df = require_columns(spark.read.parquet(path), ["pct_id", "pop", "pct_min", "dem_vsh"])
    return fill_counts(to_long_names(df))


def read_census(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Census block files of any number of states, each tagged with the state in its file name.

    The schema keeps identifiers as text and counts as doubles; files named
    ``<state>_....csv`` lie under ``path``.
    """
    df = spark.read.csv(path, schema=CENSUS_BLOCKS, header=True, enforceSchema=False, pathGlobFilter="*.csv",
                        recursiveFileLookup=True)
    state = F.regexp_extract(F.col("_metadata.file_path"), r"/([a-z]+)_[^/]*(?:/[^/]*)?$", 1)
    return df.select(*(columns or df.columns), state.alias("state"))


def read_scenarios(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A tree of ``seg_level=.../redist_level=...`` folders; scenario filters prune folders."""
    reader = spark.read.option("basePath", path)
    df = reader.schema(schema).parquet(path) if schema is not None else reader.parquet(path)
    return require_columns(df, SCENARIO)


def read_wide_plans(spark: SparkSession, path: str, district_base: int = 0) -> DataFrame:
    """A plan matrix (one column per plan) as one row per plan and precinct.

    Only the header line is read to learn the plan names.
    """
    header = spark.read.text(path).where(F.col("value").contains("precinct_id")).first()[0]
    schema = StructType([StructField(c.strip().strip('"'), LongType()) for c in header.split(",")])
    return plans_to_long(read_csv(spark, path, schema), district_base=district_base)
