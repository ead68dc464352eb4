"""Estimates for new plans only, in batches or from a stream of plan files.

Results lie under ``<path>/results`` and the list of tried plans under
``<path>/attempts``, both in scenario folders; rows of plans that have not arrived whole
wait under ``<path>/pending``. A plan that was tried but gave no rows, or failed, is in the
attempts only, the failed one with its reason. Each run writes its own ``batch`` folder and may be repeated:
the same batch replaces itself, and plans that are already there are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from wardwise.operators.frames import precinct_stats
from wardwise.operators.regression import ecological_regression
from wardwise.operators.sampling import first_n_per_group
from wardwise.schemas import ASSIGNMENTS, PLAN, REGRESSION, SCENARIO
from wardwise.session import Scratch

Estimator = Callable[[DataFrame, DataFrame], DataFrame]
TRIED = StructType([StructField("map_id", LongType()), StructField("seg_level", StringType()),
                    StructField("redist_level", StringType()), StructField("batch", StringType()), StructField("reason", StringType())])
PENDING = StructType([*ASSIGNMENTS.fields, StructField("batch", StringType())])
#: Plans of one call that may fail before the fault is taken to lie elsewhere than in the plans.
MAX_FAILURES = 5


def _read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The table, or None before the first write."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _save(df: DataFrame, path: str, batch: str, folders: list[str]) -> None:
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders, "batch").parquet(path)


def save_results(estimates: DataFrame, tried: DataFrame, path: str, batch: str) -> None:
    """Writes one batch; the attempts go last, so an interrupted batch counts as not done."""
    _save(estimates, f"{path}/results", batch, SCENARIO)
    _save(tried, f"{path}/attempts", batch, SCENARIO)


def load_results(
    spark: SparkSession, path: str, seg_level: str | None = None, redist_level: str | None = None,
    schema: StructType = REGRESSION,
) -> DataFrame:
    """Results of all scenarios or of one; scenario filters skip the other folders.

    ``schema`` is that of the estimator's output.

    Rows of a batch whose attempts were not written are left out: it will be redone.
    """
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", StringType())])).parquet(f"{path}/results")
    if seg_level:
        rows = rows.where(F.col("seg_level") == seg_level)
    if redist_level:
        rows = rows.where(F.col("redist_level") == redist_level)
    whole = spark.read.schema(TRIED).parquet(f"{path}/attempts").select(*PLAN, "batch")
    return rows.join(whole, [*PLAN, "batch"], "left_semi").drop("batch")


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """Every tried plan, with the reason for which it failed, if it did."""
    found = _read(spark, f"{path}/attempts", TRIED)
    return (found if found is not None else spark.createDataFrame([], TRIED)).select(*PLAN, "batch", "reason")


def tried_plans(spark: SparkSession, path: str) -> DataFrame:
    return attempts(spark, path).select(*PLAN).distinct()


def failed_plans(spark: SparkSession, path: str) -> DataFrame:
    """Plans recorded as failed, each with its reason."""
    return attempts(spark, path).where("reason is not null").groupBy(*PLAN).agg(F.min("reason").alias("reason"))


def remaining_plans(plans: DataFrame, path: str) -> DataFrame:
    return plans.select(*PLAN).distinct().join(tried_plans(plans.sparkSession, path), PLAN, "left_anti")


def plan_sizes(assignments: DataFrame) -> DataFrame:
    """Every plan with its number of different precincts."""
    return assignments.select(*PLAN, "precinct_id").distinct().groupBy(*PLAN).agg(F.count("precinct_id").alias("n_precincts"))


def complete_plans(assignments: DataFrame, precincts: DataFrame) -> DataFrame:
    """Plans that assign every precinct of the table; one that lacks some has not arrived whole."""
    known = precincts.select("precinct_id").distinct()
    matched = assignments.select(*PLAN, "precinct_id").join(known, "precinct_id", "left_semi")
    return plan_sizes(matched).where(F.col("n_precincts") == known.count()).select(*PLAN)


def regress(assignments: DataFrame, precincts: DataFrame) -> DataFrame:
    return ecological_regression(precinct_stats(assignments, precincts))


def _fingerprint(plans: DataFrame) -> tuple[int, str]:
    """Number of plans, and a name that the same plans always have."""
    return plans.agg(F.count(F.lit(1)), F.hex(F.bit_xor(F.xxhash64(*PLAN)))).first()


def _reason(error: Exception) -> str:
    """The first line of an error, without its plan and stack."""
    return (str(error).strip().splitlines() or [type(error).__name__])[0][:500]


def _half(level: int) -> Column:
    """A bit of the plan's hash: which half a plan goes to when a batch is split for the ``level``-th time."""
    return F.shiftright(F.xxhash64(*PLAN), level % 64).bitwiseAND(F.lit(1))


def _estimate(
    assignments: DataFrame, plans: DataFrame, precincts: DataFrame, path: str, prefix: str, estimator: Estimator, failures: list, max_failures: int,
    level: int = 0,
) -> None:
    """Estimates and saves ``plans``; if that fails, its halves, down to the plans that fail alone.

    A good batch is one job. With f failing plans out of n there are some f log n more, and every other plan is saved on the way.
    These are asked to join the precincts by a shuffle: a broadcast would send the whole table through the driver once for each of them.
    """
    n, name = _fingerprint(plans)
    if not n:
        return
    try:
        save_results(estimator(assignments.join(plans, PLAN, "left_semi"), precincts), plans.withColumn("reason", F.lit(None).cast("string")), path, f"{prefix}{n}-{name}")
        return
    except PySparkException as error:
        if n == 1:
            failures.append((plans.first(), _reason(error), f"{prefix}1-{name}"))
            if len(failures) > max_failures:
                raise
            return
    beside = precincts if level else precincts.hint("merge")
    for half in (0, 1):
        part = plans.where(_half(level) == half)
        _estimate(assignments, part, beside, path, prefix, estimator, failures, max_failures, level + 1)


def _process(
    assignments: DataFrame, plans: DataFrame, precincts: DataFrame, path: str, prefix: str, estimator: Estimator, max_failures: int,
) -> int:
    """Tries ``plans`` (few columns, kept in the shared folder meanwhile) and records those that fail alone with their reasons."""
    spark, scratch = assignments.sparkSession, Scratch(assignments.sparkSession, "todo")
    todo = scratch.write(plans.select(*PLAN), "plans")
    n, failures = todo.count(), []
    if n:
        _estimate(assignments, todo, precincts, path, prefix, estimator, failures, max_failures)
    for plan, reason, batch in failures:
        _save(spark.createDataFrame([(*plan, reason)], StructType([*[f for f in TRIED.fields if f.name in PLAN], TRIED["reason"]])), f"{path}/attempts", batch, SCENARIO)
    scratch.drop("plans")
    return n


def process_remaining(
    assignments: DataFrame, precincts: DataFrame, path: str, max_plans: int | None = None,
    estimator: Estimator = regress, max_failures: int = MAX_FAILURES,
) -> int:
    """Estimates for plans not tried yet, at most ``max_plans`` per scenario; returns the number tried.

    ``max_plans`` is the caller's batch size: what it leaves is taken by the next call. A plan without rows for some of the precincts has not
    arrived whole and is left for a later call. A plan whose estimate fails by itself is recorded as tried, with its reason
    (``failed_plans``), and does not hold up the others. If more than ``max_failures`` plans fail, the fault is taken to lie
    elsewhere (in the estimator, or the cluster): the error is raised, what was estimated stays, and no plan is recorded as failed.
    """
    todo = remaining_plans(assignments, path).join(complete_plans(assignments, precincts), PLAN, "left_semi")
    if max_plans is not None:
        todo = first_n_per_group(todo, SCENARIO, ["map_id"], max_plans)
    return _process(assignments, todo, precincts, path, "b", estimator, max_failures)


def pending_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of plans that have not arrived whole and were not tried."""
    found = _read(spark, f"{path}/pending", PENDING)
    rows = (found if found is not None else spark.createDataFrame([], PENDING)).drop("batch")
    return rows.join(tried_plans(spark, path), PLAN, "left_anti")


def _settle_pending(spark: SparkSession, path: str) -> None:
    """Deletes the folders of pending rows of which every plan has been tried."""
    found = _read(spark, f"{path}/pending", PENDING)
    if found is None:
        return
    waiting = found.join(tried_plans(spark, path), PLAN, "left_anti").select("batch").distinct()
    done = found.select("batch").distinct().join(waiting, "batch", "left_anti")
    for row in done.collect():  # as many as deliveries since the last call
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pending/batch={row.batch}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def process_stream(
    spark: SparkSession, source: str, precincts: DataFrame, path: str, checkpoint: str,
    estimator: Estimator = regress, max_files: int | None = None, max_failures: int = MAX_FAILURES,
) -> None:
    """Processes the plan files that arrived since the last call, then stops.

    A plan that was tried before, by any stream or call on the same path, is left out. A plan may come in any number of files,
    micro-batches and calls, and rows may come twice: its rows wait under ``<path>/pending`` until every precinct is assigned, and the whole is then estimated
    once. Failing plans are recorded as by ``process_remaining``.
    """
    reader = spark.readStream.schema(ASSIGNMENTS)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    columns = [f.name for f in ASSIGNMENTS.fields]

    def handle(batch: DataFrame, batch_id: int) -> None:
        # The names are fingerprints of plans or rows, so that a repeated batch replaces itself and a new checkpoint's batches
        # replace no others.
        scratch = Scratch(spark, "arrived")
        fresh = scratch.write(batch.select(*columns).join(tried_plans(spark, path), PLAN, "left_anti"), "rows")
        gathered = scratch.write(pending_rows(spark, path).join(fresh.select(*PLAN), PLAN, "left_semi").unionByName(fresh).distinct(), "gathered")
        whole = scratch.write(complete_plans(gathered, precincts), "whole")
        rest = fresh.join(whole, PLAN, "left_anti")
        n, name = rest.agg(F.count(F.lit(1)), F.hex(F.bit_xor(F.xxhash64(*columns)))).first()
        if n:
            _save(rest, f"{path}/pending", f"p{n}-{name}", [])
        _process(gathered, whole, precincts, path, "s", estimator, max_failures)
        scratch.drop("rows", "gathered", "whole")

    query = (
        reader.parquet(source).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    _settle_pending(spark, path)


def progress_status(plans: DataFrame, path: str) -> DataFrame:
    """Plans, tried and remaining per scenario; failed plans count as tried."""
    tried = tried_plans(plans.sparkSession, path).withColumn("_done", F.lit(1))
    rows = plans.select(*PLAN).distinct().join(tried, PLAN, "left")
    return rows.groupBy(*SCENARIO).agg(
        F.count(F.lit(1)).alias("n_plans"), F.count("_done").alias("n_processed"),
    ).withColumn("n_remaining", F.col("n_plans") - F.col("n_processed"))


def progress_table(plans: DataFrame, path: str) -> DataFrame:
    """Progress with percentages, per scenario, per segregation level and in total."""
    status = progress_status(plans, path).rollup(*SCENARIO).agg(
        F.sum("n_plans").alias("n_plans"), F.sum("n_processed").alias("n_processed"))
    return status.withColumns({
        "seg_level": F.coalesce("seg_level", F.lit("total")), "redist_level": F.coalesce("redist_level", F.lit("total")),
        "percent": F.try_divide(F.col("n_processed").cast("double") * 100, F.col("n_plans").cast("double")),
    })
