"""Table layouts, column checks, name maps and scenario labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

PLAN = ["map_id", "seg_level", "redist_level"]
DISTRICT = [*PLAN, "district_id"]
SCENARIO = ["seg_level", "redist_level"]

COUNTS = [
    "population", "n_minority", "n_majority", "dem_votes", "rep_votes",
    "dem_votes_minority", "rep_votes_minority", "dem_votes_majority", "rep_votes_majority",
]
SHARES = ["per_minority", "dem_voteshare", "dem_voteshare_minority", "dem_voteshare_majority"]

PRECINCTS = StructType(
    [StructField("precinct_id", LongType())]
    + [StructField(c, LongType()) for c in COUNTS]
    + [StructField(c, DoubleType()) for c in SHARES]
)
ASSIGNMENTS = StructType([
    StructField("map_id", LongType()),
    StructField("seg_level", StringType()),
    StructField("redist_level", StringType()),
    StructField("precinct_id", LongType()),
    StructField("district_id", LongType()),
])
CENSUS_BLOCKS = StructType([
    StructField("GEOID20", StringType()),
    StructField("CVAP_TOT22", DoubleType()),
    StructField("CVAP_BLK22", DoubleType()),
    StructField("CVAP_WHT22", DoubleType()),
])
VOTERS = StructType([
    StructField("voter_id", LongType()),
    StructField("precinct_id", LongType()),
    StructField("race", LongType()),
    StructField("vote", LongType()),
])
DRAWS = StructType([
    StructField("map_id", LongType()),
    StructField("seg_level", StringType()),
    StructField("redist_level", StringType()),
    StructField("district_id", LongType()),
    StructField("precinct_id", LongType()),
    StructField("draw", LongType()),
    StructField("beta_min", DoubleType()),
    StructField("beta_maj", DoubleType()),
])
REGRESSION = StructType([
    StructField("map_id", LongType()),
    StructField("seg_level", StringType()),
    StructField("redist_level", StringType()),
    StructField("district_id", LongType()),
    StructField("er_minority_dem_share", DoubleType()),
    StructField("er_majority_dem_share", DoubleType()),
    StructField("er_minority_se", DoubleType()),
    StructField("er_majority_se", DoubleType()),
    StructField("er_rpv", LongType()),
    StructField("true_minority_dem_share", DoubleType()),
    StructField("true_majority_dem_share", DoubleType()),
    StructField("true_rpv", LongType()),
    StructField("er_minority_resid", DoubleType()),
    StructField("er_majority_resid", DoubleType()),
    StructField("er_rpv_error", LongType()),
    StructField("n_precincts", LongType()),
    StructField("total_population", LongType()),
])

# Short attribute names used in shape files, and their long names.
SHORT_TO_LONG = {
    "pct_id": "precinct_id",
    "pop": "population",
    "n_min": "n_minority",
    "n_maj": "n_majority",
    "dem_v": "dem_votes",
    "rep_v": "rep_votes",
    "dem_v_min": "dem_votes_minority",
    "rep_v_min": "rep_votes_minority",
    "dem_v_maj": "dem_votes_majority",
    "rep_v_maj": "rep_votes_majority",
    "pct_min": "per_minority",
    "dem_vsh": "dem_voteshare",
    "dem_vsh_1": "dem_voteshare_minority",
    "dem_vsh_0": "dem_voteshare_majority",
    "urb": "urbanness",
}
LONG_TO_SHORT = {long: short for short, long in SHORT_TO_LONG.items()}

# Scenario codes, their display labels and their order.
SEG_LABELS = {"low": "Low", "medium": "Medium", "high": "High"}
REDIST_LABELS = {"dem": "Dem", "middle": "Neutral", "rep": "Rep"}


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` itself, or an error that lists the absent columns. Runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def to_long_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({s: n for s, n in SHORT_TO_LONG.items() if s in df.columns})


def to_short_names(df: DataFrame) -> DataFrame:
    """Attribute table under short names; absent group vote shares become 0."""
    shares = [c for c in SHARES[2:] if c in df.columns]
    return df.fillna(0.0, subset=shares).withColumnsRenamed(
        {n: s for n, s in LONG_TO_SHORT.items() if n in df.columns}
    )


def fill_counts(df: DataFrame) -> DataFrame:
    """Counts and shares that can be derived from the others, where they are absent."""
    have = set(df.columns)
    rules = {
        "n_minority": F.bround(F.col("per_minority") * F.col("population")).cast("bigint"),
        "dem_votes": F.bround(F.col("dem_voteshare") * F.col("population")).cast("bigint"),
    }
    out = df.withColumns({c: e for c, e in rules.items() if c not in have})
    late = {
        "n_majority": F.col("population") - F.col("n_minority"),
        "rep_votes": F.col("population") - F.col("dem_votes"),
        "rep_voteshare": F.lit(1.0) - F.col("dem_voteshare"),
    }
    return out.withColumns({c: e for c, e in late.items() if c not in have})


def _label(code: Column, labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])[code]


def _rank(code: Column, order: list[str]) -> Column:
    """1-based place of a code, matched on either the code or its label."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), code).cast("int")


def seg_rank(code="seg_level") -> Column:
    return _rank(F.lower(F.col(code)), list(SEG_LABELS))


def redist_rank(code="redist_level") -> Column:
    lowered = F.lower(F.col(code))
    return _rank(F.when(lowered == "neutral", "middle").otherwise(lowered), list(REDIST_LABELS))


def label_scenarios(df: DataFrame) -> DataFrame:
    """Display labels for the scenario codes, plus their ranks for sorting."""
    return df.withColumns({
        "seg_label": _label(F.col("seg_level"), SEG_LABELS),
        "redist_label": _label(F.col("redist_level"), REDIST_LABELS),
        "seg_rank": seg_rank(),
        "redist_rank": redist_rank(),
    })


def order_scenarios(df: DataFrame) -> DataFrame:
    return df.orderBy(seg_rank(), redist_rank())
