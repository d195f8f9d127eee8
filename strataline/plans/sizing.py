"""The declared choice between the plain and the skew-proof form of a plan, and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKEW_KEY = "strataline.skewProof"
ROWS_KEY = "strataline.maxRowsPerTask"   # rows of a block of the skew-proof form
DEFAULT_ROWS = 2_000_000


def row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_KEY, str(DEFAULT_ROWS)))


def skew_proof(df: DataFrame) -> bool:
    """Whether the session declares that single instruments, dates or groups may be too long for one task.

    Declared (``strataline.skewProof``), never measured: no job runs while a query is built, and a plan does not change
    its form as the data grow.  Both forms give the same rows.
    """
    return df.sparkSession.conf.get(SKEW_KEY, "false").lower() == "true"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder, from its configuration or set on its context.

    A folder of our own is only set where the session names none and runs
    locally, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the shared checkpoint folder of the session."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_folder(spark))
    return df.checkpoint()


def split_points(df: DataFrame, column: str, parts: int) -> list[float]:
    """Approximate quantiles as literal, deterministic range bounds."""
    parts = max(2, int(parts))
    probs = [i / parts for i in range(1, parts)]
    found = df.approxQuantile(column, probs, 1.0 / (4 * parts))
    return sorted(set(float(v) for v in found))


def with_range_bucket(df: DataFrame, column: str, splits: list[float], out: str) -> DataFrame:
    """Add the order-preserving bucket number of ``column`` (binary search, JVM side)."""
    from pyspark.ml.feature import Bucketizer

    if not splits:
        return df.withColumn(out, F.lit(0.0))
    edges = [-float("inf")] + splits + [float("inf")]
    return Bucketizer(splits=edges, inputCol=column, outputCol=out, handleInvalid="keep").transform(df)
