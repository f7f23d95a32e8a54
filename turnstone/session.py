"""Session settings the engine expects, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that matter at scale. AQE sizes the shuffle partitions, turns small join sides into
# broadcasts only after measuring them, and splits skewed join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # intermediate results written to the shared folder go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # the last of several equal keys wins instead of failing the line
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "turnstone", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def session_like(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A second session over the same context: the settings of this one, changed as given; this one stays as it is."""
    other = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in settings.items():
        other.conf.set(key, value)
    return other


def adopted(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """A frame of another session as one of this session: its queries run here, its sources keep their settings."""
    plan = frame._jdf.logicalPlan()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` when the cluster names one.

    Only where it is unset (single-machine tests) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fresh = tempfile.mkdtemp(prefix="turnstone-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


def checkpointed(frame: DataFrame) -> DataFrame:
    """Compute an intermediate result once, into the shared folder, for several uses."""
    context = frame.sparkSession.sparkContext
    folder = shared_dir(frame.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return frame.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, unique per call."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and safe from lost executors."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def evaluated_once(frame: DataFrame) -> DataFrame:
    """The same rows, with every column computed before any later filter.

    The optimizer pushes filters below a projection and repeats its expressions there. That is
    wanted for cheap columns but would parse a line once per condition, so the columns pass
    through a one-row generator, which conditions on them cannot cross.
    """
    return frame.select(F.inline(F.array(F.struct(*frame.columns))))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name of results from separate roots."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first
