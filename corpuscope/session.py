"""Session settings and the few helpers that depend on the cluster the job runs on."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows up to which a side may be broadcast after its size was counted
BROADCAST_ROWS = 200_000


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE with skew handling, Arrow)."""
    builder = (
        SparkSession.builder.appName("corpuscope")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_corpuscope_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corpuscope-")) / "corpuscope.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._corpuscope_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; a local one only where none is set."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpuscope-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that lost executors do not restart the loop."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Free the shuffle files of tables that are used no more: executors keep them on their disks until the driver collects its garbage, which it may not do for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than ``max_rows + 1``."""
    return df.limit(max_rows + 1).count() <= max_rows


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among those of ``ids``. The ids are broadcast when their counted size allows it, so that ``df`` is filtered where it is read."""
    wanted = ids.select(key).distinct()
    return df.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, key, "left_semi")


def join_on_hot_keys(big: DataFrame, small: DataFrame, keys: list[str], *, salt_by: list[str],
                     small_fits: bool | None = None, salts: int = 32, how: str = "inner") -> DataFrame:
    """Equi-join where one key may hold a large share of ``big``.

    ``small`` is broadcast when its counted size allows it (``small_fits`` passes on a count made before). Otherwise the rows of one key of ``big``
    are spread over ``salts`` groups by a hash of ``salt_by`` and ``small`` is repeated once per salt.
    """
    if fits_broadcast(small) if small_fits is None else small_fits:
        return big.join(F.broadcast(small), keys, how)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_big.join(salted_small, keys + ["_salt"], how).drop("_salt")


def task_count(spark: SparkSession) -> int:
    """Partitions for a stage whose work per byte is high: the configured shuffle width, never less than the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


#: input bytes per core up to which a table counts as small: one file split
SPREAD_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a small table over all cores by ``keys``; a table of at least one split per core passes through unchanged.

    A table in one small file would otherwise keep a whole text stage on one core. The decision uses the optimizer's size
    estimate only, so nothing runs, and an input whose size is unknown is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if estimate < cores * SPREAD_BYTES else df
