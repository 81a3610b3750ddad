"""Session construction and the few cluster-level settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "themeloom") -> SparkSession:
    """A session tuned for these jobs; on a cluster pass ``master=None``.

    AQE stays on (partition coalescing and skew-join splitting matter for the
    text explode / term aggregations); the UI is off; the time zone is UTC so
    results compare against a UTC-naive SQL engine.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    spark = (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers (once per application).

    Spark serves the archive to every executor, those that join later too, so
    the package need not be installed on the workers.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    name = f"{root.name}-{sc.applicationId}.zip"
    if any(x.endswith(name) for x in sc.listFiles):
        return
    made = Path(tempfile.mkdtemp(prefix=f"{root.name}-package-")) / name
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(made))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (iterative jobs).

    Read from ``spark.checkpoint.dir``. Only a local-mode session (tests,
    single-machine runs) may fall back to a fresh folder of its own; on a
    cluster a machine-local folder would be lost with its executor, so an unset
    setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared (cluster-wide) folder")
        # spark.checkpoint.dir is a core setting that cannot change at run time;
        # a local session without it gets a folder of its own
        d = tempfile.mkdtemp(prefix="themeloom-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    The plan runs once, later readers prune columns, and a lost executor costs
    only the tasks it ran."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into ``spark.checkpoint.dir`` (survives executor loss).

    The rows are persisted (memory, spilling to disk) while the checkpoint is
    written, so the plan runs once instead of once for the job and once more
    for the checkpoint writer; the persisted copy is released afterwards."""
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out
