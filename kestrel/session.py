"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "kestrel") -> SparkSession:
    """Build (or reuse) a session with the settings this library assumes.

    AQE stays on so that joins against fitted tables are broadcast only after the
    runtime size check, skewed shuffle partitions are split, and small partitions
    are coalesced.  The UI is off: nothing here opens a web server.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("KESTREL_SHUFFLE_PARTITIONS", cpus))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KESTREL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.ansi.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory named by the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that setting is
    always used when present.  Only when it is unset *and* the master is local
    (tests, local benchmarks) a scratch folder is created for this process.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative operators need a shared "
            "checkpoint folder on a cluster")
    path = tempfile.mkdtemp(prefix="kestrel-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) in the session's checkpoint dir."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unbounded(df: DataFrame) -> DataFrame:
    """A join side that grows with the data: merged after a shuffle, never broadcast.  Spark guesses
    the size of a derived side from its files before it runs; compressed columns, explodes and
    checkpoints make that guess far too small, and the driver would have to hold the side."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (Parquet) of a scale-factor directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kestrel`` importable in the Python workers of a local session
    (pandas UDF / mapInPandas / applyInPandas functions live in it): zip the
    package once per application and distribute it with ``addPyFile``."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED or not sc.master.startswith("local"):
        # on a cluster the package is deployed with the job (--py-files or an
        # installed wheel); only local sessions get it shipped from here
        return
    import kestrel
    root = os.path.dirname(os.path.dirname(os.path.abspath(kestrel.__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="kestrel-pkg-"), "kestrel.zip")
    with zipfile.ZipFile(out, "w") as zf:
        for dirpath, _, files in os.walk(os.path.join(root, "kestrel")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
