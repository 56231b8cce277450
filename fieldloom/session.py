"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import site
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan can count on. Partition counts stay with the
# cluster: AQE coalesces and splits what the static setting gets wrong.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # JSON objects keep the last of two equal keys instead of failing the row.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Java compiles no function of over 8,000 bytes; longer stages, such as the reading
    # of responses, are generated operator by operator, in short functions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to Python workers that would not find it by themselves.

    They find it where it is installed, on PYTHONPATH or in the working folder.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    context = spark.sparkContext
    if context.applicationId in _shipped or root in map(os.path.realpath, filter(None, places)):
        return
    name = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="package-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", root, name))
    _shipped.add(context.applicationId)


def apply_settings(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fieldloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Plans here hold thousands of expressions; recording the Python line
        # of each takes longer than building them. A static setting, so other
        # sessions have to be created with it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Rows grow after the shuffle (XML, prompts): small inputs keep all cores.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
    return apply_settings(spark)


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where the session names
    none, ``fallback`` is set, or a temporary folder for a local master only.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if fallback is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        fallback = tempfile.mkdtemp(prefix="spark-checkpoints-")
    context.setCheckpointDir(fallback)
    return fallback


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Writes ``rows`` to the shared checkpoint folder and reads them back.

    For results that several later steps use: they are computed once, and a
    lost executor costs a re-read instead of a recomputation.
    """
    spark = rows.sparkSession
    root = checkpoint_root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return rows.checkpoint(eager=True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session has ended before its tables
        pass


def stored(rows: DataFrame) -> DataFrame:
    """``cut_lineage`` by columns, for narrow rows: steps read the columns they name.

    The table has a measured size, so Spark can send a small one to the large ones.
    It lives in the shared folder until the program ends.
    """
    spark = rows.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
