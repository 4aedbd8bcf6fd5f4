"""Session helpers shared by every operator: tables, scratch tables, checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings nodes edges insights "
    "index_summaries track_b_python memory_entries source_files run_files run_records third_party_files "
    "mix_targets reading_labels"
).split()


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("weftgraph")
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    own = tempfile.mkdtemp(prefix="weftgraph-ship-")  # of the driver alone; Spark serves the file from there
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    with zipfile.ZipFile(f"{own}/weftgraph.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(f"{own}/weftgraph.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; column pruning and filters reach its Parquet scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where no folder is configured and the session runs on one machine, as in tests, a temporary one is made and set;
    on a cluster each executor would see another folder, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="weftgraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = "file://" + own
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at


_cleaned: set[str] = set()


def _application(spark: SparkSession) -> str:
    """The name of this application's scratch folder, which is removed when the driver ends; tables may be read until then."""
    name = spark.sparkContext.applicationId
    if name not in _cleaned:
        _cleaned.add(name)
        at, jvm, conf = f"{shared_dir(spark).rstrip('/')}/weft-{name}", spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def remove() -> None:
            try:
                p = jvm.org.apache.hadoop.fs.Path(at)
                p.getFileSystem(conf).delete(p, True)
            except Exception:  # the session was ended before the driver: its folder goes with its retention
                pass

        atexit.register(remove)
    return name


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage with a compressed Parquet table in the shared folder and read it back.

    It survives the loss of executors, is column-pruned by later reads and is smaller than an RDD checkpoint.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/weft-{_application(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(at) if partition_by else df.write.option(
        "compression", "zstd"
    ).parquet(at)
    return spark.read.schema(df.schema).parquet(at)
