"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "ledgerloom", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a session on ``local`` or ``local[...]``, where driver and executors are one process, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    named = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("spark.checkpoint.dir", named)
    _remove_at_exit(spark, named)
    return named


_SCRATCH: list[list[str]] = []


def stored(spark: SparkSession, path: str) -> str:
    """Note that ``path`` is to go with the scratch it was made in, or else at exit."""
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    _remove_at_exit(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Whatever is built on the result survives the loss of any executor, and the plan behind it runs once. As a result is
    read after its query has returned, the table stays until the surrounding ``scratch`` ends, or the program.
    """
    spark = df.sparkSession
    path = stored(spark, f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever is cut inside is deleted at the end; results must be written or collected by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, so that they need no copy on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))  # the driver serves it; workers fetch it from there
    atexit.register(shutil.rmtree, target.parent, True)
    _SHIPPED.add(app)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def at_exit() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            pass

    atexit.register(at_exit)
