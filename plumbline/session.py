"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Applications of this process whose workers were sent the package.
_SHIPPED: set[str] = set()


def build_session(app_name: str = "plumbline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution on. Pass extra settings as keyword
    arguments with ``__`` for the dots (``spark__ui__enabled="false"``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package's modules to the workers, which import it by name wherever
    they were started. Once an application; for sessions not made by ``build_session`` too.
    A package that was itself read from an archive is left to whoever sent that."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId not in _SHIPPED and root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="plumbline-package-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as packed:
            for module in sorted(root.rglob("*.py")):
                packed.write(module, module.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder reliable checkpoints go to.

    On a cluster it is the shared one named by ``spark.checkpoint.dir``. Only a
    local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    context.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder: computed once, read by every
    later use, and still there when an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def durable_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Like ``durable``, as a compressed Parquet table in the checkpoint folder: for wide
    rows, or for uses that read only some of the columns."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
