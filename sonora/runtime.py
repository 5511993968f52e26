"""What jobs need of the cluster: the package on the executors, and a folder that all share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows go to Python and back in Arrow batches of about so many bytes. Spark's own bound is 64 MB, which an executor holds
#: several times over for each of its tasks, and its Python worker once more.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, as its functions are pickled by name; bounds the session's Arrow batches unless it names a bound."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_sonora_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sonora-")) / "sonora_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent).as_posix())
    sc.addPyFile(str(archive))
    sc._sonora_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where none is named and Spark runs on this machine alone, as in tests."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if top is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir: a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(top)
    return top


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
