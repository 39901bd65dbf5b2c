"""Session settings and the shipping of this package to executors."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.legacy.timeParserPolicy": "CORRECTED",
    # Java's own charset names, so that files in windows-1252 can be read.
    "spark.sql.legacy.javaCharsets": "true",
}


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a given session and ship the package, once a context."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, as ``spark.checkpoint.dir`` names it.

    Only where that is unset, as in local tests, a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = Path(tempfile.mkdtemp(prefix="tabulon-")) / "tabulon.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
