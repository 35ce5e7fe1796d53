"""What a session needs before it runs this package's Python functions on executors."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application, as ``--py-files`` would.

    Spark's own file server hands the archive out, so executors need neither the
    driver's folders nor an installation.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="quirelake-")) / "quirelake.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and read again from the folder that ``spark.checkpoint.dir`` names, with a small plan.

    Only where that is unset on one machine, as in tests, a temporary folder is
    made; on a cluster, whose executors could not read it, that is an error.
    """
    sc = rows.sparkSession.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return rows.checkpoint()
