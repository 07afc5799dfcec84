"""Where the registered queries and the benchmarks put their stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_made: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    A local session without that setting, as in tests, gets a folder that goes when
    the program ends. Any other session must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = tempfile.mkdtemp(prefix="laurel-")
        atexit.register(shutil.rmtree, _made[app], ignore_errors=True)
    return _made[app]
