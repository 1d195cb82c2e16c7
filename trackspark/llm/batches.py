"""Arrow batches of texts with little memory."""

from __future__ import annotations

import ctypes
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch; texts are long, and Spark's default would make batches of tens of megabytes on either side.
ROWS = 1000
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


_models: dict[str, object] = {}


def loaded(kind, text: str):
    """One instance per Python worker, kept from task to task."""
    key = f"{kind.__name__}-{hashlib.sha256(text.encode()).hexdigest()}"
    if key not in _models:
        _models[key] = kind(text)
    return _models[key]


def trim() -> None:
    """Give free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def free() -> None:
    """Let models of other operators go and give free memory back to the system."""
    if _models:
        _models.clear()
        trim()


def map_arrow(df: DataFrame, run, schema, models: bool = False) -> DataFrame:
    """``mapInArrow`` in batches of at most ``ROWS`` rows (a setting of the session); a task's end frees what it held.

    Workers serve many operators, so tasks that use no :func:`loaded` model drop those of earlier ones.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(SETTING)) <= ROWS:
        conf.set(SETTING, str(ROWS))

    def task(batches):
        if not models:
            free()
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)
