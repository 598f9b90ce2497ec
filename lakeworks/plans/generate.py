"""Synthetic JSON lines of a wanted size."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeworks.operators.synth import synthetic_transactions
from lakeworks.sources.files import file_inventory

GB = 1024**3
#: Lines that are written first, to learn how long lines are.
FIRST_ROWS = 100


def generate_json_lines(
    spark: SparkSession,
    output_dir: str,
    target_bytes: int,
    file_bytes: int = 128 * 1024**2,
    make: Callable[[DataFrame], DataFrame] = synthetic_transactions,
) -> dict:
    """Write at least ``target_bytes`` of JSON lines, and a manifest of what was written.

    ``make`` turns keys 0, 1, 2 ... into rows, from fixed domains or (``learned_transactions``) from
    what was learned of a table. No file gets much larger than ``file_bytes``. The first hundred
    lines, as written, tell how many more are needed; if these fall short, the next keys fill up the
    rest. The manifest lies in ``_manifest``, where readers of the directory do not see it.
    """
    rows, size, mode = 0, 0, "errorifexists"
    while size < target_bytes or not rows:
        mean = size / rows if rows else 0
        more = max(1, math.ceil((target_bytes - size) / mean)) if rows else FIRST_ROWS
        parts = max(1, math.ceil(more * mean / file_bytes))
        made = make(spark.range(rows, rows + more, numPartitions=parts))
        made.write.mode(mode).option("maxRecordsPerFile", math.ceil(file_bytes / mean) if mean else 0).json(output_dir)
        rows, mode = rows + more, "append"
        listing = file_inventory(spark, {"out": output_dir})
        size, files = listing.agg(F.sum("length"), F.count(F.lit(1))).first()
    manifest = {
        "target_gb": target_bytes / GB,
        "actual_gb": round(size / GB, 4),
        "total_rows": rows,
        "files": files,
        "output_dir": output_dir,
        "metadata": make(spark.range(0)).schema.jsonValue(),
    }
    text = spark.createDataFrame([(json.dumps(manifest),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{output_dir}/_manifest")
    return manifest
