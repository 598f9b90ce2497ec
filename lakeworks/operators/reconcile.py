"""Do two tables hold the same rows?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeworks.functions.hashing import row_hash
from lakeworks.sources.scratch import new_folder

#: Ranges of key hashes that a range is cut into, as a power of two, and how often.
RANGE_BITS = 12
RANGE_LEVELS = 2


def reconcile(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row counts and content checksums of both sides, and whether they agree.

    The checksum does not depend on row order: the xor of all row hashes, and their sum. The
    xor alone would not see a pair of equal rows too many; the sum does. Both sides run in
    one job that shuffles one row per task. Columns of different types are compared in their
    common type: an int equals the same long.
    """
    columns = list(columns or source.columns)
    flag = "_is_source"
    # The union brings both sides to common types before they are hashed.
    both = _side(source, target, columns, True).unionAll(_side(target, source, columns, False))
    sides = both.select(row_hash(columns).alias("h"), F.col(flag).alias("is_source"))
    h, is_source = F.col("h"), F.col("is_source")
    src, dst = F.when(is_source, h), F.when(~is_source, h)
    wide = "decimal(38,0)"
    return (
        sides.agg(
            F.count_if(is_source).alias("source_count"),
            F.count_if(~is_source).alias("target_count"),
            F.bit_xor(src).alias("source_xor"),
            F.bit_xor(dst).alias("target_xor"),
            F.sum(src.cast(wide)).alias("source_sum"),
            F.sum(dst.cast(wide)).alias("target_sum"),
        )
        .withColumn("counts_match", F.col("source_count") == F.col("target_count"))
        .withColumn(
            "checksum_match",
            F.col("source_xor").eqNullSafe(F.col("target_xor"))
            & F.col("source_sum").eqNullSafe(F.col("target_sum")),
        )
        .select(
            "source_count",
            "target_count",
            "counts_match",
            "checksum_match",
            (F.col("counts_match") & F.col("checksum_match")).alias("passed"),
            _message().alias("message"),
        )
    )


def locate_differences(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
    bits: int = RANGE_BITS,
    levels: int = RANGE_LEVELS,
) -> DataFrame:
    """The keys under which two tables differ: ``missing`` in the target, ``extra`` there, or ``changed``.

    The hashes of the keys are cut into 2^``bits`` ranges, and both tables give one hash of all their
    rows for each range. Ranges that agree are done with; those that do not are cut again, ``levels``
    times. Only the rows of the last ranges that differ are brought together by key. Equal
    tables so cost one pass and a shuffle of at most 2^``bits`` rows a task; a hot key is one row a
    task as well. Rows may repeat and keys may be null; the order of rows does not matter.
    """
    columns = list(columns or source.columns)
    flag = "_is_source"
    both = _side(source, target, columns, True).unionAll(_side(target, source, columns, False))
    sides = both.select(*keys, F.col(flag), row_hash(columns).alias("_row"), row_hash(keys).alias("_key"))
    rows = sides
    for level in range(1, levels + 1):
        place = F.shiftrightunsigned("_key", 64 - bits * level)
        ranges = _differing(rows.withColumn("_range", place), ["_range"])
        path = new_folder(source.sparkSession, f"ranges-{level}")
        ranges.select("_range").write.parquet(path)
        differing = source.sparkSession.read.schema("_range long").parquet(path)
        rows = sides.withColumn("_range", place).join(differing, "_range", "left_semi").drop("_range")
        if differing.isEmpty():
            break
    status = F.when(F.col("target_count") == 0, "missing").when(F.col("source_count") == 0, "extra").otherwise("changed")
    return _differing(rows, keys).select(*keys, status.alias("status"), "source_count", "target_count")


def _differing(sides: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups whose rows on both sides are not the same, whatever their order."""
    is_source, row = F.col("_is_source"), F.col("_row")
    src, dst, wide = F.when(is_source, row), F.when(~is_source, row), "decimal(38,0)"
    return (
        sides.groupBy(*by)
        .agg(
            F.count_if(is_source).alias("source_count"),
            F.count_if(~is_source).alias("target_count"),
            F.bit_xor(src).alias("_source_xor"),
            F.bit_xor(dst).alias("_target_xor"),
            F.sum(src.cast(wide)).alias("_source_sum"),
            F.sum(dst.cast(wide)).alias("_target_sum"),
        )
        .where(
            (F.col("source_count") != F.col("target_count"))
            | ~F.col("_source_xor").eqNullSafe(F.col("_target_xor"))
            | ~F.col("_source_sum").eqNullSafe(F.col("_target_sum"))
        )
    )


def reconcile_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts only; on Parquet this reads file footers."""
    one = F.lit(1).alias("is_source"), F.lit(0).alias("is_source")
    sides = source.select(one[0]).unionAll(target.select(one[1]))
    return (
        sides.agg(
            F.count_if(F.col("is_source") == 1).alias("source_count"),
            F.count_if(F.col("is_source") == 0).alias("target_count"),
        )
        .withColumn("passed", F.col("source_count") == F.col("target_count"))
        .withColumn("counts_match", F.col("passed"))
        .select("source_count", "target_count", "passed", _message().alias("message"))
    )


def _message():
    different = F.format_string("mismatch source=%d target=%d", F.col("source_count"), F.col("target_count"))
    return F.when(F.col("counts_match"), F.lit("row counts match")).otherwise(different)


def _side(df: DataFrame, other: DataFrame, columns: Sequence[str], is_source: bool) -> DataFrame:
    """The columns, as text where the other side has text: text need not be a number or a date."""
    as_text = [
        F.col(c).cast("string").alias(c)
        if "string" in (df.schema[c].dataType.simpleString(), other.schema[c].dataType.simpleString())
        else F.col(c)
        for c in columns
    ]
    return df.select(*as_text, F.lit(is_source).alias("_is_source"))
