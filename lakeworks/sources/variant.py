"""JSON lines whose fields drift: typed columns for what is known, everything else kept as it came."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The line as a variant, the fields no column took, and the text of a line that is no JSON object.
DOCUMENT, EXTRA, BAD_LINE = "document", "extra", "bad_line"


def read_variant_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per line: ``document`` (variant), or ``bad_line`` where the line is no JSON object."""
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    parsed = F.try_parse_json("value")
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    return lines.where(F.trim("value") != "").select(
        F.when(is_object, parsed).alias(DOCUMENT),
        F.when(~F.coalesce(is_object, F.lit(False)), F.col("value")).alias(BAD_LINE),
    )


def typed(lines: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """The fields (name -> type) as columns, and ``extra``, a map of variants, with all others.

    A field whose value does not fit its type is null in its column and stands in ``extra``. JSON nulls
    and absent fields are null. ``document`` stays, so a field may be given a type later.
    """
    taken = {}
    for name, kind in fields.items():
        if "'" in name or name in (DOCUMENT, EXTRA, BAD_LINE):
            raise ValueError(f"no name for a field: {name!r}")
        taken[name] = F.try_variant_get(DOCUMENT, f"$['{name}']", kind)
    rest = F.try_variant_get(DOCUMENT, "$", "map<string,variant>")
    unfit = lambda k, v: F.lit(False)
    for name, value in taken.items():
        unfit = _or_unfit(unfit, name, value)
    known = list(fields)
    extra = F.map_filter(rest, lambda k, v: ~k.isin(known) | unfit(k, v))
    return lines.select(*[c.alias(n) for n, c in taken.items()], extra.alias(EXTRA), DOCUMENT, BAD_LINE)


def _or_unfit(others, name, value):
    return lambda k, v: others(k, v) | ((k == name) & value.isNull() & ~F.is_variant_null(v))
