"""Values out of texts of JSON, with what is wrong with those that hold none. Driver-contract scope: the reference reads no JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, text: str, fields: Mapping[str, tuple[str, str]], required: tuple[str, ...] | None = None, reason: str = "reason") -> DataFrame:
    """``rows`` with a column for each of ``fields`` (name to (path, type)), and ``reason``: null where all ``required`` fields (all of
    them by default) are there, else the first that is wrong.

    Each text is parsed once, to a variant that all paths are read from. Reasons: ``missing`` for a null text; ``malformed`` for one that is
    no JSON, an empty one too; ``no <path>``; ``<path> is null``; ``<path> is no <type>`` where the value can't be taken as one. A row
    is never dropped, whatever its text holds.
    """
    x = rows.withColumn("_value", F.try_parse_json(text))
    value = F.col("_value")
    wrong = F.when(F.col(text).isNull(), F.lit("missing")).when(value.isNull(), F.lit("malformed"))
    for name in fields if required is None else required:
        path, kind = fields[name]
        at = F.try_variant_get(value, path, "variant")
        wrong = wrong.when(at.isNull(), F.lit(f"no {path}")).when(F.is_variant_null(at), F.lit(f"{path} is null"))
        wrong = wrong.when(F.try_variant_get(value, path, kind).isNull(), F.lit(f"{path} is no {kind}"))
    return x.select(*rows.columns, *[field(value, *at).alias(name) for name, at in fields.items()], wrong.alias(reason))


def field(value: Column, path: str, kind: str) -> Column:
    """What a variant has at a path, as a type; null where it has nothing that can be one."""
    return F.try_variant_get(value, path, kind)
