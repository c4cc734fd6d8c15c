"""Nested access and column housekeeping (PRJ1, PRJ4, PRJ5, PRJ13-PRJ15, SC19, SC20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnknownColumnError


def explode_records(df: DataFrame, array_col: str, alias: str, keep: Sequence[str | Column] = (),
                    keep_empty: bool = False) -> DataFrame:
    """One row per array element (PRJ1). `keep_empty` keeps parents with an empty/null array."""
    gen = F.explode_outer if keep_empty else F.explode
    return df.select(*keep, gen(F.col(array_col)).alias(alias))


def explode_positions(df: DataFrame, array_col: Column | str, keep: Sequence[str | Column] = (),
                      pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per element with its 0-based position (SC19)."""
    c = F.col(array_col) if isinstance(array_col, str) else array_col
    return df.select(*keep, F.posexplode(c).alias(pos, value))


def cell(arr, i: int) -> Column:
    """Element i (0-based) of an array, null when the array is short (PRJ4)."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.get(c, i)


def expand_struct(df: DataFrame, struct_col: str, known: Sequence[str] | None = None,
                  rest_alias: str | None = None) -> DataFrame:
    """`select(struct.*)` (PRJ5). With `known`, missing fields become null
    columns so the output schema is fixed even when a page adds or drops a field."""
    st = df.schema[struct_col].dataType
    others = [c for c in df.columns if c != struct_col]
    if known is None:
        return df.select(*others, f"{struct_col}.*")
    present = set(st.fieldNames())
    cols = [F.col(f"`{struct_col}`.`{k}`").alias(k) if k in present else F.lit(None).cast("string").alias(k)
            for k in known]
    out = df.select(*others, *cols)
    if rest_alias:
        extra = [k for k in st.fieldNames() if k not in set(known)]
        rest = (F.create_map(*[x for k in extra for x in (F.lit(k), F.col(f"`{struct_col}`.`{k}`").cast("string"))])
                if extra else F.create_map().cast(T.MapType(T.StringType(), T.StringType())))
        out = df.select(*others, *cols, rest.alias(rest_alias))
    return out


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop every column whose name contains `pattern` (PRJ13)."""
    return df.drop(*[c for c in df.columns if pattern in c])


def find_column(df: DataFrame, needle: str) -> str:
    """First column whose name contains `needle`, case-insensitive; raise if none (PRJ14)."""
    for c in df.columns:
        if needle.lower() in c.lower():
            return c
    raise UnknownColumnError(f"no column containing {needle!r} in {df.columns}")


def suffix_collisions(left: DataFrame, right: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    """Rename right-side columns that collide with left ones, pandas-style (PRJ15).
    Names are compared without case, as Spark does."""
    taken, own = {c.lower() for c in left.columns}, {k.lower() for k in keys}
    return right.toDF(*(c + suffix if c.lower() in taken - own else c for c in right.columns))


def parse_json_text(c, schema: T.DataType | str) -> Column:
    """JSON text -> struct (SC20)."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, schema)


def to_json_text(c, ignore_nulls: bool = True) -> Column:
    """struct -> JSON text; null fields dropped by default (SC20, SNK6)."""
    return F.to_json(F.col(c) if isinstance(c, str) else c,
                     {"ignoreNullFields": "true" if ignore_nulls else "false"})
