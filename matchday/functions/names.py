"""Name normalisation and string similarity (SC5, FZ3).

Spark has no Unicode decomposition and no Ratcliff/Obershelp ratio. The first is
one Arrow kernel over whole batches, the second a batched UDF over Python's
standard library whose callers prune candidates natively first (see
`operators.resolve`).
"""

from __future__ import annotations

import difflib
import sys

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .casts import _col

def ship_by_value(module: str) -> None:
    """Pickle the module's functions by value, so that executors need no copy of the package for them."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship_by_value(__name__)


@F.pandas_udf(T.StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    """Compatibility decomposition of a whole batch, in Arrow."""
    return pc.utf8_normalize(pa.Array.from_pandas(s, type=pa.string()), form="NFKD").to_pandas()


# White space that may stand around a name: Unicode's, and the separators \x1c-\x1f.
_AROUND = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def is_ascii(c) -> Column:
    return _col(c).rlike(r"^[\x00-\x7f]*$")


def clean_name(c) -> Column:
    """Join key for names: `  Martin Ødegaard ` -> `martin degaard` (SC5, FZ1).

    Case folding and trimming are Spark's own functions; only text that is not
    ASCII goes on to the decomposition, whose non-ASCII rest is dropped. Null
    gives the empty key.
    """
    x = F.coalesce(_col(c), F.lit(""))
    folded = F.regexp_replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), _AROUND, "")
    other = F.when(~is_ascii(folded), folded)        # null where there is nothing to decompose
    return F.when(is_ascii(folded), folded).otherwise(F.regexp_replace(_decomposed(other), r"[^\x00-\x7f]", ""))


def clean_names(df: DataFrame, src: str, alias: str) -> DataFrame:
    """Add `alias = clean_name(src)`, in one pass.

    The one-element `explode` keeps the planner from copying the kernel into a
    filter that it derives from a join on `alias`, where it can't run.
    """
    kept = [c for c in df.columns if c.lower() != alias.lower()]
    return df.select(*(f"`{c}`" for c in kept), F.explode(F.array(clean_name(src))).alias(alias))


def similarity_py(choice: str, name: str) -> float:
    """Ratcliff/Obershelp ratio as `difflib.get_close_matches` scores it:
    sequence a is the candidate, sequence b the word being matched."""
    return difflib.SequenceMatcher(None, choice, name).ratio()


@F.pandas_udf(T.DoubleType())
def _similarity_udf(choice: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([similarity_py(a, b) for a, b in zip(choice, name)], dtype="float64")


def similarity(choice, name) -> Column:
    return _similarity_udf(_col(choice), _col(name))
