"""Safe casts for text that looks like numbers (PRJ6-PRJ9, SC11).

Spark 4 runs with ANSI on: `cast('' as int)` and `cast('60.74' as int)` throw.
Every source leaf is text, with `""` for a missing number, so casts here are
`try_cast`: bad text becomes null instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats of the source pages: team pages write `Sep 29, 2025`,
# player match tables `2025-09-29`.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
MATCH_DATE_FORMAT = "MMM d, yyyy"
ISO_DATE_FORMAT = "yyyy-MM-dd"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Shapes that a string must have for Spark's cast to accept it. Text that does
# not match can only give null, so it skips `try_cast`, whose failure path
# throws and catches one exception per row (`""` is the commonest value).
_WS = r"[\s\p{Cntrl}\p{Z}]*"
INT_SHAPE = f"^{_WS}[+-]?[0-9]+{_WS}$"
NUMBER_HINT = r"(?i)[0-9]|nan|inf"


def to_int(c) -> Column:
    """Integer text -> int; `""`, decimals and junk -> null (PRJ6)."""
    x = _col(c)
    return F.when(x.rlike(INT_SHAPE), x.try_cast("int"))


def to_double(c) -> Column:
    """Numeric text -> double; `""` and junk -> null (PRJ7)."""
    x = _col(c)
    return F.when(x.rlike(NUMBER_HINT), x.try_cast("double"))


def to_int_truncated(c) -> Column:
    """Decimal text -> int by truncation, `"60.74"` -> 60 (PRJ8)."""
    return to_double(c).try_cast("int")


def parse_timestamp(c, fmt: str = TIMESTAMP_FORMAT) -> Column:
    """`yyyy-MM-dd HH:mm:ss` text -> timestamp, bad text -> null (PRJ9)."""
    x = _col(c)
    # day and year fields need digits: text without any cannot parse
    return F.when(x.rlike("[0-9]"), F.try_to_timestamp(x, F.lit(fmt)))


def parse_match_date(c, fmt: str | None = None) -> Column:
    """`Sep 29, 2025` or `2025-09-29` -> date, so dates sort chronologically, not
    as text (SC11, Q1). With `fmt`, only that format is accepted."""
    x = _col(c)
    if fmt:
        return F.when(x.rlike("[0-9]"), F.try_to_date(x, fmt))
    # each format is tried only on text of its shape (no parse-failure path)
    return (F.when(x.rlike(r"^\s*[0-9]{4}-"), F.try_to_date(x, ISO_DATE_FORMAT))
            .when(x.rlike("[A-Za-z]") & x.rlike("[0-9]"), F.try_to_date(x, MATCH_DATE_FORMAT)))


def format_match_date(c, fmt: str = MATCH_DATE_FORMAT) -> Column:
    """date -> `Sep 29, 2025` (the page format)."""
    return F.date_format(_col(c), fmt)
