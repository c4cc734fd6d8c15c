"""Table reads, optional sources and views (SRC6, SRC7, SRC9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..errors import NoSnapshotError

# Tables of the driver's test data (one parquet file each).
DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: `{sf_dir}/{name}.parquet` (SRC6)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def optional_table(loader: Callable[[], DataFrame]) -> DataFrame | None:
    """Run `loader`; a missing path or table gives None, any other error is raised (SRC7)."""
    try:
        return loader()
    except NoSnapshotError:
        return None
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Expose a DataFrame to `spark.sql` (SRC9)."""
    df.createOrReplaceTempView(name)
    return df
