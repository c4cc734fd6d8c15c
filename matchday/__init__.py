"""matchday: a PySpark library for league statistics marts.

Small DataFrame -> DataFrame operators (safe casts, nested flattening,
latest-snapshot selection, keyed upsert, ranking windows, ordered array
aggregates, top-k, fuzzy name resolution) and the plans built from them.
Everything runs on Spark; nothing is collected to the driver except scalars.
"""

__version__ = "0.1.0"
