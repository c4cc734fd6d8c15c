"""Named failures, so callers can tell 'no data yet' from a crash."""


class NoSnapshotError(RuntimeError):
    """A source directory holds no load (no `load_date=` / `snapshot=` folder)."""


class DuplicateKeyError(ValueError):
    """A join side or merge source that must be unique on its key is not."""


class UnknownColumnError(ValueError):
    """A caller named a column (sort key, measure, team column) that does not exist."""
