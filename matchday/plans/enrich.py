"""Name-resolved enrichment (Q-ENR, FZ6): players + profiles, team summary + badges.

Left rows are kept exactly once. Names are cleaned (case fold, NFKD, ASCII),
resolved against the other side's names (containment in file order, then the
similarity ratio, else unchanged) and left-joined; helper columns are dropped
and colliding column names get a suffix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_names
from ..operators.groups import connected_groups
from ..operators.nested import find_column
from ..operators.resolve import RATIO_CUTOFF, enrich, resolve_keys
from ..session import materialize
from ..sources.documents import POSITION

PLAYER_SUFFIX = "_add"
BADGE_SUFFIX = "_badge"


def enrich_players(players: DataFrame, profiles: DataFrame, on_duplicate: str = "first",
                   cutoff: float | None = RATIO_CUTOFF) -> DataFrame:
    """Players mart + external profiles (`name`, `club`, `position`, ...); `cutoff=None` leaves out the ratio rule."""
    return enrich(players, "player_name", profiles, "name", PLAYER_SUFFIX, unique=on_duplicate, cutoff=cutoff)


def enrich_teams(summary: DataFrame, badges: DataFrame, on_duplicate: str = "first",
                 cutoff: float | None = RATIO_CUTOFF) -> DataFrame:
    """Team summary + badges; the team column of each side is discovered by name (PRJ14)."""
    left_col = find_column(summary, "team")
    right_col = find_column(badges, "team")
    return enrich(summary, left_col, badges, right_col, BADGE_SUFFIX, unique=on_duplicate, cutoff=cutoff)


def alias_table(names: DataFrame, name_col: str, canonical: DataFrame, canonical_col: str,
                position_col: str = POSITION, cutoff: float | None = RATIO_CUTOFF) -> DataFrame:
    """(name, canonical) for every distinct name, resolved against the canonical
    list in its order (Q7). Names that resolve to nothing keep their spelling."""
    canon = clean_names(canonical.withColumnRenamed(canonical_col, "_canon"), "_canon", "choice")
    place = F.col(f"`{position_col}`") if position_col in canon.columns else F.monotonically_increasing_id()
    first = materialize(canon.select("choice", "_canon", place.alias("position"))
                        .groupBy("choice").agg(F.min(F.struct("position", "_canon")).alias("f"))
                        .select("choice", F.col("f._canon").alias("canonical"), F.col("f.position").alias("position")))
    raw = names.select(F.col(name_col).alias("name_raw")).distinct()
    raw = clean_names(raw, "name_raw", "name")
    keys = resolve_keys(raw.select("name"), first.select("choice", "position"), cutoff)
    return (raw.join(keys, "name")
            .join(first.select(F.col("choice").alias("resolved"), "canonical"), "resolved", "left")
            .select(F.col("name_raw").alias("name"),
                    F.when(F.col("rule") == "none", F.col("name_raw"))
                    .otherwise(F.col("canonical")).alias("canonical")))


def alias_groups(links: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """(name, canonical) from pairs `links(a, b)` of spellings of one thing (Q7).

    Pairs may come from several sources and form chains; everything connected is
    one group. Its canonical spelling is the one that comes first in
    `preferred(name, file_position)`, else the least spelling of the group.
    """
    groups = connected_groups(links)
    if preferred is None:
        return groups.select("name", F.col("group").alias("canonical"))
    place = preferred.select("name", F.col(POSITION).alias("at")).groupBy("name").agg(F.min("at").alias("at"))
    first = (groups.join(place, "name").groupBy("group").agg(F.min(F.struct("at", "name")).alias("f"))
             .select("group", F.col("f.name").alias("best")))
    return groups.join(first, "group", "left").select("name", F.coalesce("best", "group").alias("canonical"))


def conform(df: DataFrame, cols: Sequence[str], aliases: DataFrame) -> DataFrame:
    """The name columns `cols` in their canonical spelling; `aliases(name, canonical)` has each name once.
    A name without an alias stays as it is."""
    out = df
    for c in cols:
        a = aliases.select(F.col("name").alias("_alias"), F.col("canonical").alias("_canonical"))
        out = (out.join(a, F.col(f"`{c}`") == F.col("_alias"), "left")
               .withColumn(c, F.coalesce("_canonical", F.col(f"`{c}`"))).drop("_alias", "_canonical"))
    return out.select(*(f"`{c}`" for c in df.columns))


def conform_names(df: DataFrame, cols: Sequence[str], canonical: DataFrame, canonical_col: str) -> DataFrame:
    """Rewrite the team-name columns `cols` to the spelling of the canonical list (Q7)."""
    names = None
    for c in cols:
        part = df.select(F.col(c).alias("_n")).filter(F.col("_n").isNotNull())
        names = part if names is None else names.unionByName(part)
    return conform(df, cols, alias_table(names, "_n", canonical, canonical_col))
