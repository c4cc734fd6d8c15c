"""Fixed schemas of the bronze documents and the silver / gold tables.

Bronze leaves are all text (a missing number is `""`); types are applied in
silver. Field names below are the source's page headers: fixed values that
must match the documents.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()


def _text_struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, S, True) for n in names])


# The stamp added to every bronze document.
META = _text_struct("extraction_timestamp", "load_date", "source")

# Page headers of the player tables.
SEASON_FIELDS = ("№", "Season", "Team", "Apps", "Min", "G", "A", "Sh90", "KP90", "xG", "xA", "xG90", "xA90")
MATCH_FIELDS = ("№", "Date", "Home", "Score", "Away", "Pos", "Min", "Sh", "G", "KP", "A", "xG", "xA")
# Keys of the team documents.
RESULT_FIELDS = ("date", "opponent", "side", "result", "team_score", "opponent_score", "team_xg",
                 "opponent_xg", "match_link")
FIXTURE_FIELDS = ("date", "time", "opponent", "side")
STAT_FIELDS = ("№", "Situation", "Sh", "G", "ShA", "GA", "xG", "xGA", "xGD", "xG/Sh", "xGA/Sh")
ROSTER_FIELDS = ("Player", "Player_URL")

LEAGUE_DOC = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("Team", S), T.StructField("URL", S), T.StructField("Data", T.ArrayType(S))]))),
    T.StructField("_metadata", META),
])

PLAYER_DOC = T.StructType([
    T.StructField("player_name", S),
    T.StructField("player_url", S),
    T.StructField("seasonal_performance", T.ArrayType(_text_struct(*SEASON_FIELDS))),
    T.StructField("match_performance", T.ArrayType(_text_struct(*MATCH_FIELDS))),
    T.StructField("_metadata", META),
])

TEAM_DOC = T.StructType([
    T.StructField("team_name", S),
    T.StructField("url", S),
    T.StructField("results", T.ArrayType(_text_struct(*RESULT_FIELDS))),
    T.StructField("fixtures", T.ArrayType(_text_struct(*FIXTURE_FIELDS))),
    # a map, so that fields a page adds are read too
    T.StructField("statistics", T.ArrayType(T.MapType(S, S))),
    T.StructField("roster", T.ArrayType(_text_struct(*ROSTER_FIELDS))),
    T.StructField("_metadata", META),
])

BADGES = T.StructType([T.StructField("team", S), T.StructField("badge_url", S)])

PROFILES = T.StructType([
    T.StructField("name", S), T.StructField("club", S), T.StructField("position", S),
    T.StructField("nationality", S), T.StructField("image_url", S),
])

# Pairs of spellings of one name; the canonical ones in order of preference.
ALIASES = _text_struct("name", "canonical")

# Merge keys of the silver tables.
KEYS = {
    "quarantine": ("part", "source_file", "document"),
    "league_standings": ("team_name",),
    "team_matches": ("team_name", "match_date", "opponent"),
    "team_statistics": ("team_name", "load_date", "Situation"),
    "team_fixtures": ("team_name", "fixture_date", "opponent"),
    "player_seasons": ("player_name", "season_year", "team_name"),
    "player_matches": ("player_name", "match_date"),
}
