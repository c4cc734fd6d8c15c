"""Bronze -> silver -> gold -> enrich -> serve on invented documents."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchday import schemas
from matchday.errors import NoSnapshotError
from matchday.operators.upsert import read_latest
from matchday.plans import enrich, gold, serve, silver
from matchday.sources.documents import read_documents
from matchday.sources.snapshots import latest_snapshot

from . import fixtures
from .conftest import plan_text


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    bronze = fixtures.write_bronze(root)
    versions = silver.run_silver(spark, bronze, f"{root}/silver")
    gold.run_gold(spark, f"{root}/silver", f"{root}/gold", f"{root}/export", as_of="2026-03-21")
    return {"root": root, "bronze": bronze, "silver": f"{root}/silver", "gold": f"{root}/gold", "versions": versions}


def test_latest_snapshot_prunes_partitions(spark, lake):
    docs = read_documents(spark, f"{lake['bronze']}/players", schemas.PLAYER_DOC)
    latest = latest_snapshot(docs)
    assert {r.load_date for r in latest.select("load_date").collect()} == {dt.date(2026, 3, 21)}
    assert "PartitionFilters: [isnotnull(load_date" in plan_text(latest)
    with pytest.raises(NoSnapshotError):
        latest_snapshot(docs.filter(F.lit(False)))


def test_standings_latest_load_wins(spark, lake):
    st = read_latest(spark, f"{lake['silver']}/league_standings")
    rows = {r.team_name: r for r in st.collect()}
    assert len(rows) == 4
    assert rows["Northside"].points == 23 and rows["Northside"].xG_for == 60.74
    assert rows["Ålesund Rovers"].xG_for is None  # "" -> null
    for r in rows.values():
        assert r.wins + r.draws + r.losses == r.matches_played
        assert 3 * r.wins + r.draws == r.points
    trunc = silver.league_standings(read_documents(spark, f"{lake['bronze']}/league", schemas.LEAGUE_DOC),
                                    truncate_xg=True)
    assert {r.team_name: r.xG_for for r in trunc.collect()}["Northside"] == 60


def test_player_tables(spark, lake):
    seasons = read_latest(spark, f"{lake['silver']}/player_seasons").collect()
    assert len(seasons) == 2 and all(r.season_year for r in seasons)  # blank totals row dropped
    pm = read_latest(spark, f"{lake['silver']}/player_matches")
    keys = [(r.player_name, r.match_date) for r in pm.collect()]
    assert len(keys) == len(set(keys)) == 6  # duplicate (player, date) removed, blank Date dropped
    ben = {r.match_date: r for r in pm.filter(F.col("player_name") == "Ben Oduya").collect()}
    assert ben[dt.date(2026, 1, 10)].minutes_played is None  # "12.5" is not an int
    assert ben[dt.date(2026, 2, 9)].xg is None


def test_rerun_is_idempotent(spark, lake, tmp_path):
    s2 = str(tmp_path / "silver")
    silver.run_silver(spark, lake["bronze"], s2)
    silver.run_silver(spark, lake["bronze"], s2)
    for t in ("league_standings", "team_matches", "team_statistics", "player_seasons", "player_matches"):
        a = read_latest(spark, f"{s2}/{t}").drop("updated_at", "extra")
        b = read_latest(spark, f"{lake['silver']}/{t}").drop("updated_at", "extra")
        assert a.count() == b.count() and a.exceptAll(b).isEmpty(), t


def test_gold_marts(spark, lake):
    g = lake["gold"]
    summary = {r.team_name: r for r in read_latest(spark, f"{g}/team_summary").collect()}
    north = summary["Northside"]
    # chronological, newest first; the null result (Mar 14) is skipped
    assert north.form_array == ["D", "W", "W", "W", "W"]
    assert (north.next_opponent, north.next_home_away) == ("Harbour City", "a")  # May 3 < May 10
    assert north.goal_difference == north.goals_for - north.goals_against
    assert summary["Brighton"].next_opponent is None  # fixtures exist, none for this team
    assert summary["Brighton"].form_array == ["D"]
    players = {r.player_name: r for r in read_latest(spark, f"{g}/player_scoring_stats").collect()}
    assert set(players) == {"Ayo Ràmos", "Ben Oduya"}  # Carl Sub has 0 minutes; May 2025 is pre-season
    assert players["Ayo Ràmos"].total_goals == 3 and players["Ayo Ràmos"].total_xg == 2.2
    assert players["Ayo Ràmos"].xg_performance == 0.8
    assert players["Ben Oduya"].total_xg == 0.05
    recent = read_latest(spark, f"{g}/league_recent_results").orderBy(F.desc("match_date")).collect()
    assert recent[0].match_date == dt.date(2026, 3, 14) or recent[0].match_date == dt.date(2026, 3, 1)
    tactics = read_latest(spark, f"{g}/team_tactics").collect()
    assert {(r.team_name, r.play_type) for r in tactics} >= {("Northside", "Open play"), ("Northside", "Set piece")}
    assert len(tactics) == 4
    upcoming = read_latest(spark, f"{g}/league_upcoming_fixtures").collect()
    assert [(r.home_team, r.fixture_date) for r in upcoming] == [("Harbour City", dt.date(2026, 5, 3)),
                                                                ("Northside", dt.date(2026, 5, 10))]


def test_list_exports_are_json_arrays(lake):
    import glob
    import json
    f = glob.glob(f"{lake['root']}/export/league_upcoming_fixtures/part-*")[0]
    doc = json.loads(open(f, encoding="utf-8").read())
    assert [d["home_team"] for d in doc] == ["Harbour City", "Northside"]


def test_summary_without_fixtures_defaults(spark, lake):
    st = read_latest(spark, f"{lake['silver']}/league_standings")
    m = read_latest(spark, f"{lake['silver']}/team_matches")
    out = gold.team_summary(st, m, None).collect()
    assert {(r.next_opponent, r.next_home_away) for r in out} == {("TBD", "h")}


def test_enrich_and_serve(spark, lake):
    g = lake["gold"]
    players = read_latest(spark, f"{g}/player_scoring_stats")
    profiles = spark.createDataFrame(fixtures.PROFILES, schemas.PROFILES)
    enriched = enrich.enrich_players(players, profiles)
    by = {r.player_name: r for r in enriched.collect()}
    assert by["Ayo Ràmos"].club == "Northside" and by["Ben Oduya"].position == "DF"
    badges = spark.createDataFrame(fixtures.BADGES, schemas.BADGES)
    teams = enrich.enrich_teams(read_latest(spark, f"{g}/team_summary"), badges)
    tb = {r.team_name: r.badge_url for r in teams.collect()}
    assert tb["Brighton"] == "b/brighton.png" and tb["Northside"] == "b/north.png"
    assert tb["Ålesund Rovers"] == "b/alesund.png"

    assert serve.for_team(read_latest(spark, f"{g}/team_summary"), "NORTHSIDE").count() == 1
    assert serve.for_team(read_latest(spark, f"{g}/team_summary"), "nobody").isEmpty()
    assert serve.default_row(read_latest(spark, f"{g}/team_summary")).first().team_name == "Northside"
    assert serve.player_profile(enriched, "ayo-ràmos").first().player_name == "Ayo Ràmos"
    lead = serve.leaders(enriched, "total_goals").collect()
    assert [r.position for r in lead] == list(range(1, len(lead) + 1))
    squad = serve.squad(enriched, "northside", "XGP", "desc").collect()
    assert [r.player_name for r in squad][0] == "Ayo Ràmos"
    assert serve.is_member(enriched, "Northside", "Ben Oduya")
    assert {r.player_name for r in serve.team_players(enriched, "NORTHSIDE").collect()} == {"Ayo Ràmos", "Ben Oduya"}
    seasons = read_latest(spark, f"{lake['silver']}/player_seasons")
    assert seasons.filter("shots_per_90 = 180.0").count() == 1  # kept as scraped (Q8)
    assert serve.season_rates(seasons, min_minutes=90).filter("shots_per_90 = 180.0").isEmpty()
    pm = read_latest(spark, f"{lake['silver']}/player_matches")
    assert gold.player_scoring_stats(pm, min_minutes=100).count() == 1
    assert serve.top_scorer(enriched).first().top_scorer == "Ayo Ràmos"
    metrics = serve.player_metrics(enriched).filter(F.col("player_name") == "Ayo Ràmos").first()
    assert metrics.goals_pct == pytest.approx(20.0)
    sim = serve.similar_players(enriched, "Ayo Ràmos").collect()
    assert [r.player_name for r in sim] == ["Ben Oduya"]
    trends = read_latest(spark, f"{g}/team_match_trends")
    last3 = serve.last_matches(trends, "Northside").collect()
    assert [r.match_date for r in last3] == [dt.date(2026, 1, 10), dt.date(2026, 2, 9), dt.date(2026, 3, 1)]
    series = serve.trend_series(trends, "Northside").collect()
    assert series[0].date_label == "May 3" and series[0].side == "AWAY"
    table = serve.league_table(read_latest(spark, f"{g}/team_summary"), badges).collect()
    assert {r.team_name: r.zone for r in table}["Northside"] == "top"
    tp = serve.tactics_performance(read_latest(spark, f"{g}/team_tactics")).collect()
    assert all(r.flag == ("over" if (r.performance or 0) > 0 else "under") for r in tp)


def test_cli_runs_silver_and_gold(spark, tmp_path, capsys):
    from matchday.__main__ import main
    root = str(tmp_path / "lake")
    fixtures.write_bronze(root, two_loads=False)
    main(["silver", "--root", root])
    main(["gold", "--root", root, "--as-of", "2026-03-21"])
    out = capsys.readouterr().out
    assert '"team_matches": 0' in out and '"team_summary": 0' in out
    assert read_latest(spark, f"{root}/gold/team_summary").count() == 4


def test_cluster_conf_sizes_partitions():
    from matchday.session import cluster_conf
    conf = cluster_conf(100 << 40, executors=1000, cores_per_executor=8)
    n = int(conf["spark.sql.shuffle.partitions"])
    assert n % 8000 == 0 and n * (256 << 20) >= (100 << 40)


def test_conform_names_once_in_silver(spark, lake):
    matches = read_latest(spark, f"{lake['silver']}/team_matches")
    badges = spark.createDataFrame(fixtures.BADGES, schemas.BADGES)
    out = enrich.conform_names(matches, ["team_name", "opponent"], badges, "team")
    names = {r.team_name for r in out.collect()} | {r.opponent for r in out.collect()}
    assert "Brighton and Hove Albion" in names and "Brighton" not in names
    assert "Northside FC" in names and "Alesund Rovers" in names
    assert out.count() == matches.count()


def test_ordered_marts_keep_their_order(spark, lake):
    ranks = [r["rank"] for r in read_latest(spark, f"{lake['gold']}/team_summary").collect()]
    assert ranks == sorted(ranks)
    goals = [r.total_goals for r in read_latest(spark, f"{lake['gold']}/player_scoring_stats").collect()]
    assert goals == sorted(goals, reverse=True)


def test_parts_run_independently(spark, tmp_path):
    root = str(tmp_path / "lake")
    b = fixtures.write_bronze(root, two_loads=False)
    out = silver.run_silver(spark, b, f"{root}/silver", parts=("league", "players"))
    assert set(out) == {"league_standings", "player_seasons", "player_matches"}
    g = gold.run_gold(spark, f"{root}/silver", f"{root}/gold", marts=("player_scoring_stats",))
    assert set(g) == {"player_scoring_stats"}
    with pytest.raises(NoSnapshotError):
        gold.run_gold(spark, f"{root}/silver", f"{root}/gold", marts=("team_tactics",))
