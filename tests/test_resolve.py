import difflib
import random
import string

import pytest
from pyspark.sql import functions as F

from matchday.errors import DuplicateKeyError
from matchday.operators import resolve
from matchday.plans.enrich import enrich_players, enrich_teams


def ratio(a, b):
    """The published ratio of two words, from the standard library."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def check(name, got, choices):
    """Whether an outcome obeys the rules, checked property by property instead of by a second resolver."""
    resolved, rule = got
    touching = [i for i, c in enumerate(choices) if name and c and (name in c or c in name)]
    best = max((ratio(c, name) for c in choices if c), default=0)
    if touching:
        return got == (choices[touching[0]], "contains")
    if name and best >= 0.7:
        return rule == "ratio" and ratio(resolved, name) == best
    return got == (name, "none")


def _run(spark, names, choices):
    ndf = spark.createDataFrame([(n,) for n in names], "name string")
    cdf = spark.createDataFrame([(c, i) for i, c in enumerate(choices)], "choice string, position long")
    return {r.name: (r.resolved, r.rule) for r in resolve.resolve_keys(ndf, cdf).collect()}


def test_rules_on_fixture(spark):
    choices = ["ayo ramos", "ramos", "benn oduya", "brighton and hove albion", "harbour city", "northside fc"]
    names = ["ramos", "ayo ramos jr", "ben oduya", "brighton", "harbour", "alesund rovers", "", "northside"]
    got = _run(spark, names, choices)
    # by hand
    assert got == {"ramos": ("ayo ramos", "contains"), "ayo ramos jr": ("ayo ramos", "contains"),
                   "ben oduya": ("benn oduya", "ratio"), "brighton": ("brighton and hove albion", "contains"),
                   "harbour": ("harbour city", "contains"), "alesund rovers": ("alesund rovers", "none"), "": ("", "none"),
                   "northside": ("northside fc", "contains")}
    # a name contained in two choices takes the first in file order
    assert got["ramos"] == ("ayo ramos", "contains")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    alphabet = "abcde "

    def word(lo, hi):
        return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(lo, hi))).strip()

    choices = list(dict.fromkeys(word(3, 12) for _ in range(40)))
    names = list(dict.fromkeys([word(1, 12) for _ in range(60)] +
                               [c[:-1] + "x" for c in choices[:10] if len(c) > 3]))
    got = _run(spark, names, choices)
    for n in names:
        assert check(n, got[n], choices), (n, got[n])


def test_no_cross_product_in_plan(spark):
    from .conftest import plan_text
    ndf = spark.createDataFrame([("ramos",)], "name string")
    cdf = spark.createDataFrame([("ayo ramos", 0)], "choice string, position long")
    plan = plan_text(resolve.resolve_keys(ndf, cdf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_enrich_one_row_per_left_row(spark):
    players = spark.createDataFrame([("Ayo Ràmos", 7), ("Ben Oduya", 0), ("Nobody Here", 1), (None, 2)],
                                    "player_name string, total_goals long")
    profiles = spark.createDataFrame([("Ayo Ramos", "Northside", "FW"), ("Benn Oduya", "Northside", "DF"),
                                      ("Ayo Ramos", "Elsewhere", "MF")], "name string, club string, position string")
    out = enrich_players(players, profiles).collect()
    assert len(out) == 4
    by = {r.player_name: r for r in out}
    assert by["Ayo Ràmos"].club == "Northside" and by["Ben Oduya"].club == "Northside"
    assert by["Nobody Here"].club is None
    assert not any("join" in c or c.startswith("_") for c in enrich_players(players, profiles).columns)
    with pytest.raises(DuplicateKeyError):
        enrich_players(players, profiles, on_duplicate="raise").collect()


def test_enrich_teams_suffix(spark):
    summary = spark.createDataFrame([(1, "Brighton", "x")], "rank int, team_name string, badge_url string")
    badges = spark.createDataFrame([("Brighton and Hove Albion", "b.png")], "team string, badge_url string")
    out = enrich_teams(summary, badges)
    assert "badge_url_badge" in out.columns
    assert out.first()["badge_url_badge"] == "b.png"


