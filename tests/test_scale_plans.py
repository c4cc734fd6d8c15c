"""Shuffle counts of key plans as they would run on big tables (broadcasts off)."""

import os
import re

import pytest

import __spark_entry__ as entry

from .conftest import plan_text

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture
def no_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _hash_keys(name, spark):
    top = plan_text(entry.queries()[name](spark, SF))
    return re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", top)


def test_lineitem_shuffled_twice_in_opponent_lookup(no_broadcast):
    keys = _hash_keys("opponent_lookup", no_broadcast)
    assert sum(k.startswith("l_") for k in keys) == 2  # by order key, then by supplier key


def test_upsert_is_one_keyed_pass(no_broadcast):
    # target de-dup, source de-dup, one merge pass: three exchanges
    assert len(_hash_keys("upsert_latest", no_broadcast)) == 3


def test_scoring_mart_shuffles(no_broadcast):
    # join both sides on the order key, then the partial aggregate's exchange
    assert len(_hash_keys("player_scoring_stats", no_broadcast)) == 3


def test_summary_joins_are_co_partitioned(no_broadcast):
    from matchday.operators import joins
    from matchday.plans import testbed as tb
    spark = no_broadcast
    st = tb.standings(spark, SF)
    form = tb.q_team_form_last5(spark, SF)
    nxt = tb.q_next_fixture(spark, SF).drop("next_date")
    joined = joins.left_enrich(joins.left_enrich(st, form, ["team_key"]), nxt, ["team_key"])
    keys = re.findall(r"Arguments: hashpartitioning\(([^)]*)\)", plan_text(joined))
    # customers, standings aggregate, form window, next-fixture window: the joins add none
    assert len(keys) == 4 and all(k.startswith("team_key") for k in keys)
