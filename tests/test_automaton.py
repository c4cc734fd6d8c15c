import random

import pytest

from matchday.operators import automaton, resolve

from .conftest import plan_text


def brute(names, choices):
    out = {}
    for n in names:
        hits = [(p, c) for c, p in choices if n and c and (n in c or c in n)]
        if hits:
            out[n] = min(hits)[::-1]
    return out


def frame(spark, names, choices, kind="long"):
    rows = [(n, 0, None) for n in names] + [(c, 1, p) for c, p in choices]
    return spark.createDataFrame(rows, f"s string, side int, position {kind}")


@pytest.mark.parametrize("block", [400_000, 60])
def test_first_containing_equals_brute_force(spark, block):
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abé 日") for _ in range(rng.randint(1, 6)))
    names = sorted({word() for _ in range(60)} | {"a", "é"})
    choices = [(c, p) for p, c in enumerate(rng.sample(sorted({word() for _ in range(80)} | {"a", "zz"}), 40))]
    got = {r.name: (r.choice, r.position) for r in automaton.first_containing(frame(spark, names, choices).repartition(3), block).collect()}
    assert got == brute(names, choices)


def test_positions_of_files_and_empty_sides(spark):
    choices = [("ab", ("f2", 0)), ("abc", ("f1", 7)), ("b", ("f1", 9))]
    df = frame(spark, ["abcd", "q"], choices, "struct<file: string, at: int>")
    assert [tuple(r) for r in automaton.first_containing(df).collect()] == [("abcd", "abc", ("f1", 7))]
    assert automaton.first_containing(df.filter("side = 0")).collect() == []
    assert automaton.first_containing(df.limit(0)).collect() == []


def test_a_name_in_every_choice_costs_one_row_per_task():
    choices = [(f"name {i}", 1, i) for i in range(500)]
    assert automaton.first_matches([("n", 0, None)], choices) == {"n": ((0,), "name 0", 0)}


def test_rule_one_explodes_no_grams(spark):
    names = spark.createDataFrame([("ramos",)], "name string")
    choices = spark.createDataFrame([("ayo ramos", 0)], "choice string, position long")
    out = resolve.resolve_keys(names, choices, cutoff=None)
    assert "Generate explode(filter" not in plan_text(out) and "FlatMapCoGroupsInArrow" in plan_text(out)
    assert [tuple(r) for r in out.collect()] == [("ramos", "ayo ramos", "contains", None)]


def test_long_strings_short_names_and_hot_buckets_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    long = [word(rng.randint(33, 70)) for _ in range(30)]
    names = sorted({"a", "b", "abc", *(x[rng.randint(0, 5):rng.randint(28, 60)] for x in long[:20]), *long[:3], *(word(5) for _ in range(40))})
    choices = [(c, p) for p, c in enumerate(rng.sample(sorted({*long, *(word(rng.randint(1, 40)) for _ in range(60)), *("x" * 40 + w for w in long)}), 100))]
    for block in (50, 700):
        got = {r.name: (r.choice, r.position) for r in automaton.first_containing(frame(spark, names, choices), block).collect()}
        assert got == brute(names, choices)


def test_what_is_dealt_grows_with_the_strings(spark):
    """Four times the strings in blocks of the same size: four times the rows, not sixteen."""
    def rows(n):
        df = frame(spark, [f"team {i:09d}" for i in range(n)], [(f"team {i:09d}", i) for i in range(0, n, 2)])
        return automaton.dealt(df, n // 50)[1].count()
    assert 0 < rows(800) <= 4 * rows(200)
    df = frame(spark, [f"team {i:09d}" for i in range(800)], [(f"team {i:09d}", i) for i in range(0, 800, 2)])
    assert automaton.first_containing(df, 700).count() == 400
