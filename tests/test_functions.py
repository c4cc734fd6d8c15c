import datetime as dt

from pyspark.sql import functions as F

from matchday.functions import casts, metrics, text
from matchday.functions.names import clean_name, clean_names


def test_safe_casts(spark):
    df = spark.createDataFrame([("7",), (" 7 ",), ("",), ("60.74",), ("abc",), ("12.0",), (None,), ("-3",)], "s string")
    rows = df.select("s", casts.to_int("s").alias("i"), casts.to_double("s").alias("d"),
                     casts.to_int_truncated("s").alias("t")).collect()
    got = {r.s: (r.i, r.d, r.t) for r in rows}
    assert got["7"] == (7, 7.0, 7)
    assert got[" 7 "][0] == 7
    assert got[""] == (None, None, None)
    assert got["60.74"] == (None, 60.74, 60)
    assert got["abc"] == (None, None, None)
    assert got["12.0"] == (None, 12.0, 12)
    assert got[None] == (None, None, None)
    assert got["-3"] == (-3, -3.0, -3)


def test_cast_guard_agrees_with_try_cast(spark):
    vals = ["1", "+1", "-0", "  42\t", "1e3", "0x10", "1_000", "NaN", "inf", "-Infinity", "٣", "１２", "9" * 12, ". 5", "5."]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    rows = df.select("s", casts.to_int("s").alias("a"), F.col("s").try_cast("int").alias("b"),
                     casts.to_double("s").alias("c"), F.col("s").try_cast("double").alias("d")).collect()
    for r in rows:
        assert r.a == r.b, r.s
        assert (r.c == r.d) or (r.c != r.c and r.d != r.d), r.s


def test_dates_parse_and_sort_chronologically(spark):
    df = spark.createDataFrame([("Sep 29, 2025",), ("Mar 1, 2026",), ("May 10, 2026",), ("May 3, 2026",),
                                ("Feb 9, 2026",), ("bad",), ("",)], "s string")
    out = [r.d for r in df.select(casts.parse_match_date("s").alias("d")).orderBy("d").collect()]
    assert out[:2] == [None, None]
    assert out[2:] == [dt.date(2025, 9, 29), dt.date(2026, 2, 9), dt.date(2026, 3, 1), dt.date(2026, 5, 3),
                       dt.date(2026, 5, 10)]
    ts = spark.createDataFrame([("2026-03-21 09:00:00",), ("x",)], "s string").select(
        casts.parse_timestamp("s").alias("t")).collect()
    assert ts[0].t == dt.datetime(2026, 3, 21, 9, 0) and ts[1].t is None


def test_text_functions(spark):
    df = spark.createDataFrame([("Ayden Heaven", "0.54-0.12", "-0.12", "a\nb", "Apr 11, 2026", "img/40x40/x.png")],
                               "n string, v string, sup string, nl string, d string, u string")
    r = df.select(text.file_key("n").alias("k"), text.strip_suffix("v", "sup").alias("v"), text.drop_newlines("nl").alias("nl"),
                  text.code3("n").alias("c"), text.initials("n").alias("i"), text.first_part("d").alias("d"),
                  text.image_url_large("u").alias("u"),
                  text.contains_either(F.lit("ring"), F.lit("small ring")).alias("ce")).first()
    assert (r.k, r.v, r.nl, r.c, r.i, r.d, r.u, r.ce) == ("ayden_heaven", "0.54", "ab", "AYD", "AH", "Apr 11",
                                                          "img/250x250/x.png", True)
    assert text.slug_to_name("Bukayo-Saka") == "bukayo saka"
    vals = spark.createDataFrame([("-0.54", None), ("12+3", "+3"), ("1.20 -0.35", "-0.35"), ("7", ""), ("2-1", None),
                                  ("2025-09", ""), ("2-1", "-3"), (None, "-1"), ("55", "5")], "v string, s string")
    assert [r.v for r in vals.select(text.strip_suffix("v", "s").alias("v")).collect()] == [
        "-0.54", "12", "1.20", "7", "2-1", "2025-09", "2-1", None, "5"]


def test_metrics(spark):
    df = spark.createDataFrame([(3, 0, 20, 1, 20, 5.0, None, "h", "")], "g int, m int, xg int, r int, n int, d double, x string, s string, e string")
    r = df.select(metrics.per90("g", "m").alias("p"), metrics.capped_percent("xg").alias("c"),
                  metrics.zone("r", "n").alias("z"), metrics.outcome("g", "m").alias("o"),
                  metrics.sign_flag("d").alias("f"), metrics.side_label("s").alias("sl"),
                  metrics.first_present("x", "e", default="Unknown Club").alias("fp")).first()
    assert r.p == 270.0 and r.c == 100.0 and r.z == "top" and r.o == "W" and r.f == "over" and r.sl == "HOME"
    assert r.fp == "Unknown Club"
    flags = spark.createDataFrame([(0.0,), (-1.0,), (None,), (0.01,)], "d double").select(
        metrics.sign_flag("d").alias("f")).collect()
    assert [f.f for f in flags] == ["under", "under", "under", "over"]
    zones = spark.range(1, 21).select(metrics.zone("id", F.lit(20)).alias("z")).collect()
    assert [z.z for z in zones].count("top") == 4 and [z.z for z in zones].count("bottom") == 3
    fixed = spark.range(1, 25).select(metrics.zone("id").alias("z")).collect()
    assert [z.z for z in fixed].count("bottom") == 7  # ranks 18..24


def test_clean_name(spark):
    # written by hand from the rule: fold case, trim, decompose, drop what isn't ASCII
    want = {"  Martin Ødegaard ": "martin degaard", "Straße": "strasse", "Ayo Ràmos": "ayo ramos", "": "", None: "",
            "JOÃO": "joao", "plain ascii": "plain ascii", "\tTabbed\n": "tabbed", "\u00a0Ñandú \u2003": "nandu",
            "ﬁne Ⅳ": "fine iv", "東京 fc": " fc", "İlkay": "ilkay", "GROẞ": "gross", "\x1cx\x1f": "x"}
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: r.k for r in df.select("n", clean_name("n").alias("k")).collect()} == want
    assert {r.n: r.k for r in clean_names(df, "n", "k").collect()} == want


def test_both_date_formats(spark):
    df = spark.createDataFrame([("2025-09-29",), ("Sep 29, 2025",), ("2025-13-01",), ("Sept 29",), ("",)], "s string")
    got = [r.d for r in df.select(casts.parse_match_date("s").alias("d")).collect()]
    assert got == [dt.date(2025, 9, 29), dt.date(2025, 9, 29), None, None, None]
