import random
import zlib

import pytest

from matchday.llm import sharding


def brute(sizes, capacity):
    left, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, b) for b, r in enumerate(left) if r >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            left.append(max(capacity, sizes[i]))
            b = len(left) - 1
        left[b] -= sizes[i]
        out[i] = b
    return [out[i] for i in range(len(sizes))]


def test_best_fit_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 80))]
        assert sharding.best_fit_decreasing(sizes, 70) == brute(sizes, 70)


def test_tree_stays_balanced():
    t = sharding.CapacityTree()
    for i in range(1000):
        t.insert((i, 0))
    assert t.root.height <= 14
    for i in range(0, 1000, 2):
        t.remove((i, 0))
    assert t.tightest(500) == (501, 0) and t.tightest(1000) is None and t.root.height <= 13


def check(rows, docs, shards, whole=True):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, groups, load = {}, {}, [0] * shards
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if whole:
        assert all(len(g) == 1 for g in groups.values())
    return load


def test_shards_are_even_and_groups_whole(spark):
    rng = random.Random(1)
    docs = [(i, "x" * rng.randint(0, 400) + str(rng.randint(0, 900))) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for items in (1 << 14, 64):
        load = check(sharding.shard(df, items=items).collect(), docs, 16)
        assert max(load) - min(load) < (0.03 if items > 64 else 0.5) * max(load)


def test_hot_group_is_split(spark):
    docs = [(i, "copy " * 20) for i in range(1000)] + [(2000 + i, f"text {i} " * 5) for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    load = check(sharding.shard(df).collect(), docs, 16, whole=False)
    assert max(load) - min(load) < 0.05 * max(load)


def test_edges_and_clashing_names(spark):
    docs = [(1, None), (2, ""), (None, "a"), (4, "a"), (4, "a"), (5, "é" * 3000)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, shard string, h1 int")
    check(sharding.shard(df).collect(), docs, 16)
    assert sharding.shard(df.limit(0)).count() == 0
    assert {r.shard for r in sharding.shard(df, capacity=4).collect()} >= {0, 1}


@pytest.mark.parametrize("capacity", [500, 3000, 200_000])
def test_no_shard_exceeds_its_capacity(spark, capacity):
    rng = random.Random(2)
    docs = ([(i, "y" * rng.randint(0, 450) + str(i % 700)) for i in range(2000)] + [(5000 + i, "copies " * 9) for i in range(900)]
            + [(7, "same id") for _ in range(300)] + [(None, None)] * 400)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = sharding.shard(df, capacity=capacity).collect()
    shards = max(r.shard for r in rows) + 1
    load = check(rows, docs, shards, whole=False)
    assert min(load) > 0 and max(load) <= capacity
    assert shards <= 1.12 * sum(load) / capacity + 1
    bytes_of, places = {}, {}
    for r in rows:
        key = (r.size, r.text_crc32)
        bytes_of[key] = bytes_of.get(key, 0) + r.size
        places.setdefault(key, set()).add(r.shard)
    assert all(len(places[k]) == 1 for k, n in bytes_of.items() if n <= capacity)


def test_ranges_and_strings_of_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE", 4)
    monkeypatch.setattr(sharding, "WINDOW_ROWS", 100)
    docs = [(i, f"{i} " + "z" * (i % 90)) for i in range(1500)] + [(i, "hot text") for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sharding.shard(df, capacity=2000).collect()
    shards = max(r.shard for r in rows) + 1
    load = check(rows, docs, shards, whole=False)
    assert max(load) <= 2000 and shards <= 1.4 * sum(load) / 2000


def test_a_row_above_the_capacity_is_alone(spark):
    docs = [(1, "a" * 100), (2, "a" * 100), (3, ""), (4, "b")]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), capacity=10).collect()
    by = {r.doc_id: r.shard for r in rows}
    assert by[1] != by[2] and by[3] == by[4] not in (by[1], by[2])
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), capacity=10).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), capacity=0)


def test_op9(spark):
    rows = sharding.op9_sharding(spark, "/root/testdata/sf0.01").collect()
    load = [0] * 16
    for r in rows:
        load[r.shard] += r.size
    assert len(rows) == 1000 and max(load) - min(load) < 0.01 * max(load)
