import uuid
import zlib
from collections import Counter, defaultdict

import pytest

from corvane.llm import sharding as S


def table(spark, n=2000):
    data = [(i, ("word " * (i * 7919 % 400))) for i in range(n)] + [(None, None), (None, ""), (7, "same"), (7, "same"), (n, "long " * 3000)]
    return spark.createDataFrame(data, "doc_id long, text string"), data


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_bytes_are_near_equal_and_positions_gapless(spark, shards):
    df, data = table(spark)
    got = S.shard(df.selectExpr("*", "1 size", "2 as slot", "3 as SHARD"), shards, slots=512).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((repr(d), len(t or "") + 8, zlib.crc32((t or "").encode())) for d, t in data)
    own = defaultdict(list)
    load = Counter()
    for r in got:
        own[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert set(own) == set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in own.values())
    assert max(load.values()) - min(load.values()) <= max(r.size for r in got)


def test_same_rows_same_shards(spark):
    df, _ = table(spark)
    a, b = ({(r.doc_id, r.size, r.shard) for r in S.shard(x, 6, slots=256).collect()} for x in (df, df.repartition(9)))
    assert a == b


def test_map_versions_and_growth(spark, tmp_path):
    df, _ = table(spark)
    path = f"file://{tmp_path}/map"
    S.save_map(S.first_map(spark, 4, 128), path)
    S.shard(df, 4, slots=128, map_path=path).collect()
    sizes = S.slot_bytes(S.part_bytes(S.slotted(stored(df, tmp_path), 128)), 128)
    of = lambda v=None: {r.vslot: r.shard for r in S.load_map(spark, path, v).collect()}
    one, two = of(1), of()
    assert len(one) == len(two) == 128 and sum(one[s] == two[s] for s in one) > 64
    S.save_map(S.grow(S.load_map(spark, path), sizes, 4), path)
    three = of()
    moved = {s for s in two if two[s] != three[s]}
    assert moved and all(three[s] == 4 for s in moved)
    weight = {r.vslot: r.bytes for r in sizes.collect()}
    load = Counter()
    for s, k in three.items():
        load[k] += weight[s]
    assert load[4] > 0.7 * sum(weight.values()) / 5
    assert [r[0] for r in spark.read.parquet(path).select("version").distinct().orderBy("version").collect()] == [1, 2, 3]


def stored(df, folder):
    path = f"file://{folder}/records-{uuid.uuid4().hex}"
    S.records(df).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_slots_do_not_hang_on_partitions(spark, tmp_path):
    df, _ = table(spark, 100)
    a, b = (sorted(map(tuple, S.slotted(stored(x, tmp_path)).collect()), key=repr) for x in (df, df.repartition(5)))
    assert a == b


def skewed(spark):
    """Half of the rows repeat one row, a quarter has neither id nor text."""
    data = [(i, "text " * (i % 50)) for i in range(1000)] + [(7, "the same row again and again")] * 2000 + [(None, None)] * 1000
    return spark.createDataFrame(data, "doc_id long, text string").repartition(7), data


def test_repeated_rows_spread(spark):
    df, data = skewed(spark)
    got = S.shard(df, 24).collect()
    load, own = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        own[r.shard].append(r.slot)
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(d), len(t or "") + 8) for d, t in data)
    assert set(load) == set(range(24)) and max(load.values()) - min(load.values()) <= max(r.size for r in got)
    assert all(sorted(v) == list(range(len(v))) for v in own.values())
    assert len({r.vslot for r in got if r.doc_id == 7}) > 1500


def brute_shards(weight, slots, shards):
    """vslot: shard after the first edit of the map that deals slots round."""
    total = sum(weight.values())
    own = defaultdict(list)
    for s in range(slots):
        own[s % shards].append(s)
    where, load, pool = {}, [0] * shards, []
    for k in range(shards):
        upto = 0
        for s in sorted(own[k], key=lambda s: (-weight.get(s, 0), s)):
            upto += weight.get(s, 0)
            if upto <= total / shards:
                where[s] = k
                load[k] += weight.get(s, 0)
            else:
                pool.append(s)
    for s in sorted(pool, key=lambda s: (-weight.get(s, 0), s)):
        k = load.index(min(load))
        where[s] = k
        load[k] += weight.get(s, 0)
    return where


@pytest.mark.parametrize("make", [table, skewed])
def test_equals_placing_by_hand(spark, make):
    df, _ = make(spark)
    got = S.shard(df, 5, slots=64).collect()
    weight = Counter()
    for r in got:
        weight[r.vslot] += r.size
    where = brute_shards(weight, 64, 5)
    assert all(r.shard == where[r.vslot] for r in got)


def test_a_version_that_is_written_twice_is_there_once(spark, tmp_path):
    df, data = table(spark, 300)
    path = f"file://{tmp_path}/map"
    first = S.first_map(spark, 4, 128)
    S.save_map(first, path)
    one = S.shard(df, 4, slots=128, map_path=path)
    sizes = S.slot_bytes(S.part_bytes(S.slotted(stored(df, tmp_path), 128)), 128)
    S.save_map(S.rebalance(first, sizes, 4), path)  # another run, from version 1 too
    assert S.load_map(spark, path).count() == 128 and one.count() == len(data)
    assert S.shard(df, 4, slots=128, map_path=path).count() == len(data)


def test_empty(spark):
    df, _ = table(spark, 10)
    assert S.shard(df.limit(0), 3, slots=16).collect() == []


def test_no_python_in_the_plan(spark):
    df, _ = table(spark, 10)
    plan = S.shard(df, 3, slots=16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
