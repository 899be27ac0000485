"""Duplicate removal, the Bloom-style bit map and dense ids against sequential loops."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions.hashing import SEEDS, bit_positions
from linkloom.operators.dedup import (
    BIT_MASK,
    bloom_dedup,
    bloom_fill,
    dedup_links,
    drop_seen,
    extend_frontier,
    power_of_two_mask,
)
from linkloom.operators.ids import assign_ids
from linkloom.sources import bitmap


def _units(text):
    raw = text.encode("utf-16-be")
    return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]


def _sequential_bloom(rows, mask):
    bits, flagged = set(), {}
    for seq, url in sorted(rows):
        duplicate = True
        for seed in SEEDS:
            h = 0
            for unit in _units(url):
                h = (h * seed + unit) & 0xFFFFFFFF
            if h & mask not in bits:
                duplicate = False
                bits.add(h & mask)
        flagged[seq] = duplicate
    return flagged


URLS = ["http://x/%d" % (i * i % 400) for i in range(600)] + ["", "é", "𝄞/𝄞", "𝄞/𝄞", "ü" * 50, ""]


@pytest.mark.parametrize("mask", [power_of_two_mask(1 << 27), BIT_MASK, power_of_two_mask(64), 0])
def test_bloom_equals_sequential_run(spark, mask):
    rows = list(enumerate(URLS))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, url string").repartition(4)
    got = {r.seq: r.is_duplicate for r in bloom_dedup(df, mask=mask).collect()}
    assert got == _sequential_bloom(rows, mask)
    seen = set()
    for seq, url in sorted(rows):
        assert got[seq] or url not in seen  # an exact repeat is always flagged
        seen.add(url)


@pytest.mark.parametrize("mask", [power_of_two_mask(1 << 27), BIT_MASK, power_of_two_mask(64), 0])
def test_stored_map_equals_one_run(spark, tmp_path, mask):
    rows, path = list(enumerate(URLS)), str(tmp_path / "map")
    bitmap.create_bit_table(spark, path, mask=mask)
    bitmap.create_bit_table(spark, path, mask=mask)
    with pytest.raises(ValueError, match="another size"):
        bitmap.create_bit_table(spark, path, mask=1)
    assert bitmap.bit_table_fill(spark, path).first().bits_set == 0
    got = {}
    for batch, begin in ((0, 0), (1, 150), (1, 150), (2, 400), (0, 0), (3, 700)):  # some are replayed
        own = rows[begin : {0: 150, 150: 400}.get(begin, 700)]
        df = spark.createDataFrame(own, "seq long, url string").repartition(3)
        got |= {r.seq: r.is_duplicate for r in bitmap.bit_table_dedup(df, path, batch).collect()}
    assert got == _sequential_bloom(rows, mask)
    fill = bloom_fill(spark.createDataFrame(rows, "seq long, url string"), mask=mask).first()
    assert bitmap.bit_table_fill(spark, path).first() == fill


def test_stored_map_stays_where_it_is(spark, tmp_path):
    path = str(tmp_path / "map")
    bitmap.create_bit_table(spark, path, mask=(1 << 29) - 1)
    df = spark.createDataFrame(list(enumerate(URLS)), "seq long, url string")
    bitmap.bit_table_dedup(df, path, 0)
    with bitmap._bitmaps(spark, path, 4) as table:
        bits = spark.createDataFrame([(5, 1, 4)], "bit long, bucket long, place long").repartition(2)
        plan = bitmap.known_bits(spark.table(table).drop("batch"), bits)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
    join = next(i for i, line in enumerate(lines) if "ShuffledHashJoin" in line)
    assert "Bucketed: true" in lines[scan]
    assert not any("Exchange" in line for line in lines[join:scan])


def test_bloom_default_size_and_errors(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "seq long, url string")
    assert {r.seq: r.is_duplicate for r in bloom_dedup(df).collect()} == {1: False, 2: True, 3: False}
    with pytest.raises(ValueError):
        bloom_dedup(df, num_bits=100)


def test_null_urls_have_no_bits(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "seq long, url string")
    positions = df.select("seq", bit_positions(F.col("url"), 255).alias("b")).orderBy("seq").collect()
    assert [r.b for r in positions] == [None, [97] * len(SEEDS), None]


def test_dedup_links_keeps_first(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, 2**40, 2**62]), rng.randrange(2**31), "u%d" % rng.randrange(50)) for _ in range(2000)]
    rows += [(rng.randrange(1000), 0, "hot") for _ in range(2000)]
    want = {}
    for src, pos, url in rows:
        want[url] = min(want.get(url, (src, pos)), (src, pos))
    df = spark.createDataFrame(rows, "src_id long, pos int, url string").repartition(4)
    assert {r.url: (r.src_id, r.pos) for r in dedup_links(df).collect()} == want


def test_urls_are_compared_exactly(spark):
    rows = [(1, 0, "http://x/a"), (1, 1, "http://x/a#f"), (1, 2, "http://x/a?"), (1, 3, "http://X/a"), (1, 4, "http://x/a")]
    df = spark.createDataFrame(rows, "src_id long, pos int, url string")
    assert sorted(r.pos for r in dedup_links(df).collect()) == [0, 1, 2, 3]


def test_drop_seen_and_extend(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, url string")
    b = spark.createDataFrame([("b", 3)], "url string, id long")
    assert [r.url for r in drop_seen(a, b).collect()] == ["a"]
    assert [(r.id, r.url) for r in extend_frontier(a, b).orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "b")]


def test_ids_are_dense_and_in_order(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.lit("x").alias("v"))
    got = assign_ids(df.repartition(6), ["k"], start=10).orderBy("k").collect()
    assert [r.id for r in got] == list(range(11, 20_011))
    assert got[0].asDict().keys() == {"id", "k", "v"}
    assert assign_ids(df.limit(0), ["k"]).count() == 0


def test_ids_with_one_hot_leading_key(spark):
    df = spark.range(9000).select(F.when(F.col("id") < 6000, 5).otherwise(F.col("id") % 10).alias("p"), "id")
    got = assign_ids(df.withColumnRenamed("id", "pos"), ["p", "pos"]).orderBy("p", "pos").collect()
    assert [r.id for r in got] == list(range(1, 9001))


def test_bloom_map_is_sized_for_what_is_expected(spark):
    from linkloom.operators.dedup import bloom_bits, bloom_fill

    assert bloom_bits(100_000_000, 0.01) == 1 << 30
    assert bloom_bits(1, 0.5) == 2
    df = spark.range(2000).selectExpr("id as seq", "concat('http://x/', id) as url")
    got = bloom_fill(df, expected=2000, fpp=0.01).first()
    assert 0.2 < got.fill < 0.6 and got.bits_set == round(got.fill * bloom_bits(2000, 0.01))
    flagged = bloom_dedup(df, expected=2000, fpp=0.01).filter("is_duplicate").count()
    assert flagged < 100
