"""One key with most or all rows: draws, numbering and joins deal it out and give the same rows."""

import pytest
from pyspark.sql import functions as F

from fillsight import fixtures as X
from fillsight.operators import dataset as D, history as H, scan as SC
from fillsight.plans.behavior import Behavior
from fillsight.schema import MARKET
from tests.conftest import rows


@pytest.fixture
def small_tasks(spark, monkeypatch):
    """Joins without broadcasts, partitions as they are dealt, and keys that are heavy from 40 rows on."""
    monkeypatch.setattr(SC, "JOIN_ROWS", 40)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot(spark, n=3_000):
    """A group with nearly all rows, whose hashes share long prefixes, and small ones."""
    h = F.when(F.col("id") % 3 > 0, F.lit(5 << 40) + F.col("id") % 700).otherwise(F.xxhash64("id").bitwiseAND(2**60 - 1))
    return spark.range(n).select(F.when(F.col("id") < n - 20, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("g"), "id", h.alias("_h"))


@pytest.mark.parametrize("max_rows", [10, 400, 2_000_000])
def test_first_rows_of_a_group_by_hash(spark, small_tasks, max_rows):
    d = SC.materialize(hot(spark))
    want = spark.createDataFrame([("big", 1_234), ("g0", 2), ("g1", 0), ("g2", 99)], "g string, _want bigint")
    got = SC.mark_first(d, ["g"], want, ["id"], max_rows=max_rows)
    expect = {}
    for g, k in (("big", 1_234), ("g0", 2), ("g1", 0), ("g2", 99)):
        every = sorted((r["_h"], r.id) for r in d.collect() if r.g == g)
        expect |= {i: n < k for n, (_, i) in enumerate(every)}
    assert {r.id: r["_first"] for r in got.collect()} == expect and got.columns == [*d.columns, "_first"]


def test_numbering_spans_ranges(spark):
    d = spark.range(1_000).select((F.col("id") % 10).alias("k"), "id")
    got = [(r.k, r.id) for r in SC.numbered(d.repartition(7), [F.col("k").desc(), F.col("id")]).orderBy("_rn").collect()]
    assert got == sorted(((i % 10, i) for i in range(1_000)), key=lambda x: (-x[0], x[1]))
    assert SC.numbered(d.limit(0), [F.col("id")]).collect() == []


def test_heavy_keys_are_bounded(spark, small_tasks, monkeypatch):
    monkeypatch.setattr(SC, "MANY_KEYS", 3)
    counts = spark.range(1_000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("n"))
    assert SC.heavy_keys(counts, ["k"]) is None
    steep = counts.withColumn("n", F.when(F.col("k") < 2, 400_000 + F.col("k")).otherwise(F.col("n") % 100))
    assert [r.k for r in SC.heavy_keys(steep, ["k"]).orderBy("k").collect()] == [0, 1]
    counts = spark.createDataFrame([(1, 900_000), (2, 50), (3, 10)], "k int, n bigint")
    assert {r.k: r["_salts"] for r in SC.heavy_keys(counts, ["k"]).collect()} == {1: 3}


def test_joins_deal_a_hot_market_out(spark, small_tasks):
    dim = spark.createDataFrame([("big", 1), ("g1", 2), ("none", 3)], "g string, v int")
    got = SC.join_dimension(hot(spark), dim, "g", F.col("id"))
    assert rows(got.select("id", "v")) == rows(hot(spark).join(dim, "g").select("id", "v"))
    dealt = got.select("id", F.spark_partition_id().alias("p"))
    assert dealt.groupBy("p").count().agg(F.max("count")).first()[0] < 2_900


def test_one_market_gives_the_same_features(spark, sf, small_tasks):
    f = X.fills(spark, sf).withColumn(MARKET, F.lit("m1"))
    f = f.withColumns({c: F.when(F.col(c) == "0", "0").otherwise(F.concat(F.lit("m1"), F.substring(c, -2, 2))) for c in ("makerAssetId", "takerAssetId")})
    f, m = SC.materialize(f), SC.materialize(X.markets(spark, sf).filter("slug = 'm1'"))
    hot_, plain = Behavior(f, m), Behavior(f, m)
    plain.__dict__["heavy"] = None
    assert hot_.heavy.count() == 1
    for family in ("holding", "realized", "unrealized", "adaptive", "contrarian"):
        assert rows(hot_.family(family)) == rows(plain.family(family))
    dims = plain.dims
    spikes = rows(H.terminal_spikes(hot_.history, dims))
    SC.JOIN_ROWS = 10**9
    assert spikes == rows(H.terminal_spikes(hot_.history, dims))


def test_draws_do_not_depend_on_the_size_of_groups(spark, small_tasks):
    d = spark.range(2_000).select(F.concat(F.lit("w"), "id").alias("wallet"), F.lit("m").alias(MARKET), (F.col("id") % 9 == 0).cast("int").alias("is_insider"))
    for fn in (lambda n: D.stratified_split(d, max_rows=n), lambda n: D.downsample_market(d, "m", 50, max_rows=n)):
        assert rows(fn(20)) == rows(fn(10**9))
    volumes = d.select("wallet", MARKET, F.lit(10**7).alias("volume_micro"))
    positives = d.filter("is_insider = 1")
    draw = lambda n: rows(D.sample_negatives(volumes, positives, positives, 3, max_rows=n))
    assert draw(20) == draw(10**9) and len(draw(20)) == 3 * positives.count()
