"""Ingest, index of landed ids, views and merges on small inputs."""

from pyspark.sql import functions as F

from fillsight import fixtures as X
from fillsight.schema import FILLS, MARKET
from fillsight.streaming import identity as I, ingest as S, runs as R
from tests.conftest import rows


def all_fills(spark, sf):
    return X.fills(spark, sf).select(*[F.col(x.name).cast(x.dataType) for x in FILLS])


def land(spark, part, path):
    part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    S.ingest_fills(S.fill_stream(spark, f"{path}/in"), f"{path}/out", f"{path}/ck").awaitTermination()


def test_null_markets_and_ids_are_ingested_once(spark, sf, tmp_path):
    f = all_fills(spark, sf).limit(60)
    k = F.pmod(F.xxhash64("id"), F.lit(4))
    f = f.withColumn(MARKET, F.when(k == 0, F.lit(None)).when(k == 1, "007").when(k == 2, "2024-01-05").otherwise(""))
    f = f.withColumn("id", F.when(F.col("id") != "e7", F.col("id")))
    f.coalesce(1).write.parquet(f"{tmp_path}/once")
    f = spark.read.schema(FILLS).parquet(f"{tmp_path}/once")
    for part in (f, f.limit(20), f.unionByName(f)):
        land(spark, part, str(tmp_path))
    out = S.ingested(spark, f"{tmp_path}/out")
    assert dict(out.dtypes)[MARKET] == "string" and rows(out) == rows(f)


def test_merges_change_no_result_and_survive_a_retry(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "LIMIT", 3)
    monkeypatch.setattr(R.Runs.due, "__defaults__", (3,))
    monkeypatch.setattr(I, "FILE_IDS", 40)
    f = all_fills(spark, sf)
    view = S.hourly_view(X.markets(spark, sf))
    for i in range(8):
        land(spark, f.filter((F.pmod(F.xxhash64("id"), F.lit(8)) == i) | (F.pmod(F.xxhash64("id"), F.lit(20)) == 0)), str(tmp_path))
        S.track(S.ingested_stream(spark, f"{tmp_path}/out"), view, f"{tmp_path}/vol", f"{tmp_path}/ck-vol").awaitTermination()
    table = R.Runs(spark, f"{tmp_path}/out/fills")
    assert len(table.runs()) < 8 and any(r.first != r.last for r in table.runs())
    assert len(R.Runs(spark, f"{tmp_path}/vol").runs()) < 8
    out = S.ingested(spark, f"{tmp_path}/out")
    assert rows(out) == rows(f)
    assert rows(S.tracked(spark, view, f"{tmp_path}/vol")) == rows(view.add_up(view.rows(f)))
    # a stream that comes late still finds every batch; what all have read may go
    S.track(S.ingested_stream(spark, f"{tmp_path}/out"), view, f"{tmp_path}/late", f"{tmp_path}/ck-late").awaitTermination()
    assert rows(S.tracked(spark, view, f"{tmp_path}/late")) == rows(view.add_up(view.rows(f)))
    folders = lambda: len(list((tmp_path / "out/fills/new").glob("batch=*")))
    assert folders() == 8
    S.retire_fills(spark, f"{tmp_path}/out", 3)
    assert folders() < 8 and rows(S.ingested(spark, f"{tmp_path}/out")) == rows(f)
    # what a retry of the last batch knows: everything but its own fills
    last = max(r.last for r in table.runs())
    index = I.IdentityIndex(spark, f"{tmp_path}/out/index")
    before = S.landed_fills(spark, f"{tmp_path}/out", last).select("id")
    assert rows(index.known(f.select("id"), last)) == rows(before) and 0 < before.count() < f.count()


def test_only_files_with_candidates_are_opened(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "FILE_IDS", 100)
    index = I.IdentityIndex(spark, str(tmp_path))
    ids = lambda a, b: spark.range(a, b).select(F.concat(F.lit("x"), "id").alias("id"))
    index.add(ids(0, 6_000), 0)
    index.add(ids(6_000, 12_000), 1)
    files = {p.name for p in (tmp_path / "ids/new/batch=0").iterdir() if p.name.startswith("part=")}
    assert len(files) >= 60
    hit = index.candidates(ids(10, 13), 2)
    assert hit.filter("run = 0").select("part").distinct().count() <= 3 and hit.count() < 6
    assert rows(index.known(ids(5_990, 6_010).unionByName(ids(20_000, 20_500)), 2)) == rows(ids(5_990, 6_010))
    assert rows(index.known(ids(5_990, 6_010), 1)) == rows(ids(5_990, 6_000))
    assert index.known(ids(0, 10), 0).isEmpty()


def test_new_versions_replace_old_ones_across_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R.Runs.due, "__defaults__", (2,))
    for b in range(7):
        S.save_version(spark.range(b, b + 3).withColumn("v", F.lit(b)), f"{tmp_path}/v", b, ["id"])
    want = [(i, min(i, 6)) for i in range(9)]
    assert [(r.id, r.v) for r in S.current_state(spark, f"{tmp_path}/v", ["id"]).orderBy("id").collect()] == want
