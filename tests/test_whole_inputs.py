import datetime

import pytest

from trellis.operators import stats
from trellis.plans import hosts, queries


def test_combine_series_reaches_the_last_user(spark, tmp_path):
    rows = [(u, datetime.datetime(2024, 1, 1), float(u)) for u in (0, 2, 3, 6, 199, 200, 246, 249)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.idx: r.value for r in queries.combine_series(spark, str(tmp_path)).collect()}
    want = {u: v if u % 2 == 0 else v * 10 if u % 3 == 0 else 0.0 for u, _, v in rows}
    assert got == {i: want.get(i, 0.0) for i in range(250)}


def test_resample_mesh_takes_the_whole_box(spark, tmp_path):
    spark.range(216).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    whole = stats.summary(stats.volumes(hosts.box_mesh(spark, str(tmp_path))), "value").first().total
    got = queries.resample_mesh(spark, str(tmp_path)).first()
    assert got.total == pytest.approx(whole) and got.longest <= 1.6


def test_interpolate_cloud_rbf_answers_every_point(spark, tmp_path):
    rows = [(i, [float(i % 5), float(i // 5 % 5), float(i // 25), 1.0]) for i in range(50)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.idx: r.value for r in queries.interpolate_cloud_rbf(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(50)) and all(v == pytest.approx(1.0, abs=0.1) for v in got.values())
