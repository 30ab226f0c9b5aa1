"""Tables are derived at their first use, and again when their inputs change."""

from __future__ import annotations

import shutil

from holdfast.plans import library
from holdfast.sources.tables import DerivedTables, load


def test_titles_need_no_sessions(spark, sf_dir):
    t = DerivedTables(spark, sf_dir)
    assert library.titles_by_genre(t).count() > 0
    assert "content" in vars(t)
    assert not {"sessions", "users", "watch_history", "ratings"} & set(vars(t))


def test_ratings_scan_the_published_sessions(spark, sf_dir):
    t = DerivedTables(spark, sf_dir)
    assert set(t.ratings.inputFiles()) == set(t.sessions.inputFiles())


def test_new_data_under_an_old_path_is_seen(spark, tmp_path):
    for name in ("customer", "nation", "orders", "lineitem", "part"):
        shutil.copyfile(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    first = load(spark, str(tmp_path))
    titles = first.content.count()
    assert load(spark, str(tmp_path)) is first
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(titles // 2).toPandas().to_parquet(tmp_path / "part.parquet")
    assert load(spark, str(tmp_path)).content.count() == titles // 2
