"""Incremental placement ingestion: each file is appended exactly once."""

from pyspark.sql import functions as F

from conftest import SF_SMALL, same_rows
from viewlens.plans.placements import daily_summary, placement_clean
from viewlens.sources.fixtures import placement_raw
from viewlens.streaming import ingest_placement_files


def test_ingest_appends_new_files_once(spark, tmp_path):
    raw = placement_raw(spark, SF_SMALL)
    src = tmp_path / "incoming"
    # two "days" of files, the second arriving after the first run
    first = raw.where(F.substring("date", 7, 4) < "1998")
    second = raw.where(F.substring("date", 7, 4) >= "1998")
    first.coalesce(1).write.option("header", "true").csv(str(src / "a"))
    out, ck = str(tmp_path / "clean"), str(tmp_path / "ck")
    ingest_placement_files(spark, str(src / "*"), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == first.count()
    second.coalesce(1).write.option("header", "true").csv(str(src / "b"))
    ingest_placement_files(spark, str(src / "*"), out, ck).awaitTermination()
    ingest_placement_files(spark, str(src / "*"), out, ck).awaitTermination()   # nothing new
    got = spark.read.parquet(out)
    assert got.count() == raw.count()
    assert same_rows(daily_summary(placement_clean(raw)), daily_summary(got))
