"""Lines of placement files that are no rows are kept apart, and headers are compared on wish."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from viewlens.sources.readers import quarantine_placement_csv, read_placement_csv, read_placement_csv_checked

HEADER = "Date,Publisher ID,Placement ID,% In View,Measured Impressions,Total Impressions"
GOOD = ['06-10-2014,1,2,50%,"1,200","2,000"', "06-11-2014,1,2,,3,4", '06-12-2014,1,"a ""b""",5%,"",7', "06-13-2014,,,,,"]
BAD = ["06-10-2014,1,2", "06-10-2014,1,2,50%,1,2,3", '06-10-2014,1,2,50%,3,"2,000', '06-10-2014,1,2,50%,3,"2000',
       '06-10-2014,1,2,50%,"3,4', "just text"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.csv").write_text("\n".join([HEADER, *GOOD, *BAD]) + "\n")
    return str(tmp_path / "in")


def test_good_and_bad_lines_add_up(spark, folder, tmp_path):
    good, bad = read_placement_csv_checked(spark, folder)
    assert good.count() == 3 * len(GOOD) and bad.count() == 3 * len(BAD)
    assert ("06-10-2014", "1", "2", "50%", "1,200", "2,000") in rows(good)
    assert {r[0] for r in rows(good, "placement_id")} == {"2", 'a "b"', None}
    lines = {r[0] for r in rows(bad)}
    assert {BAD[0], BAD[1], BAD[5]} <= lines
    kept, report = quarantine_placement_csv(spark, folder, str(tmp_path / "bad"))
    assert report.first().asDict() == {"good": 3 * len(GOOD), "bad": 3 * len(BAD)}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 3 * len(BAD) and kept.count() == 3 * len(GOOD)


def test_columns_that_are_not_used_do_not_hide_bad_lines(spark, folder):
    good, _ = read_placement_csv_checked(spark, folder)
    assert good.select("date").count() == good.agg(F.count(F.lit(1))).first()[0] == 3 * len(GOOD)


def test_headers_are_compared_where_one_is_expected(spark, folder, tmp_path):
    names = HEADER.split(",")
    assert read_placement_csv(spark, folder, expected_header=names).columns[0] == "date"
    assert read_placement_csv(spark, folder, expected_header=names).where("publisher_id = '1'").count() > 0
    (tmp_path / "in" / "g.csv").write_text(HEADER.replace("Measured", "Counted") + "\n" + GOOD[0] + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_placement_csv(spark, folder, expected_header=names).collect()
    with pytest.raises(ValueError):
        read_placement_csv(spark, folder, expected_header=names[:3])
