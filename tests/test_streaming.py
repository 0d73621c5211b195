import datetime as dt
import time

from palimpsest.streaming import epochs


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    shape = "event_id long, ts timestamp_ntz, event_type string, value double"
    folder = tmp_path / "events.parquet"
    for batch in ([(1, day(10), "a", 1.0)], [(4, day(10), "a", 4.0)], [(2, day(2), "a", 2.0), (3, day(9), "a", 3.0)]):
        spark.createDataFrame(batch, shape).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are read in order of their time
    found = lambda late: {(r["day_us"] // 86_400_000_000 - 19_722, r["events"]) for r in epochs.windowed_available(spark, str(tmp_path), late).collect()}
    assert found("2 days") == {(10, 2), (9, 1)}
    assert found("30 days") == {(10, 2), (9, 1), (2, 1)}
