import glob

from mobilome.plans import files
from mobilome.storage import shared_dir


def test_features_are_written_by_several_tasks_and_equal_places_count_once(spark, tmp_path):
    rows = [(i, i % 5, "click" if i % 2 else "view", f"2026-01-{1 + i % 28:02d} 00:{i % 60:02d}:00") for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string")
    events.selectExpr("event_id", "user_id", "event_type", "timestamp(ts) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    before = set(glob.glob(f"{shared_dir(spark)}/mobilome/{spark.sparkContext.applicationId}/features-*"))
    got = files.feature_table(spark, str(tmp_path)).collect()
    at = set(glob.glob(f"{shared_dir(spark)}/mobilome/{spark.sparkContext.applicationId}/features-*")) - before
    assert len(glob.glob(f"{at.pop()}/part-*")) > 1
    places = [(r.start, r.end) for r in got]
    assert len(places) == len(set(places)) > 100 and all(r.found for r in got)
