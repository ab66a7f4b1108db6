"""The step of watermarks at the edge of their type, against the SQL twin."""

from twin_check import difference, duck

from tidemark.plans.registry import all_queries, all_twins


def test_room_below_the_largest_number(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate((99.97, 99.98, 99.99, 100.0, 0.0, None))]
    df = spark.createDataFrame(rows, "event_id BIGINT, value DOUBLE").selectExpr(
        "event_id", "timestamp_ntz'2024-01-01' AS ts", "event_id AS user_id", "'view' AS event_type", "value", "'{}' AS props")
    df.coalesce(1).write.parquet(f"{tmp_path}/parts")
    part = next((tmp_path / "parts").glob("part-*.parquet"))
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "events.parquet").symlink_to(part)
    data = str(tmp_path / "data")
    assert difference(all_queries()["typed_successor"](spark, data), duck(data), all_twins()["typed_successor"]) is None
