"""Late reports after a mark or the deadline, over batches and a restart of the stream."""

from datetime import datetime

from brindle.streaming import reports as streams

SHAPE = "id string, template_name string, finished_at timestamp, done boolean"


def day(n):
    return datetime(2020, 1, n)


def test_marks_hold_over_a_restart(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "run")

    def come(*rows):
        spark.createDataFrame(list(rows), SHAPE).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = streams.mark_late(streams.read_reports(spark, folder, SHAPE, per_batch=1), "2020-01-20", "30 days", "30 days")
        return {(r["id"], r["late"]) for r in streams.drain(stream, out).collect()}

    come(("a1", "a", day(3), False), ("b1", "b", day(9), None))
    assert run() == {("a1", False), ("b1", False)}
    come((None, "a", day(5), True), ("a2", "a", day(4), False), ("a3", "a", day(6), False), (None, "a", day(8), True))
    found = run()
    assert found == {("a1", False), ("b1", False), ("a2", False), ("a3", True)}
    come(("a4", "a", day(7), False), ("a5", "a", day(5), False), ("a6", "a", None, False), ("b2", "b", day(20), False), ("b3", "b", day(21), False), ("b4", "b", None, False))
    assert run() - found == {("a4", True), ("a5", False), ("a6", True), ("b2", False), ("b3", True), ("b4", False)}
