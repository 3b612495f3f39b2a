import time

from pyspark.sql import functions as F

from corpusloom.sources.ignore import IgnoreRules
from corpusloom.streaming import changes


def test_changes_show_rewrites_and_removals(spark, tmp_path):
    top = tmp_path / "p"
    top.mkdir()
    (top / "a.rs").write_text("fn a() {}")
    (top / "old.rs").write_text("fn old() {}")
    seen = []
    q = changes.apply(changes.changes(spark, str(top), IgnoreRules.of()), lambda df, epoch: seen.extend((r.path, r.op) for r in df.collect()), str(tmp_path / "cp"), "200 milliseconds")
    try:
        deadline = time.time() + 60
        while not q.recentProgress and time.time() < deadline:
            time.sleep(0.2)
        (top / "a.rs").write_text("fn a() { 1 }")
        (top / "b.rs").write_text("fn b() {}")
        (top / "old.rs").unlink()
        (top / "target").mkdir()
        (top / "target" / "x.rs").write_text("")
        while len({p for p, _ in seen}) < 3 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        q.stop()
    assert {("a.rs", "modify"), ("b.rs", "create"), ("old.rs", "remove")} <= set(seen) and not any("target" in p for p, _ in seen)


def test_debounced_batches(spark):
    times = [0, 1, 2, 10, 11, 90000]
    e = spark.createDataFrame([(t,) for t in times], "s long").select(F.timestamp_seconds("s").alias("ts"))
    got = changes.debounced_globally(e, "ts", 5.0).select(F.unix_seconds("batch_start").alias("a"), F.unix_seconds("batch_end").alias("b"), "events").orderBy("a").collect()
    assert [tuple(r) for r in got] == [(0, 2, 3), (10, 11, 2), (90000, 90000, 1)]
