"""State by path in a stream, against the batch plan over a replayed series of listings."""

import random
from datetime import UTC, datetime, timedelta

from larkspur.operators import state as batch
from larkspur.streaming import state

KIND = "path string, mtime bigint, size bigint, listed_at timestamp, findings_count bigint"
STATE = "path string, mtime bigint, size bigint, findings_count bigint"


def test_stream_against_the_batch_plan(spark, tmp_path):
    """Files come, change and go over five listings; the query is stopped and started between them."""
    r, start = random.Random(3), datetime(2026, 1, 1, tzinfo=UTC)
    inbox, before = str(tmp_path / "in"), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    state.use_rocksdb(spark)
    spark.createDataFrame([], KIND).write.parquet(inbox)
    changes = state.changes(spark.readStream.schema(KIND).parquet(inbox), timedelta(minutes=90))
    files = {f"/f{k}": (k, k) for k in range(12)}
    known, stale, gone, got = spark.createDataFrame([], STATE), [], [], []

    def keep(rows, batch_id):
        got.extend((x.path, x.kind, x.mtime) for x in rows.collect())

    for hour in range(5):
        at = start + timedelta(hours=hour)
        for path in r.sample(sorted(files), 4):
            files[path] = (files[path][0] + 100, files[path][1])
        for path in r.sample(sorted(files), 2):
            del files[path]
        files[f"/new{hour}"] = (hour, 1)
        rows = [(p, m, s, at, None) for p, (m, s) in files.items()]
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(inbox)
        query = changes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        listed = spark.createDataFrame([x[:3] for x in rows], "path string, mtime bigint, size bigint")
        new = batch.stale(listed, known).collect()
        stale += [(x.path, "stale", x.mtime) for x in new]
        stays = batch.pruned(known, listed)
        left = {x.path for x in known.collect()} - {x.path for x in stays.collect()}
        gone += [(x.path, "gone", x.mtime) for x in known.collect() if x.path in left]
        fresh = spark.createDataFrame([(x.path, x.mtime, x.size, 0) for x in new], STATE)
        known = spark.createDataFrame(batch.updated(stays, fresh).collect(), STATE)
    assert sorted(x for x in got if x[1] == "stale") == sorted(stale)
    # a file counts as gone 90 minutes after it was last listed, once the watermark has passed that
    seen_gone = {x for x in got if x[1] == "gone"}
    assert seen_gone <= set(gone) and len(seen_gone) >= len(gone) - 4 > 0
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
