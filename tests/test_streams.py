import random

import pytest

from kinetrail.operators import imports, messages
from kinetrail.streaming import converting

SECOND = 1_000_000_000


def start(log):
    return {"log": log, "topic": None, "first": None, "n": 0}


def step(state, m):
    """A row for each run of messages of one topic, when the next run begins."""
    out = []
    if state["topic"] is not None and state["topic"] != m.topic:
        out = flush(state)
        state["n"] = 0
    if not state["n"]:
        state |= {"topic": m.topic, "first": m.log_time}
    state["n"] += 1
    return out


def flush(state):
    return [(state["log"], state["topic"], state["first"], state["n"])] if state["n"] else []


OUT = "log string, topic string, first long, n long"
ROWS = "log string, topic string, log_time long, id long"


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_gives_the_rows_of_the_table(spark, tmp_path, seed):
    converting.keep_state_in_rocksdb(spark)
    rng = random.Random(seed)
    rows = [(f"log{k}", rng.choice("ab"), (200 + i) * SECOND // 2 + rng.randrange(3), 1000 * k + i) for k in range(3) for i in range(40)]
    # Rows come up to four seconds late, over eight files, one a micro-batch.
    late = sorted(rows, key=lambda r: r[2] + rng.randrange(4 * SECOND))
    parts = [late[k : k + 15] for k in range(0, len(late), 15)]
    parts += [[("tick", "a", 1000 * SECOND, -1)], [("tick", "a", 2000 * SECOND, -2)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) == len(parts)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = converting.converted_stream(stream, "log", ["id"], start, step, flush, OUT, "5 seconds", 60 * SECOND)
    query = out.writeStream.format("memory").queryName(f"runs{seed}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.table(f"runs{seed}").collect() if r.log != "tick")
    table = imports.converted(spark.createDataFrame(rows, ROWS), "log", ["log_time", "id"], start, step, flush, OUT)
    assert got == sorted(tuple(r) for r in table.collect()) and len(got) > 20


def test_a_quiet_log_is_flushed_and_begins_anew(spark, tmp_path):
    converting.keep_state_in_rocksdb(spark)
    parts = [[("a", "x", SECOND, 1)], [("b", "x", 100 * SECOND, 2)], [("b", "x", 200 * SECOND, 3)], [("a", "x", 210 * SECOND, 4)], [("b", "y", 400 * SECOND, 5)], [("b", "y", 500 * SECOND, 6)]]
    for part in parts:
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = converting.converted_stream(stream, "log", ["id"], start, step, flush, OUT, "1 second", 30 * SECOND)
    query = out.writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("quiet").collect())
    table = imports.converted(spark.createDataFrame([r for p in parts for r in p], ROWS), "log", ["log_time", "id"], start, step, flush, OUT, 30 * SECOND)
    want = sorted(tuple(r) for r in table.collect())
    assert ("a", "x", SECOND, 1) in want and ("a", "x", 210 * SECOND, 1) in want  # not one run of two
    assert got == want[: len(got)] + want[len(got) + 1 :] and want[len(got)] == ("b", "y", 500 * SECOND, 1)  # the last is still held


def test_last_messages_do_not_lie_after_their_batch(spark):
    rows = [(1, 10, "cam", "c1"), (1, 10, "tf", "t1"), (1, 20, "cam", "c2"), (1, 30, "cam", "c3"), (1, 30, "tf", "t2"), (1, 40, "cam", "c4"), (2, 5, "tf", "z")]
    log = spark.createDataFrame(rows, "log long, log_time long, topic string, data string")
    placed = messages.batched(log, (messages.Monitor("cam", 2, 2),), "log", ["log_time", "topic"])
    got = {(r.log, r.batch, r.topic): r.data for r in messages.last_messages(placed, ["log"]).collect()}
    # The second batch begins at time 30: t2 of that time is no last message of the first.
    assert got == {(1, 0, "cam"): "c2", (1, 0, "tf"): "t1", (1, 1, "cam"): "c4", (1, 1, "tf"): "t2", (2, 0, "tf"): "z"}


def test_equal_times_by_arrival(spark, tmp_path):
    from kinetrail.streaming import batching

    rows = [("a", "cam", 10 * (k // 4), str(99 - k), k) for k in range(40)]
    schema = "log string, topic string, log_time long, data string, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    monitors = (messages.Monitor("cam", 3, 3, 1000),)
    query = batching.batched_stream(stream, monitors, order=("seq",)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.data: r.batch for r in spark.table("arrived").collect()}
    table = messages.batched(spark.createDataFrame(rows, schema), monitors, "log", ["log_time", "seq"], keep_equal_times=False)
    assert got == {r.data: r.batch for r in table.collect()} and len(set(got.values())) == 14
