"""Streams with expiring state against their batch forms."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from defgrain.operators.report import latest_progress
from defgrain.sources.staging import new_folder
from defgrain.streaming import stateful


def stream_of(spark, batches, schema, tmp_path):
    """Each batch is a file, taken one at a time in this order."""
    path = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(spark, stream):
    """What the stream reports, in order of its batches, and the rows of state after each."""
    out = []
    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", new_folder(spark, "state"))
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, n: out.extend((n, *r) for r in batch.collect()))
        .start()
    )
    query.awaitTermination()
    return out, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]


EVENTS = "k long, at timestamp, seq long, note string, v double"


def at(spark, rows):
    return [(k, spark.sql(f"SELECT timestamp_micros({int(t * 1e6)})").first()[0], s, n, v) for k, t, s, n, v in rows]


@pytest.mark.parametrize("seed", [0, 1])
def test_shuffled_late_events_end_as_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3, 2**53 + 1]), 1000 + rng.randrange(60) + 1e-6 * i, rng.choice([None, 2**60 + i]), rng.choice(["x", None, 'q"\n']), rng.choice([None, 0.1 * i])) for i in range(60)]
    rows = at(spark, rows)
    rng.shuffle(rows)
    stream = stream_of(spark, [rows[i : i + 15] for i in range(0, 60, 15)], EVENTS, tmp_path)
    got, _ = drain(spark, stateful.stream_live_progress(stream, "k", "at", "seq", ["note", "v"], "1 hour", "1 hour"))
    last = {}
    for _, k, *rest in got:
        last[k] = tuple(rest)
    batch = latest_progress(spark.createDataFrame(rows, EVENTS), "k", ["at", "seq"], ["note", "v"])
    assert last == {r[0]: tuple(r[1:]) for r in batch.collect()}


def test_idle_keys_lose_their_state_and_late_events_change_nothing(spark, tmp_path):
    batches = [
        [(k, 1000, 1, "first", 1.0) for k in range(20)],
        [(0, 2000, 2, "later", 2.0), (1, 990, 9, "late but in time", 0.0)],
        [(0, 2001, 3, "last", 3.0)],
        [(0, 2002, 4, "end", 4.0), (5, 1000, 99, "too late", 9.0)],  # Spark drops by the watermark of the batch before
    ]
    stream = stream_of(spark, [at(spark, b) for b in batches], EVENTS, tmp_path)
    got, state = drain(spark, stateful.stream_live_progress(stream, "k", "at", "seq", ["note", "v"], "20 seconds", "60 seconds"))
    assert max(state) == 20 and state[-1] == 1
    notes = [(r[1], r[4]) for r in got]
    assert (5, "too late") not in notes and (1, "late but in time") not in notes
    assert notes[-1] == (0, "end") and len(notes) == 23


TEXTS = "id long, code string, at timestamp"


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_first_copies_whatever_the_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", f"t{i % 11}", None, " "]), 1000 + rng.randrange(50)) for i in range(80)]
    want = {}
    for i, c, _ in rows:
        if c:  # blanks are a text, as in the batch form
            want[c] = min(i, want.get(c, i))
    rows = [(i, c, spark.sql(f"SELECT timestamp_seconds({t})").first()[0]) for i, c, t in rows]
    rng.shuffle(rows)
    stream = stream_of(spark, [rows[i : i + 20] for i in range(0, 80, 20)], TEXTS, tmp_path)
    got, state = drain(spark, stateful.stream_first_copies(stream, "code", "id", "at", "1 hour"))
    updates = spark.createDataFrame([r[1:] for r in got], "text_hash string, first_key long, instead_of long")
    assert sorted(r[1] for r in stateful.last_updates(updates, "first_key").collect()) == sorted(want.values())
    before = {}
    for _, text, first, instead in got:
        assert instead == before.get(text) and (instead is None or first < instead)
        before[text] = first
    assert state[-1] == len(want)


def test_texts_not_seen_for_the_delay_are_forgotten(spark, tmp_path):
    def ts(t):
        return spark.sql(f"SELECT timestamp_seconds({t})").first()[0]

    batches = [[(i, f"t{i}", ts(1000)) for i in range(30)], [(100, "t0", ts(5000))], [(101, "t0", ts(5001))], [(102, "t0", ts(5002))]]
    stream = stream_of(spark, batches, TEXTS, tmp_path)
    _, state = drain(spark, stateful.stream_first_copies(stream, "code", "id", "at", "10 seconds"))
    assert max(state) == 30 and state[-1] == 1


@pytest.mark.parametrize("places", [1, 4])
def test_texts_that_share_a_row_of_state(spark, tmp_path, places):
    """A call into Python serves all texts of a place; each is reported and forgotten on its own."""

    def rows(*found):
        return [(i, t, spark.sql(f"SELECT timestamp_seconds({s})").first()[0]) for i, t, s in found]

    batches = [
        rows(*[(50 + i, f"t{i}", 1000) for i in range(40)]),
        rows((7, "t3", 1001), (60, "t10", 1004), (200, "new", 1005)),
        rows((8, "t3", 1030), (300, "other", 1030)),  # the watermark is 995 still: nothing is forgotten
        rows((6, "t3", 1031)),
        rows((5, "t3", 1032), (301, "t0", 1032)),
    ]
    stream = stream_of(spark, batches, TEXTS, tmp_path)
    got, state = drain(spark, stateful.stream_first_copies(stream, "code", "id", "at", "10 seconds", places))
    name = {hashlib.sha256(t.encode()).hexdigest(): t for t in ["new", "other", *[f"t{i}" for i in range(40)]]}
    changes = [(name[t], first, instead) for _, t, first, instead in got]
    assert sorted(changes[:40]) == sorted((f"t{i}", 50 + i, None) for i in range(40))
    assert sorted(changes[40:42]) == [("new", 200, None), ("t3", 7, 53)]
    assert changes[42:] == [("other", 300, None), ("t3", 6, 7), *sorted([("t0", 301, None), ("t3", 5, 6)], key=lambda c: changes.index(c))]
    assert max(state) <= places
