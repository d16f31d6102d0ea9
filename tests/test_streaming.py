"""Streams drained give what batches give, whatever files and batches their rows come in."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import budget, cycle
from millrace.plans import streams
from millrace.registry import QUERIES, SQL
from millrace.streaming import incremental, stateful
from tests.oracle import duck, plain, rows


def dealt(spark, data, path, files: int) -> str:
    """The events as so many files, each a draw of all times, beside the other tables' names."""
    spark.read.parquet(f"{data}/events.parquet").repartition(files, F.xxhash64("event_id")).write.parquet(f"{path}/events.parquet")
    return str(path)


def wanted(name: str, data: str):
    cur = duck(data).execute(SQL[name])
    return rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize(
    ("name", "files"),
    [("t09_streamed_confirmations", 6), ("t07_streamed_budget", 6), ("t06_streamed_ratchet", 6), ("t06_streamed_limits", 120), ("t01_streamed_unseen", 120), ("t05_streamed_cache", 120), ("t11_streamed_counts", 120)],
)
def test_files_in_any_order(spark, data, tmp_path, name, files, monkeypatch):
    """Each batch reads a part of the files only: 6 files one by one, 120 by twenty."""
    read = incremental.read_stream
    monkeypatch.setattr(incremental, "read_stream", lambda s, d, n: read(s, d, n, 1 if files == 6 else 20))
    df = QUERIES[name](spark, dealt(spark, data, tmp_path, files))
    assert rows(df.columns, map(tuple, df.collect())) == wanted(name, data)


def cycles(events, cycle_seconds: int, most: int, retries: int) -> list[tuple]:
    """A plain fold: after every cycle all items of a sheet are looked through. events: sheet, us, item, content, works."""
    out, sheets, length = [], {}, cycle_seconds * 1_000_000
    for sheet, us, item, content, works in sorted(events):
        sheets.setdefault(sheet, []).append((us, item, content, works))
    for sheet, log in sheets.items():
        state: dict = {}
        n, busy = log[0][0] // length, True
        while log or busy:
            while log and log[0][0] < (n + 1) * length:
                us, item, content, works = log.pop(0)
                old = state.get(item)
                if old is None or old["content"] != content:
                    state[item] = (old or {"done": None, "tried": None, "ok": None}) | {"came": us}
                state[item] |= {"content": content, "works": works}
            order = sorted(state, key=lambda i: (state[i]["came"], i))
            fresh = [i for i in order if state[i]["done"] != state[i]["content"]][:most]
            again = [i for i in order if state[i]["done"] == state[i]["content"] and not state[i]["ok"] and state[i]["tried"] != state[i]["content"]][:retries]
            for action, chosen in (("first", fresh), ("retry", again)):
                for i in chosen:
                    s = state[i]
                    s |= {"done": s["content"], "ok": s["works"]} | ({"tried": s["content"]} if action == "retry" else {})
                    out.append((sheet, n, i, action, s["works"]))
            busy, n = bool(fresh or again), n + 1
    return sorted(out)


def test_cycles_like_a_plain_fold(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").selectExpr(
        "cast(pmod(user_id, 8) as string)", "unix_micros(cast(ts as timestamp))", "concat('row ', user_id)", "concat_ws('|', event_type, cast(floor(value / 10) as string))", "event_type <> 'error'"
    )
    got = streams.t02_streamed_cycles(spark, dealt(spark, data, tmp_path, 5))
    want = cycles([tuple(r) for r in e.collect()], 86_400, 3, 1)
    assert sorted(map(tuple, got.select("sheet", "cycle", "item", "action", "verified").collect())) == want
    assert {r[3] for r in want} == {"first", "retry"} and max(r[1] for r in want) - min(r[1] for r in want) > 2


def test_state_outlives_a_restart(spark, tmp_path):
    """A changed row and an expired one come in again after a restart, one seen before it does not."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)  # noqa: DTZ001, E731
    add = lambda *rows: spark.createDataFrame(rows, "event_id bigint, content string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows.parquet"))
    fold = stateful.unseen_fold(10 * 3600)

    def run(close=None):
        replay = stateful.Replay(spark, "restart", str(tmp_path / "state"))
        stream = replay.closed(incremental.read_stream(spark, str(tmp_path), "rows"), "content", "ts")
        out = stateful.folded(stream, "content", "ts", "1 hour", fold)
        replay.run(out)
        return sorted(r["event_id"] for r in (replay.close(out, close) if close else replay.out(out)).collect())

    add((1, "a", at(0)), (2, "b", at(1)), (3, "a", at(2)))
    assert run() == [1, 2]  # the watermark has passed the first hour, but not the second
    add((4, "a", at(9)), (5, "A changed", at(9)), (6, "b", at(12)))
    assert run() == [1, 2, 5]
    add((7, "a", at(11.5)), (8, "a", at(13)))
    assert run(at(900)) == [1, 2, 5, 6, 7]


def test_a_repeated_batch_changes_nothing(spark, data, tmp_path):
    replay = stateful.Replay(spark, "again", str(tmp_path / "state"))
    whole = stateful.folded(replay.closed(incremental.read_stream(spark, data, "events"), "user_id", "ts"), "user_id", "ts", "2000 days", stateful.confirmation_fold())
    replay.run(whole)
    once = sorted(map(tuple, replay.close(whole, dt.datetime(2040, 1, 1)).collect()))  # noqa: DTZ001
    last = max((tmp_path / "state/state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the run had ended before it noted its last batch
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    replay.run(whole)
    assert once and sorted(map(tuple, replay.out(whole).collect())) == once


def test_late_rows_are_dropped_and_ties_are_folded_by_row(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)  # noqa: DTZ001, E731
    schema = "user_id bigint, event_id bigint, event_type string, ts timestamp"
    for part in ([(1, 2, "purchase", at(5)), (1, 1, "error", at(5)), (None, 3, "error", at(5))], [(1, 9, "error", at(30))], [(1, 4, "error", at(6))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        replay = stateful.Replay(spark, "late", str(tmp_path / "state"))
        out = stateful.folded(replay.closed(incremental.read_stream(spark, str(tmp_path), "events"), "user_id", "ts"), "user_id", "ts", "1 hour", stateful.confirmation_fold())
        replay.run(out)
    got = sorted(map(tuple, replay.close(out, at(99)).select("user_id", "event_id", "failures").collect()))
    assert got == [("", 3, 1), ("1", 1, 1), ("1", 2, 0), ("1", 9, 1)]


def test_budget_like_a_plain_fold(spark):
    rng = random.Random(3)
    asks = [(i, rng.choice(["p", "q", None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 80)), rng.choice([None, 0.2, -4.0, 30.9, 250.0])) for i in range(900)]  # noqa: DTZ001
    df = spark.createDataFrame(asks, "id bigint, pool string, ts timestamp, credits double").repartition(7)
    for daily, monthly in ((300, 4000), (0, 900), (260, 0)):
        day, month, want = {}, {}, []
        for i, pool, ts, asked in sorted(asks, key=lambda r: (r[2], r[0])):
            n = max(1, int(asked // 1)) if asked is not None else 1
            d, m = (pool, ts.date()), (pool, ts.year * 12 + ts.month - (ts.day < 12))
            taken = (not daily or day.get(d, 0) + n <= daily) and (not monthly or month.get(m, 0) + n <= monthly)
            want.append((i, day.get(d, 0), month.get(m, 0), taken))
            day[d], month[m] = day.get(d, 0) + n * taken, month.get(m, 0) + n * taken
        got = budget.reserved(df, "pool", "ts", "id", F.col("credits"), daily, monthly)
        assert sorted(map(tuple, got.select("id", "day_used", "cycle_used", "taken").collect())) == sorted(want)
        refused = [w for w in want if not w[3]]
        assert refused and any(w[3] and w[0] != r[0] and w[1] == r[1] > 0 for r in refused for w in want)  # a smaller one was still taken
    assert budget.reserved(df.limit(0), "pool", "ts", "id", F.col("credits"), 1, 1).collect() == []


def test_schemas():
    assert stateful.names("a bigint, b map<string,struct<c:int,d:int>>, e array<int>") == ["a", "b", "e"] and plain(True) == "True"


def test_unseen_rows(spark):
    table = spark.createDataFrame([(i, f"https://x/{i}", None, 22.0, "c", f"s{i}") for i in range(1, 1003)], "row_number int, url string, price double, price_multiplier double, collection string, sku string")
    seen = incremental.unseen_batch(table.where("row_number <= 300"), spark.createDataFrame([], "hash string"))
    left = incremental.unseen_batch(table, seen)
    assert left.count() == 702 and left.agg(F.min("row_number")).first()[0] == 301
    changed = table.where("row_number = 1").withColumn("sku", F.lit("new"))
    assert incremental.unseen_batch(changed, seen).count() == 1


def test_unseen_stream(spark, tmp_path):
    row = "row_number int, url string, price double, price_multiplier double, collection string, sku string, at timestamp"
    one = [(1, "u", None, 22.0, "c", "s")]
    for table in (one, [*one, (2, "v", 1.0, 22.0, "c", "s")]):
        spark.createDataFrame([(*r, None) for r in table], row).withColumn("at", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows.parquet"))
    stream = incremental.unseen(incremental.read_stream(spark, str(tmp_path), "rows"), "at")
    assert sorted(r["row_number"] for r in incremental.drain(stream, "unseen", "append", str(tmp_path / "c4")).collect()) == [1, 2]


def test_confirmations_like_the_batch_form(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet")
    want = cycle.since_last_success(e, "user_id", "ts", F.col("event_type") == "purchase", F.col("event_type") == "error")
    assert sorted(map(tuple, streams.t09_streamed_confirmations(spark, data).collect())) == sorted(map(tuple, want.collect()))
