"""Per-key state in order of event time.

A stream's batches hold rows in any order. Rows are kept in state until the watermark has passed them, and
are then folded in order of time, so what comes out does not hang on how rows were dealt into files or batches. A row
that is later than the watermark allows is dropped by Spark before it gets here.

A fold is a function (state, row) -> (state, out): state and row are tuples of simple values, out a tuple or None. What
a key may hold is bounded by the watermark's delay; the fold's own state by the fold.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import nsmallest

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.shared import folder

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A key of rows that only move the watermark, and its slot.
CLOSING, CLOSING_SLOT = "~closing", -1
#: Microseconds of a day, of which rows that wait are stored together.
DAY = 86_400_000_000


@dataclass(frozen=True)
class Fold:
    """What is kept of a key, what is read of a row beside its time, and what comes out.

    step(state, us, row) gives the new state and a row to put out, or None; end(state, until) is called before a row and
    when the watermark moves, with the time up to which nothing came that is not folded, and gives the new state and rows:
    for what happens at times of its own, such as the end of a cycle. next(state) says when that is, in microseconds.
    """

    row: str
    state: str
    out: str
    start: tuple
    step: Callable[[tuple, int, tuple], tuple[tuple, tuple | None]]
    end: Callable[[tuple, int], tuple[tuple, list[tuple]]] | None = None
    next: Callable[[tuple], int | None] | None = None


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in _split(schema)]


def _split(schema: str) -> list[str]:
    """Columns of a DDL schema: commas inside types do not part them."""
    out, depth = [""], 0
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [c.strip() for c in out]


def plain(v):
    """A value as state keeps it: numpy's and pandas' as Python's, not a number as null."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    return None if isinstance(v, float) and v != v else v


class Ordered(StatefulProcessor):
    """Holds rows until the watermark has passed them, then folds each key's in order of time and of the row.

    Many keys share a slot, which is what Spark keeps state and timers of: calls of its state for every key would cost far
    more than the rows. A slot's rows wait as Arrow batches, each of one day, so that a release reads, sorts and folds a day of
    rows at a time and leaves days alone that it does not reach. The folds' states of a slot are read and written together;
    one that is as at the start is not kept.
    """

    def __init__(self, fold: Fold, schema: pa.Schema):
        self.fold, self.schema = fold, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day bigint, first bigint, n bigint", "rows binary")
        self.held = handle.getListState("held", f"fold_key string, {self.fold.state}")
        self.due = handle.getValueState("due", "ms bigint")
        self.made = handle.getValueState("made", "n bigint")

    def wake(self, us: int) -> None:
        """Has the slot looked at again once the watermark has passed this time, unless it will be sooner."""
        ms = -(-us // 1000)
        due = self.due.get() if self.due.exists() else None
        if due is None or due[0] > ms:
            if due is not None:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def keep(self, batches: Iterator[tuple[int, pa.RecordBatch]]) -> None:
        """Adds batches to those of their day, with their first time and a number that none has had."""
        n = self.made.get()[0] if self.made.exists() else 0
        for day, batch in batches:
            n += 1
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, self.schema) as to:
                to.write_batch(batch)
            self.days.updateValue((day, pc.min(batch["fold_us"]).as_py(), n), (out.getvalue().to_pybytes(),))
        self.made.update((n,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        def dealt() -> Iterator[tuple[int, pa.RecordBatch]]:
            for frame in rows:
                for day, own in frame.groupby(frame["fold_us"] // DAY):
                    yield int(day), pa.RecordBatch.from_pandas(own[self.schema.names], schema=self.schema, preserve_index=False)

        if key[0] != CLOSING_SLOT:
            self.keep(dealt())
            self.wake_for_rows()
        return iter(())

    def wake_for_rows(self) -> None:
        if times := [first for _, first, _ in self.days.keys()]:  # noqa: SIM118  of the state
            self.wake(min(times))

    def released(self, keys: list[tuple], until: int) -> pa.Table:
        """The rows of a day's batches that the watermark has passed, by key, time and row; the others are kept on."""
        stored = [self.days.getValue(k)[0] for k in keys]
        for k in keys:
            self.days.removeKey(k)
        rows = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in stored])
        left = rows.filter(pc.field("fold_us") > until)
        if left.num_rows:
            rows = rows.filter(pc.field("fold_us") <= until)
            self.keep((keys[0][0], b) for b in left.combine_chunks().to_batches())
        return rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in self.schema.names], null_placement="at_start"))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, fold, out = timerValues.getCurrentWatermarkInMs() * 1000, self.fold, []
        self.due.clear()
        states = {k: tuple(state) for k, *state in self.held.get()} if self.held.exists() else {}
        ready: dict[int, list[tuple]] = {}
        for stored in self.days.keys():  # noqa: SIM118  of the state
            if stored[1] <= until:
                ready.setdefault(stored[0], []).append(tuple(stored))
        for day in sorted(ready):
            rows = self.released(ready[day], until)
            for k, us, *row in zip(*(rows[c].to_pylist() for c in self.schema.names), strict=True):
                state = states.get(k, fold.start)
                if fold.end:
                    state, ended = fold.end(state, us)
                    out += [(k, *r) for r in ended]
                states[k], made = fold.step(state, us, tuple(row))
                if made is not None:
                    out.append((k, *made))
            if out:
                yield pd.DataFrame(out, columns=["fold_key", *names(fold.out)])
                out = []
        if fold.end:
            for k, state in states.items():
                states[k], ended = fold.end(state, until)
                out += [(k, *r) for r in ended]
        alive = [(k, *state) for k, state in states.items() if state != fold.start]
        if alive:
            self.held.put(alive)
        elif self.held.exists():
            self.held.clear()
        self.wake_for_rows()
        if fold.next and (due := [at for state in states.values() if (at := fold.next(state)) is not None]):
            self.wake(min(due))
        if out:
            yield pd.DataFrame(out, columns=["fold_key", *names(fold.out)])

    def close(self) -> None:
        pass


def folded(stream: DataFrame, key: str, at: str, late: str, fold: Fold, slots: int = 256) -> DataFrame:
    """key and fold.out of a stream, folded by key in order of `at`; rows later than `late` are dropped.

    Ties in time are folded in order of the row's columns. Keys are compared as strings; rows without a key share one.
    Keys are dealt into so many slots, over which the work is spread; a checkpoint holds for one number of them.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    each = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    rows = each.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("fold_key"), at, F.unix_micros(at).alias("fold_us"), *names(fold.row))
    slot = F.when(F.col("fold_key") == CLOSING, CLOSING_SLOT).otherwise(F.pmod(F.xxhash64("fold_key"), F.lit(slots)).cast("int"))
    schema = to_arrow_schema(rows.select("fold_key", "fold_us", *names(fold.row)).schema)
    made = rows.withColumn("fold_slot", slot).groupBy("fold_slot").transformWithStateInPandas(Ordered(fold, schema), f"fold_key string, {fold.out}", "Append", "EventTime")
    return made.withColumnRenamed("fold_key", key)


def folded_batch(rows: DataFrame, key: str, at: str, fold: Fold) -> DataFrame:
    """key and fold.out of a table: what the stream of its rows gives once all of them have been folded.

    Rows are dealt out by key, sorted by time and then by their own columns, and read through: a task holds the fold's state
    of one key. What happens after a key's last row (fold.end) happens up to a year later.
    """
    cols = names(fold.row)
    each = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("fold_key"), F.unix_micros(F.col(at).cast("timestamp")).alias("fold_us"), *cols)
    year = 366 * 86_400 * 1_000_000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, last, out = None, None, 0, []

        def ended() -> None:
            if own is not None and fold.end:
                out.extend((own, *r) for r in fold.end(state, last + year)[1])

        for frame in frames:
            for k, us, *row in zip(*(frame[c].tolist() for c in ("fold_key", "fold_us", *cols)), strict=True):
                if k != own:
                    ended()
                    own, state = k, fold.start
                if fold.end:
                    state, made = fold.end(state, us)
                    out.extend((own, *r) for r in made)
                state, made = fold.step(state, us, tuple(map(plain, row)))
                last = us
                if made is not None:
                    out.append((own, *made))
            if out:
                yield pd.DataFrame(out, columns=["fold_key", *names(fold.out)])
                out = []
        ended()
        if out:
            yield pd.DataFrame(out, columns=["fold_key", *names(fold.out)])

    return each.repartition("fold_key").sortWithinPartitions("fold_key", "fold_us", *cols).mapInPandas(run, f"fold_key string, {fold.out}").withColumnRenamed("fold_key", key)


class Replay:
    """A stream run over what is there, in steps, until all has been folded.

    `close` adds a row beyond all others, whose time lets the watermark pass them; it needs the stream to be the union
    that `closed` makes. State and output stay in the shared folder, so a later run goes on where the last one ended.
    """

    def __init__(self, spark, name: str, at: str | None = None):
        self.spark, self.path = spark, at or f"{folder(spark)}/{name}-{uuid.uuid4().hex}"

    def closed(self, stream: DataFrame, key: str, at: str) -> DataFrame:
        """The stream with the closing rows of this replay, which have nulls in all other columns."""
        self.spark.createDataFrame([], "at timestamp").write.mode("ignore").parquet(f"{self.path}/closing")
        own = self.spark.readStream.schema("at timestamp").parquet(f"{self.path}/closing")
        nothing = [F.lit(CLOSING).alias(f.name) if f.name == key else F.col("at").cast(f.dataType).alias(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
        return stream.withColumn(key, F.col(key).cast("string")).unionByName(own.select(*nothing))

    def run(self, stream: DataFrame) -> None:
        """Reads what is new; each batch's rows are written under its number, so one that is repeated replaces itself."""

        def keep(df: DataFrame, i: int) -> None:
            df.write.mode("overwrite").parquet(f"{self.path}/out/batch={i}")

        query = stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    def close(self, stream: DataFrame, at) -> DataFrame:
        """Lets the watermark pass `at`, a time later than all rows by more than they may be late, and gives all that came out."""
        self.spark.createDataFrame([(at,)], "at timestamp").write.mode("append").parquet(f"{self.path}/closing")
        self.run(stream)
        return self.out(stream)

    def out(self, stream: DataFrame) -> DataFrame:
        return self.spark.read.schema(stream.schema).parquet(f"{self.path}/out").select(*stream.columns)


def beyond(last: dt.datetime | None, late: int) -> dt.datetime:
    """A time by which everything up to `last` is too late, and what happens within a year of it is over."""
    return (last or dt.datetime(2000, 1, 1)) + dt.timedelta(seconds=2 * late, days=366)  # noqa: DTZ001


def replayed(stream: DataFrame, table: DataFrame, key: str, at: str, fold: Fold, name: str) -> DataFrame:
    """What a fold over the stream of a whole table gives, whatever order its files are read in.

    The rows may be as late as the table is long, so all are held, in state on disk, until the last batch.
    """
    span = table.agg(F.min(at).cast("timestamp").alias("first"), F.max(at).cast("timestamp").alias("last")).first()
    replay = Replay(table.sparkSession, name)
    late = 0 if span["last"] is None else int((span["last"] - span["first"]).total_seconds()) + 1
    whole = folded(replay.closed(stream, key, at), key, at, f"{late} seconds", fold)
    replay.run(whole)
    return replay.close(whole, beyond(span["last"], late))


# Folds


def limit_fold(seconds: int, limit: int, ratchet: bool = False) -> Fold:
    """in_window, limited of every row: requests of the last `seconds` up to it, against a limit.

    With ratchet a restriction (an error) halves the limit of what follows for good, to 1 at the least.
    """

    def step(state: tuple, us: int, row: tuple) -> tuple[tuple, tuple]:
        times, own = state
        times = [t for t in times if t > us - seconds * 1_000_000] + [us]
        out = (row[0], len(times), len(times) >= own)
        return (times, max(1, own // 2) if ratchet and row[1] == "error" else own), out

    return Fold("event_id bigint, event_type string", "times array<bigint>, own bigint", "event_id bigint, in_window bigint, limited boolean", ([], limit), step)


def confirmation_fold(needed: int = 2) -> Fold:
    """failures, confirmed after every row that counts: failures since the last success, confirmed by two or three."""
    least = min(3, max(2, needed))

    def step(state: tuple, us: int, row: tuple) -> tuple[tuple, tuple]:
        n = 0 if row[1] == "purchase" else state[0] + (row[1] == "error")
        return (n,), (us, row[0], n, n >= least)

    return Fold("event_id bigint, event_type string", "failures bigint", "us bigint, event_id bigint, failures bigint, confirmed boolean", (0,), step)


def unseen_fold(ttl_seconds: int) -> Fold:
    """The rows of a key (a content's fingerprint) that were not taken within the time to live; taking one starts it anew."""

    def step(state: tuple, us: int, row: tuple) -> tuple[tuple, tuple | None]:
        (taken,) = state
        if taken is not None and us <= taken + ttl_seconds * 1_000_000:
            return state, None
        return (us,), (row[0],)

    return Fold("event_id bigint", "taken bigint", "event_id bigint", (None,), step, lambda state, until: ((state[0] if state[0] is not None and until <= state[0] + ttl_seconds * 1_000_000 else None,), []))


def cache_fold(ttl_seconds: int, most: int = 100) -> Fold:
    """hit of every read: an entry of the key was put before and has not expired. Rows: event_id, op (put or get), entry.

    A key (a cache) keeps its entries in a map, of which those that expire last stay where there are more than `most`.
    """

    def alive(entries: dict, us: int) -> dict:
        return {e: t for e, t in entries.items() if t >= us}

    def step(state: tuple, us: int, row: tuple) -> tuple[tuple, tuple | None]:
        entries = alive(dict(state[0]), us)
        event, op, entry = row
        if op == "get":
            return (entries,), (event, entry in entries)
        if op == "put":
            entries[entry] = us + ttl_seconds * 1_000_000
            if len(entries) > most:
                entries = dict(sorted(entries.items(), key=lambda x: (-x[1], x[0]))[:most])
        return (entries,), None

    return Fold("event_id bigint, op string, entry string", "entries map<string,bigint>", "event_id bigint, hit boolean", ({},), step)


def budget_fold(daily: int, monthly: int, billing_day: int = 12) -> Fold:
    """taken, day_used, cycle_used of every reservation: what was used before it, and whether both limits still held with it.

    A refused reservation uses nothing. A limit of 0 is none. Rows: event_id, credits.
    """

    def step(state: tuple, us: int, row: tuple) -> tuple[tuple, tuple]:
        day = us // 86_400_000_000
        date = dt.date(1970, 1, 1) + dt.timedelta(days=day)
        cycle = date.year * 12 + date.month - (date.day < billing_day)
        day_used, cycle_used = (state[1] if state[0] == day else 0), (state[3] if state[2] == cycle else 0)
        taken = (not daily or day_used + row[1] <= daily) and (not monthly or cycle_used + row[1] <= monthly)
        spent = row[1] if taken else 0
        return (day, day_used + spent, cycle, cycle_used + spent), (row[0], day_used, cycle_used, taken)

    return Fold("event_id bigint, credits bigint", "day bigint, day_used bigint, cycle bigint, cycle_used bigint", "event_id bigint, day_used bigint, cycle_used bigint, taken boolean", (None, 0, None, 0), step)


def cycle_fold(cycle_seconds: int, most: int, retries: int) -> Fold:
    """cycle, row, action, verified of what a sheet's cycles take.

    Rows: item, print (of its content), works. At the end of each cycle, items whose content has not been processed as it
    is are taken in the order in which they came, `most` a cycle, and those processed without success once more for each
    content, `retries` a cycle; what is left waits for the next cycle. An item is verified if its content works.
    """

    def end(state: tuple, until: int) -> tuple[tuple, list[tuple]]:
        ends, items = state
        out, length = [], cycle_seconds * 1_000_000
        while ends is not None and ends <= until:
            fresh = nsmallest(most, (x for x in items.items() if x[1][2] != x[1][0]), key=lambda x: (x[1][5], x[0]))
            again = nsmallest(retries, (x for x in items.items() if x[1][2] == x[1][0] and not x[1][3] and x[1][4] != x[1][0]), key=lambda x: (x[1][5], x[0]))
            for action, chosen in (("first", fresh), ("retry", again)):
                for item, (content, works, _, _, tried, came) in chosen:
                    items[item] = (content, works, content, works, content if action == "retry" else tried, came)
                    out.append((ends // length - 1, item, action, works))
            ends = ends + length if fresh or again else None
        return (ends, items), out

    def step(state: tuple, us: int, row: tuple) -> tuple[tuple, None]:
        ends, items = state
        items = items or {}  # the start's is everyone's; a key's own is changed in place, as a copy for every row would be quadratic
        item, content, works = row
        old = items.get(item, (None, None, None, None, None, us))
        items[item] = (content, works, old[2], old[3], old[4], us if old[0] != content else old[5])
        return (ends or (us // (cycle_seconds * 1_000_000) + 1) * cycle_seconds * 1_000_000, items), None

    entry = "struct<content:string,works:boolean,done:string,verified:boolean,tried:string,came:bigint>"
    out = "cycle bigint, item string, action string, verified boolean"
    return Fold("item string, content string, works boolean", f"ends bigint, items map<string,{entry}>", out, (None, {}), step, end, lambda state: state[0])
