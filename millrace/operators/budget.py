"""Reservations against a budget: each is taken only if the day's and the billing cycle's limits still hold with it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons

_OUT = pa.schema([("day_used", pa.int64()), ("cycle_used", pa.int64()), ("taken", pa.bool_())])


def credits(asked: Column) -> Column:
    """Whole credits of a request, 1 at the least."""
    return F.greatest(F.lit(1), F.coalesce(F.floor(asked), F.lit(1))).cast("long")


def reserved(requests: DataFrame, pool: str, at: str, key: str, asked: Column, daily: int, monthly: int, billing_day: int = 12) -> DataFrame:
    """key, pool, credits, day_used, cycle_used, taken of requests in order of time (ties by key).

    day_used and cycle_used are what earlier reservations of the pool's day and billing cycle use; a refused request uses
    nothing, so a smaller one after it may still be taken. A limit of 0 is none. What is taken hangs on everything
    before it in the cycle, so a pool's cycle is read in order by one task, which holds two sums; cycles and pools
    are apart.
    """
    own = requests.select(
        F.col(key).alias("key"), F.col(pool).alias("pool"), credits(asked).alias("credits"), F.col(at).cast("timestamp").alias("at"), F.date_trunc("day", F.col(at)).cast("timestamp").alias("day"),
        jsons.cycle_start(F.col(at), billing_day).cast("timestamp").alias("cycle"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cycle = day = None
        cycle_used = day_used = 0
        for b in batches:
            out = []
            for p, c, d, n in zip(*(b.column(x).to_pylist() for x in ("pool", "cycle", "day", "credits")), strict=True):
                if (p, c) != cycle:
                    cycle, cycle_used, day = (p, c), 0, None
                if d != day:
                    day, day_used = d, 0
                taken = (not daily or day_used + n <= daily) and (not monthly or cycle_used + n <= monthly)
                out.append((day_used, cycle_used, taken))
                day_used, cycle_used = day_used + n * taken, cycle_used + n * taken
            if out:
                made = [pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), _OUT, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("pool"), b.column("credits"), *made], ["key", "pool", "credits", *_OUT.names])

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    ordered = own.repartition("pool", "cycle").sortWithinPartitions("pool", "cycle", "at", "key")
    return ordered.mapInArrow(run, f"key {kinds['key']}, pool {kinds['pool']}, credits bigint, day_used bigint, cycle_used bigint, taken boolean").withColumnsRenamed({"key": key, "pool": pool})
