"""Product codes of vectors: Lloyd's rounds with Elkan's bounds, in whole numbers.

Vectors are cut into equal parts and each part position has a codebook. Every row carries, for each of its parts, an
upper bound of the distance to its entry and a lower bound of the distance to every entry; the table of rows and
bounds is written each round. When entries have moved, the bounds are shifted by how far. An entry is passed over only
if it is strictly farther by the bounds: its lower bound is above the upper bound, or it is more than twice the upper
bound away from the row's entry. All other distances are computed in integers, which also settle ties, so the codes
are those of plain Lloyd rounds. Bounds are floats of 32 bits, rounded away from what they bound.

The driver holds codebooks only; their sums are gathered as one row per task, part, entry and position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, small_batches, table, unwritten, written
from .vectors import floored, grid

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
FAR = np.iinfo(np.int64).max
FLOAT = np.float32


def above(x: np.ndarray) -> np.ndarray:
    """Floats of 32 bits that are no less than x."""
    return np.nextafter(np.asarray(x, np.float64).astype(FLOAT), FLOAT(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    """Floats of 32 bits that are no more than x, and not negative."""
    return np.maximum(np.nextafter(np.asarray(x, np.float64).astype(FLOAT), FLOAT(-np.inf)), FLOAT(0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, as integers."""
    d = a - b
    return (d * d).sum(axis=-1)


def reassigned(x: np.ndarray, book: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves one part of rows to their nearest entries, in place; returns how many distances it took.

    x: [row, position], book: [entry, position], lower: [row, entry]; of entries at one distance the first is taken.
    """
    between = below(np.sqrt(squared(book[:, None], book[None])))

    def open_(rows: np.ndarray) -> np.ndarray:
        u = upper[rows, None].astype(np.float64)
        out = ~(u < lower[rows]) & ~(2 * u < between[code[rows]])
        out[np.arange(len(rows)), code[rows]] = False
        return out

    everyone = np.arange(len(x))
    some = everyone[open_(everyone).any(axis=1)]
    if not len(some):
        return 0
    own = code[some]
    near = squared(x[some], book[own])
    upper[some], lower[some, own] = above(np.sqrt(near)), below(np.sqrt(near))
    i, entry = np.nonzero(open_(some))
    d = squared(x[some[i]], book[entry])
    lower[some[i], entry] = below(np.sqrt(d))
    far = np.full((len(some), len(book)), FAR)
    far[np.arange(len(some)), own] = near
    far[i, entry] = d
    code[some] = far.argmin(axis=1)
    upper[some] = above(np.sqrt(far.min(axis=1)))
    return len(some) + len(d)


class State:
    """Rows of a batch with codes and bounds: x [row, part, position], code and upper [row, part], lower [row, part, entry]."""

    def __init__(self, batch: pa.RecordBatch, parts: int, step: int, entries: int):
        n = batch.num_rows
        self.x = grid(batch.column("x"), parts * step).reshape(n, parts, step)
        if "code" in batch.schema.names:
            read = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
            self.code = read("code", np.uint8).reshape(n, parts).astype(np.int64)
            self.upper, self.lower = read("upper", FLOAT).reshape(n, parts).copy(), read("lower", FLOAT).reshape(n, parts, entries).copy()
        else:
            self.code = np.zeros((n, parts), np.int64)
            self.upper, self.lower = np.full((n, parts), np.inf, FLOAT), np.zeros((n, parts, entries), FLOAT)

    def shift(self, moved: np.ndarray) -> None:
        """Entries have moved by so much, [part, entry]."""
        own = moved[np.arange(moved.shape[0]), self.code].astype(np.float64)
        self.upper = above(self.upper + own)
        self.lower = below(self.lower.astype(np.float64) - moved)

    def assign(self, books: np.ndarray) -> int:
        return sum(reassigned(self.x[:, p], books[p], self.code[:, p], self.upper[:, p], self.lower[:, p]) for p in range(len(books)))

    def error(self, books: np.ndarray) -> np.ndarray:
        """Squared distances to the own entries, summed over the parts."""
        return squared(self.x, books[np.arange(len(books)), self.code]).sum(axis=1)


def assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """rows with codes and bounds as of these codebooks, and `error`, the squared distance that the codes leave."""
    parts, entries, step = books.shape
    sent = rows.sparkSession.sparkContext.broadcast((books, moved))
    keep = [f for f in rows.schema if f.name not in ("code", "upper", "lower", "error")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", code binary, upper binary, lower binary, error bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = sent.value
        for b in batches:
            if b.num_rows:
                s = State(b, parts, step, entries)
                if moved is not None:
                    s.shift(moved)
                s.assign(books)
                packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (s.code.astype(np.uint8), s.upper, s.lower)]
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], *packed, pa.array(s.error(books))], [*[f.name for f in keep], "code", "upper", "lower", "error"])

    return rows.mapInArrow(run, schema)


def means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks' entries moved to the floors of their parts' means; those without parts stay."""
    parts, entries, step = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, step), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            if b.num_rows:
                x = grid(b.column("x"), parts * step).reshape(b.num_rows, parts, step)
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, parts)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], x[:, p])
                    n[p] += np.bincount(code[:, p], minlength=entries)
        part, entry, place = np.nonzero(np.broadcast_to(n[:, :, None] > 0, total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(total[part, entry, place]), pa.array(n[part, entry])], ["part", "entry", "place", "total", "n"])

    sums = rows.select("x", "code").mapInArrow(run, "part int, entry int, place int, total bigint, n bigint").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():  # a row a component of the codebooks
        out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def digest(books: np.ndarray) -> str:
    """Of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (binary, one entry's index a part) and error of every row, and the codebooks [part, entry, position].

    Rows with a null vector, or with a component that is null or not finite, are dropped. Codebooks start as the parts of
    the `entries` rows with the smallest vec_ids (ties by vector; null ids last), or of all if there are fewer. Vectors
    are filled up with zeros to one length that the parts divide. Rows that repeat an id or a vector are rows like others;
    other columns may have any name; an empty table gives no rows and codebooks without entries. `label` is null where the
    table has none. At most 256 entries. Components too large for squared distances of 64 bits raise an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    small_batches(spark)
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    found, width, _ = floored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col(vector).alias("v")), scale, "v", "integers")
    rows = found.drop("v", "row")
    step = -(-width // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow()
    books = grid(first.column("x"), parts * step).reshape(first.num_rows, parts, step).transpose(1, 0, 2).copy()
    if not first.num_rows:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), books
    state, moved = rows, None
    for _ in range(rounds):
        before, state = state, written(assigned(state, books, moved), "bounds")
        if before is not rows:
            unwritten(before)
        new = means(state, books)
        moved, books = above(np.sqrt(squared(books, new))).astype(np.float64), new
    out = written(assigned(state, books, moved).select("vec_id", "label", "code", "error"), "codes")
    if state is not rows:
        unwritten(state)
    return out, books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, what they leave, by row and by label, and a digest of the codebooks."""
    rows, books = compressed(table(spark, sf_dir, "embeddings"))
    by_label = small(written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels"))
    both = rows.alias("r").join(by_label.alias("l"), F.col("r.label").eqNullSafe(F.col("l.label")))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql() -> str:
    """The rounds written out; distance * ENTRIES + index is least for the nearest entry, ties to the lower index."""
    squares = "coalesce(list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0)::bigint"
    ctes = [
        f"v as materialized (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"w as materialized (select ceil(max(len(x)) / {PARTS})::bigint as n from v)",
        f"f as materialized (select r, vec_id, label, x || list_transform(range({PARTS} * n - len(x)), lambda i: 0::bigint) as x from v, w)",
        f"p as materialized (select r, part, x[part * n + 1 : part * n + n] as c from f, w, range({PARTS}) as t(part))",
        f"first as (select r, row_number() over (order by vec_id nulls last, x) - 1 as entry from f qualify entry < {ENTRIES})",
        "b0 as materialized (select part, entry, c from first join p using (r))",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(f"a{k} as materialized (select p.r, p.part, min({squares} * {ENTRIES} + b.entry) as best from p join b{k} as b using (part) group by all)")
        if k < ROUNDS:
            ctes.append(f"s{k} as (select a.part, a.best % {ENTRIES} as entry, i as place, sum(p.c[i]) as s, count(*) as n from a{k} as a join p using (r, part), w, range(1, w.n + 1) as t(i) group by all)")
            ctes.append(f"m{k} as (select part, entry, list(((s - ((s % n) + n) % n) // n)::bigint order by place) as c from s{k} group by all)")
            ctes.append(f"b{k + 1} as materialized (select b.part, b.entry, coalesce(m.c, b.c) as c from b{k} as b left join m{k} as m using (part, entry))")
    last = ROUNDS
    ctes.append(f"e as (select r, string_agg(printf('%02x', best % {ENTRIES}), '' order by part) as code, sum(best // {ENTRIES})::bigint as error from a{last} group by r)")
    ctes.append(f"h as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as d from b{last})")
    return "with " + ",\n".join(ctes) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h.d as codebooks_sha256 from f join e using (r), h"
