"""Secret scans: an Aho-Corasick keyword pass, anchored patterns near its hits, then embedded checksums.

Keywords are found in one pass of the automaton; a pattern is tried only at a hit, leftmost first, and a hit
inside an earlier match of its kind is passed over, so the matches are those of a plain left-to-right search.
Hexadecimal runs have no keyword: a run of 16 covers four samples taken every fourth character, so only places
with four hexadecimal samples in a row are read. Provider tokens count only if the checksum at their end holds, and web
tokens only if their first part decodes to a JSON header.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, small_batches, table

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "checked", "key", "jwt")
#: The kinds that have no check of their own: the contract's.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY(?: BLOCK)?-----")
PART = re.compile(r"[A-Za-z0-9_-]*+")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC-32 of body as six digits of base 62, as token issuers append it."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def json_header(part: str) -> bool:
    """Whether a token's first part, decoded, is a JSON object that names an algorithm."""
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except ValueError:
        return False


def automaton():
    import ahocorasick

    words = ahocorasick.Automaton()
    for kind, keys in ((0, ASSIGN_WORDS), (1, ("akia",)), (3, CHECKED_WORDS), (4, ("-----begin ",)), (5, ("eyj",))):
        for key in keys:
            words.add_word(key, (kind, len(key)))
    words.make_automaton()
    return words


def hex_runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of every longest run of MIN_HEX or more of 0-9a-f."""
    if len(text) < MIN_HEX:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sample = codes[::4]
    ok = ((sample >= 48) & (sample <= 57)) | ((sample >= 97) & (sample <= 102))
    near = np.flatnonzero(ok[:-3] & ok[1:-2] & ok[2:-1] & ok[3:]) * 4
    found, past = [], 0
    for at in near.tolist():
        if at < past:
            continue
        start = at
        while start > past and text[start - 1] in "0123456789abcdef":
            start -= 1
        past = HEX_RUN.match(text, start).end()
        if past - start >= MIN_HEX:
            found.append((start, past))
    return found


HEX_RUN = re.compile(r"[0-9a-f]+")


def spans(text: str | None, words) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kind is an index of KINDS."""
    if not text:
        return []
    # U+0130 is the only character whose lower case has another length; it is in no keyword.
    low = text.lower() if "İ" not in text else text.replace("İ", "I").lower()
    found: list[tuple[int, int, int]] = []
    past = [0] * len(KINDS)
    hits = sorted((end - n + 1, kind) for end, (kind, n) in words.iter(low))
    for at, kind in hits:
        if at < past[kind]:
            continue
        if kind == 0 and (m := ASSIGN.match(text, at)):
            past[0] = m.end()
            if len(m[2]) >= MIN_VALUE:
                found.append((at, 0, m.end()))
        elif kind == 1 and (m := ACCESS.match(text, at)):
            past[1] = m.end()
            if m.end() - at >= MIN_ACCESS:
                found.append((at, 1, m.end()))
        elif kind == 3 and (m := CHECKED.match(text, at)):
            past[3] = m.end()
            if base62_crc(m[2]) == m[3]:
                found.append((at, 3, m.end()))
        elif kind == 4 and (m := KEY.match(text, at)):
            found.append((at, 4, m.end()))
        elif kind == 5:
            # whatever starts later in this part ends where it ends
            m = JWT.match(text, at)
            past[5] = m.end() if m else PART.match(text, at).end()
            if m and json_header(m[1]):
                found.append((at, 5, m.end()))
    found += [(start, 2, end) for start, end in hex_runs(text)]
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and spans array<struct<kind,start,end>> of every row's whole text.

    A null text is an empty one; repeated rows are scanned each; other columns are left out; a text of any length is
    scanned whole, in one pass of the automaton.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in pieces(batches):
            found = [[{"kind": KINDS[k], "start": a, "end": z} for a, k, z in spans(t, words)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["key", "spans"])

    small_batches(docs.sparkSession)
    plain = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return plain.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, with counts and digests of the base kinds."""
    return spark_digest(scan(table(spark, sf_dir, "documents")))


def spark_digest(found: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    def text(s):
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs without the rows that hold a secret; columns stay."""
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for part in pieces(batches, at):
            yield part.filter(pa.array([not spans(t, words) for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    """The base spans by plain searches, for tests."""
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= MIN_VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= MIN_ACCESS]
    return sorted(out + [(m.start(), 2, m.end()) for m in HEX_RUN.finditer(t) if len(m[0]) >= MIN_HEX])


def digest(found: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined(found).encode()).hexdigest()
