"""Sitemaps, robots rules and link graphs; a paged data source."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from itertools import islice, takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import robots_allowed
from . import paged
from .shared import written


def crawl(edges: DataFrame, start: DataFrame, depth: int, most: int) -> DataFrame:
    """url, depth of what `depth` steps along edges (src, dst) reach from start (url), the `most` nearest (ties by URL).

    Breadth first: each round joins the frontier only, leaves out what was seen and is written, so no round is computed
    twice; the walk ends early where nothing new is met. Rows beyond the `most` nearest go by a sort, not on the driver.
    """
    front = seen = written(start.select("url").distinct().withColumn("depth", F.lit(0)), "crawl")
    for d in range(1, depth + 1):
        met = edges.join(front.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        front = written(met.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)), "crawl")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen if seen.count() <= most else seen.orderBy("depth", "url").limit(most)


#: Paths that a crawl does not follow: fixed values.
UTILITY = "cart|checkout|account|login|signin|search"
#: A whole anchor tag, and its target.
_TAG, _HREF = r"(?i)<a\s[^<>]*", r"""(?is)^.*?\shref\s*=\s*["']?([^"'\s<>]*)"""


def address(url: Column) -> Column:
    """host and path of a URL without scheme, port, query, fragment and last slash: what a page is known by."""
    rest = F.regexp_replace(F.regexp_replace(url, "(?i)^[a-z][a-z0-9+.-]*://", ""), r"[?#].*$", "")
    return F.concat(F.lower(F.regexp_replace(F.regexp_extract(rest, "^[^/]*", 0), ":[0-9]*$", "")), F.regexp_replace(F.regexp_extract(rest, "/.*$", 0), "/+$", ""))


def host_part(at: Column) -> Column:
    return F.regexp_extract(at, "^[^/]*", 0)


def path_part(at: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(at, "/.*$", 0), F.lit("")), F.lit("/"))


def page_links(pages: DataFrame) -> DataFrame:
    """src, dst: addresses of pages (url, html) and of what their anchors name on the same host, absolute or from the root."""
    tags = F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0)))
    each = pages.where(F.col("html").isNotNull() & F.col("url").isNotNull()).select(address(F.col("url")).alias("src"), tags.alias("tag"))
    href = F.regexp_extract("tag", _HREF, 1)
    dst = F.when(href.rlike("(?i)^https?://"), address(href)).when(href.rlike("^//"), address(F.concat(F.lit("http:"), href))).when(href.startswith("/"), F.concat(host_part(F.col("src")), address(F.concat(F.lit("http://h"), href)).substr(F.lit(2), F.lit(1 << 20))))
    return each.select("src", dst.alias("dst")).where(F.col("dst").isNotNull() & (host_part(F.col("dst")) == host_part(F.col("src"))) & (F.col("src") != F.col("dst"))).distinct()


def listings(pages: DataFrame) -> DataFrame:
    """src, dst: every address above a page on its host, and the page: what a listing there leads on to."""
    at = pages.where(F.col("url").isNotNull()).select(address(F.col("url")).alias("dst"))
    steps = F.split(F.regexp_replace(path_part(F.col("dst")), "^/", ""), "/")
    above = F.transform(F.when(F.size(steps) > 1, F.sequence(F.lit(1), F.size(steps) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.concat(host_part(F.col("dst")), F.lit("/"), F.array_join(F.slice(steps, 1, n), "/")))
    return at.select(F.explode(above).alias("src"), "dst").distinct()


def crawl_sites(edges: DataFrame, start: DataFrame, rules: DataFrame, depth: int, most: int, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """url, depth of what a walk along edges (src, dst: addresses) reaches from start (url), the `most` nearest of each host (ties by URL).

    rules: site, allow, disallow, of robots files. Paths that a rule forbids, that are a shop's own business, that
    `exclude` fits or `include` does not are not walked. Edges stay on their host, so what a host has beyond its quota
    leads to nothing within it, and a host that is full is left alone. Each round is written.
    """
    allowed = F.lit(True) if include is None else F.col("dst").rlike(f"(?i){include}")
    denied = F.lit(False) if exclude is None else F.col("dst").rlike(f"(?i){exclude}")
    none = F.array().cast("array<string>")
    ways = edges.where(allowed & ~denied & ~path_part(F.col("dst")).rlike(f"(?i){UTILITY}")).withColumn("site", host_part(F.col("dst"))).join(rules.select("site", "allow", "disallow"), "site", "left")
    ways = written(ways.where(robots_allowed(path_part(F.col("dst")), F.coalesce("allow", none), F.coalesce("disallow", none))).select("src", "dst"), "ways")
    by_host = W.Window.partitionBy("host").orderBy("depth", "url")

    def within(df: DataFrame) -> DataFrame:
        """The first `most` of each host; of a host of any size tasks keep no more than these."""
        return df.withColumn("n", F.row_number().over(by_host)).where(F.col("n") <= most)

    first = start.select("url").distinct().select("url", F.lit(0).alias("depth"), host_part(F.col("url")).alias("host"))
    front = seen = written(within(first).drop("n"), "crawl")
    for d in range(1, depth + 1):
        full = seen.groupBy("host").agg(F.count("*").alias("held")).where(F.col("held") >= most)
        met = ways.join(front.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        new = met.join(seen, "url", "left_anti").select("url", F.lit(d).alias("depth"), host_part(F.col("url")).alias("host")).join(full, "host", "left_anti")
        front = written(within(new).select("url", "depth", "host"), "crawl")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return within(seen).select("url", "depth", "host")


def robots(files: DataFrame, text: str = "text") -> DataFrame:
    """Per file: allow and disallow rules for all agents, and sitemaps, in order. files: site, text."""
    lines = files.select("site", F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*", "")))
    each = lines.select("site", "pos", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value")).where("value <> ''")
    agent = F.last(F.when(F.col("key") == "user-agent", F.lower("value")), ignorenulls=True).over(W.Window.partitionBy("site").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0))
    own = each.withColumn("agent", agent)
    rules = lambda key: F.transform(F.array_sort(F.collect_list(F.when((F.col("key") == key) & ((F.col("agent") == "*") | (key == "sitemap")), F.struct("pos", "value")))), lambda x: x["value"]).alias(key)
    return own.groupBy("site").agg(rules("allow"), rules("disallow"), rules("sitemap"))


def checkpoint_outcomes(lines: DataFrame, retry_failed: bool = True) -> DataFrame:
    """sheet, row, outcome: the last outcome of every row in a log of JSON lines (pos, value); broken lines count for nothing."""
    each = lines.select("pos", F.from_json("value", "sheetName string, rowNumber int, outcome string").alias("e")).where("e.rowNumber is not null")
    if retry_failed:
        each = each.where("e.outcome <> 'failed'")
    return each.groupBy(F.coalesce("e.sheetName", F.lit("")).alias("sheet"), F.col("e.rowNumber").alias("row")).agg(F.max_by("e.outcome", "pos").alias("outcome"))


def retried(call: Callable[[], object], tries: int = 9, first: float = 1.0, most: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """call's result, after up to `tries` attempts with waits that double from `first` to `most` seconds."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i + 1 == tries:
                raise
            sleep(min(most, first * 2**i))
    raise ValueError("no tries")


class _Pages(InputPartition):
    """Rows `at` to `end` of a catalog, and the row groups that hold them, if it is a table."""

    def __init__(self, at: int, end: int, groups: Sequence[paged.Rows] = ()):
        super().__init__(at)
        self.at, self.end, self.groups = at, end, groups


def page_after(rows: DataFrame, key: str, cursor: object | None, size: int = 50) -> DataFrame:
    """The page of rows that follows a stored cursor, in order of the key; the first one without a cursor."""
    left = rows if cursor is None else rows.where(F.col(key) > F.lit(cursor))
    return left.orderBy(key).limit(size)


class PagedReader(DataSourceReader):
    """Runs of a catalog's pages as partitions; each is fetched, with retries, by the task that reads it, and reads no other's rows.

    A client stands behind `path`: a file of JSON lines, or Parquet (named so) in order of the column that `key` names.
    """

    def __init__(self, options: dict):
        self.path, self.total, self.page = options["path"], int(options["total"]), int(options.get("page", 50))
        self.key, self.title = options.get("key", "id"), options.get("title", "title")
        self.table = None if not self.path.endswith(".parquet") else paged.PageStream({"path": self.path, "page": self.page, "columns": f"{self.key},{self.title}"})

    def partitions(self) -> Sequence[InputPartition]:
        """Eight runs at least where there are as many pages, and none of more than 50,000 rows but for one page's."""
        pages = -(-self.total // self.page)
        run = self.page * max(1, min(-(-pages // 8), 50_000 // self.page))
        groups = [] if self.table is None else self.table.between(0, self.total)
        out, first = [], 0
        for at in range(0, self.total, run):
            end = min(at + run, self.total)
            while first < len(groups) and groups[first].at + groups[first].end - groups[first].start <= at:
                first += 1
            own = list(takewhile(lambda g: g.at < end, islice(groups, first, None)))  # noqa: B023
            out.append(_Pages(at, end, [replace(g, start=g.start + max(0, at - g.at), end=min(g.end, g.start + end - g.at), at=max(at, g.at)) for g in own]))
        return out

    def read(self, partition: _Pages) -> Iterator[tuple]:
        import json

        def fetch() -> list[dict]:  # stands for the requests of a run
            if self.table is not None:
                batches = [b for g in partition.groups for b in self.table.read(g)]
                return [r for b in batches for r in b.drop_columns("page").rename_columns(["id", "title"]).to_pylist()]
            with open(self.path, encoding="utf-8") as f:
                return [json.loads(line) for line in islice(f, partition.at, partition.end)]

        for i, item in enumerate(retried(fetch), partition.at):
            yield (str(item.get("id", "")), str(item.get("title", "")), json.dumps(item, sort_keys=True), i // self.page)


class PagedCatalog(DataSource):
    """spark.dataSource.register(PagedCatalog); read with format("paged_catalog") and options path, total, page."""

    @classmethod
    def name(cls) -> str:
        return "paged_catalog"

    def schema(self) -> str:
        return "id string, title string, raw string, page int"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def complete(items: DataFrame, total: int) -> DataFrame:
    """items, or an error when their number is not the total that the source named."""
    n = items.count()
    if n != total:
        raise ValueError(f"the source names {total} items and gave {n}")
    return items
