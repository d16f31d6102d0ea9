"""Jobs of the sync: which requests start one, which interrupted ones run again, and the resumable scan of a catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources import paged, sinks
from ..streaming.stateful import Fold

# The types of job that are taken up again, and the one of which a product needs only one.
RECOVERABLE = ("PUBLISH_TO_SHOPIFY", "REPUBLISH_TO_SHOPIFY", "SYNC_PRODUCT", "SYNC_INVENTORY", "SYNC_PRICE_STOCK", "SYNC_PRICE_STOCK_BATCH", "SYNC_FULL_CATALOG_BATCH")
ONCE_A_PRODUCT = "SYNC_PRODUCT"


def single_flight(wait_seconds: int) -> Fold:
    """job, joined of every request: it joins the key's job if that was begun within the wait and still runs, else begins one.

    Rows: event_id, seconds (what a job that the request begins takes; null: it never ends). A job whose wait is over is
    left to itself, as its lock is stale.
    """

    def step(state: tuple, us: int, row: tuple) -> tuple[tuple, tuple]:
        job, began, ends = state
        if job is not None and us <= began + wait_seconds * 1_000_000 and (ends is None or us < ends):
            return state, (row[0], job, True)
        return (row[0], us, None if row[1] is None else us + int(row[1] * 1_000_000)), (row[0], row[0], False)

    return Fold("event_id bigint, seconds double", "job bigint, began bigint, ends bigint", "event_id bigint, job bigint, joined boolean", (None, None, None), step)


def recovered(jobs: DataFrame, now: Column, stale_minutes: int = 10, limit: int = 50) -> DataFrame:
    """job, status of the oldest jobs that were interrupted: `pending` ones run again, `completed` ones repeat another's product.

    jobs: job, type, status, product, created, started. Interrupted are jobs that wait, and those that have run for
    `stale_minutes` or longer, or from no known time. Of a product's jobs of the type that it needs only once the oldest runs.
    """
    stale = F.col("started").isNull() | (F.col("started") <= now - F.make_interval(mins=F.lit(stale_minutes)))
    found = jobs.where(F.col("type").isin(*RECOVERABLE) & ((F.col("status") == "pending") | ((F.col("status") == "running") & stale)))
    oldest = found.orderBy("created", "job").limit(limit)
    product = F.coalesce(F.trim("product"), F.lit(""))
    once = (F.col("type") == ONCE_A_PRODUCT) & (product != "")
    nth = F.row_number().over(W.Window.partitionBy(F.when(once, product).otherwise(F.concat(F.lit("job "), F.col("job").cast("string")))).orderBy("created", "job"))
    return oldest.withColumn("nth", nth).select("job", F.when(once & (F.col("nth") > 1), "completed").otherwise("pending").alias("status"))


class CatalogJob:
    """A scan of a paged catalog into an index table: it can be stopped after any page and goes on with the next one.

    Each batch of pages is judged against the links and the sheets and upserted under its number; once all pages are read,
    `finish` drops what this scan has not seen, and refuses if not all have been.
    """

    def __init__(self, spark: SparkSession, path: str, catalog: str, columns: str, schema: str, index: paged.UpsertTable, scan: str, page: int = 50):
        self.spark, self.path, self.index, self.scan = spark, path, index, scan
        spark.dataSource.register(paged.PagedStream)
        self.schema, self.options = f"{schema}, page int", {"path": catalog, "columns": columns, "page": str(page)}

    def run(self, judge: Callable[[DataFrame], DataFrame], pages: int | None = None) -> None:
        """Reads on, up to so many pages in all; judge gives a batch's index rows, but for scan."""

        def keep(df: DataFrame, number: int) -> None:
            self.index.upsert(judge(df).withColumn("scan", F.lit(self.scan)), number)

        until = {} if pages is None else {"until": str(pages)}
        source = self.spark.readStream.format("paged_stream").schema(self.schema).options(**self.options, **until)
        source.load().writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.path}/scan").trigger(availableNow=True).start().awaitTermination()

    def finish(self, expected: int) -> DataFrame:
        """The index without rows of earlier scans."""
        seen = self.index.rows().where(F.col("scan") == self.scan)
        if (n := seen.count()) != expected:
            raise ValueError(f"the scan has seen {n} of {expected}")
        return sinks.without_unseen(self.index.rows(), F.lit(self.scan), "scan")


def judged(products: DataFrame, links: DataFrame, sheet: DataFrame) -> DataFrame:
    """product, status, method, url of products (product, vendor, title) against links and a sheet's rows.

    links: product, url, active: a linked product is `active` or `linked`, whatever the sheets say. sheet: vendor, title,
    url: another product is matched if the rows of its vendor and title name one URL, needs a review if they name several
    or if that URL is another product's, and else a link.
    """
    fine = sheet.where((F.col("vendor") != "") & (F.col("title") != ""))
    named = fine.groupBy("vendor", "title").agg(F.count_distinct("url").alias("urls"), F.min("url").alias("sheet_url"))
    owners = links.groupBy(F.col("url").alias("sheet_url")).agg(F.min("product").alias("owner"))
    mine = links.select("product", F.col("url").alias("own_url"), "active")
    each = products.join(mine, "product", "left").join(named, ["vendor", "title"], "left").join(owners, "sheet_url", "left")
    linked, one = F.col("own_url").isNotNull(), F.coalesce(F.col("urls") == 1, F.lit(False))
    taken = one & F.coalesce(F.col("owner") != F.col("product"), F.lit(False))
    status = F.when(linked, F.when(F.col("active"), "active").otherwise("linked")).when(taken | (F.col("urls") > 1), "needs_review").when(one, "matched").otherwise("needs_link")
    method = F.when(linked, "database").when(taken, "conflict").when(F.col("urls") > 1, "ambiguous").when(one, "title_vendor").otherwise("none")
    return each.select("product", status.alias("status"), method.alias("method"), F.when(linked, F.col("own_url")).when(one & ~taken, F.col("sheet_url")).alias("url"))
