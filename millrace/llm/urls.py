"""URL filters: host and path rules first, link-graph propagation for what they leave open.

Trust starts at hosts by their share of pages that rules allow and follows links; distrust starts at hosts by their
share of blocked pages and follows links backwards, so that linking to blocked hosts taints. Both are personalised
PageRank over the graph of hosts, with edges weighted by their number of links, in one loop. A host is blocked if
its distrust is at least RATIO times its trust and reaches a FLOOR. DataFrame operations only; no page leaves its partition but for the
sums by host and by pair of hosts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unwritten, written

#: (verdict, host, path); a rule fits its host and all subdomains whose path starts with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, TOLERANCE, RATIO = 0.85, 1e-6, 2.0
#: A host is blocked only with so large a part of the distrust that an average host of blocked seeds starts with: far from all
#: seeds, or one link in thousands, is no ground.
FLOOR = 0.05
#: Rounds that the SQL writes out, which is whole only where hosts are not linked.
ROUNDS = 10
#: Rounds in which ranks must have settled: about 90, and one for each link of the longest way from a seed.
MOST_ROUNDS = 1000
#: An anchor's tag, up to its end or the next tag's begin, so that no character is read for two tags.
TAG = r"(?i)<a\s[^<>]*"
#: Absolute and protocol-relative targets in a tag; group 1 is the host, up to a path, query, fragment or quote.
ANCHOR = r"""(?is)^.*?\shref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<verdict,rule> of the longest fitting rule, null without one."""
    longest = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in longest]
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for (verdict, h, p), fit in reversed(list(zip(longest, fits, strict=True))):
        out = F.when(fit, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path and the rule's struct; a null url or one without :// has empty host and path."""
    url = F.coalesce("url", F.lit(""))
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    return parts.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from seeds (host, trust, distrust: starting shares) over edges (src, dst, links).

    Trust runs from src to dst, distrust from dst to src. Ends when no value moves by more than `tolerance` of itself,
    however small it is, so every host that a seed reaches has its rank, and raises if MOST_ROUNDS do not get there.
    With `rounds` it ends after as many instead. Each round is written, as the next one reads it twice.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "links").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "links")
    )
    out = both.groupBy("kind", "from").agg(F.sum("links").alias("all"))
    both = written(both.join(out, ["kind", "from"]).select("kind", "from", "to", (F.col("links") / F.col("all")).alias("share")), "edges")
    start = written(
        seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "start")).where("start > 0"),
        "seeds",
    )
    rank, last = start.select("kind", "host", F.col("start").alias("value")), None
    for _ in range(MOST_ROUNDS if rounds is None else rounds):
        moved = both.join(rank, (both["kind"] == rank["kind"]) & (both["from"] == rank["host"])).select(both["kind"], F.col("to").alias("host"), (F.col("share") * F.col("value") * damping).alias("value"))
        began = start.select("kind", "host", (F.col("start") * (1 - damping)).alias("value"))
        new = written(moved.unionByName(began).groupBy("kind", "host").agg(F.sum("value").alias("value")), "rank")
        change = new.withColumn("by", F.col("value")).unionByName(rank.select("kind", "host", F.lit(0.0).alias("value"), (-F.col("value")).alias("by")))
        moves = change.groupBy("kind", "host").agg(F.sum("value").alias("value"), F.abs(F.sum("by")).alias("by"))
        unsettled = moves.where(F.col("by") > tolerance * F.col("value")).limit(1).count()
        if last is not None:
            unwritten(last)
        rank = last = new
        if not unsettled:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks did not settle in {MOST_ROUNDS} rounds")
    either = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(either("trust"), either("distrust"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links between different hosts, summed before the shuffle."""
    tags = F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0)))
    links = pages.where("html is not null and host <> ''").select(F.col("host").alias("src"), tags.alias("tag"))
    to = F.translate(F.regexp_extract("tag", ANCHOR, 1), UPPER, LOWER)
    return links.select("src", to.alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def filtered(pages: DataFrame, rules=RULES, ratio: float = RATIO, floor: float = FLOOR, damping: float = DAMPING, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    Hosts that no seed reaches are allowed, and those with less distrust than `floor` times what an average host of blocked
    seeds starts with. Repeated rows are judged each; null html has no links; long pages are searched whole.
    """
    each = judged(pages, rules)
    said = each.where("by_rule is not null and host <> ''").groupBy("host").agg(*[F.count_if(F.col("by_rule.verdict") == v).cast("double").alias(k) for v, k in (("allow", "trust"), ("block", "distrust"))])
    total = said.agg(F.sum("trust").alias("all_trust"), F.sum("distrust").alias("all_distrust"), F.count_if(F.col("distrust") > 0).alias("n_distrusted"))
    share = lambda k: F.coalesce(F.col(k) / F.nullif(F.col(f"all_{k}"), F.lit(0.0)), F.lit(0.0)).alias(k)
    total = F.broadcast(written(total, "totals"))  # one row
    seeds = said.crossJoin(total).select("host", share("trust"), share("distrust"))
    ranks = propagate(seeds, host_edges(each), damping=damping, **how).crossJoin(total.select((floor * (1 - damping) / F.nullif("n_distrusted", F.lit(0))).alias("least")))
    blocked = ranks.select("host", "trust", "distrust", F.when((F.col("distrust") > 0) & (F.col("distrust") >= ratio * F.col("trust")) & (F.col("distrust") >= F.col("least")), "block").otherwise("allow").alias("by_graph"))
    return each.drop("html").join(blocked, "host", "left").select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", "by_graph", F.lit("allow")).alias("verdict"), "trust", "distrust"
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's URL."""
    return filtered(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def sql(rules=RULES, ratio: float = RATIO, floor: float = FLOOR, damping: float = DAMPING, rounds: int = ROUNDS) -> str:
    """The same in SQL, with all rounds written out."""
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    longest = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    case = lambda pick: "case " + " ".join(f"when {fits(h, p)} then '{pick(v, h + p)}'" for v, h, p in longest) + " end"
    anchor = ANCHOR.replace("'", "''")
    target = f"lambda t: translate(regexp_extract(t, '{anchor}', 1), '{UPPER}', '{LOWER}')"
    steps = reduce(lambda ctes, i: [*ctes, f"""r{i} as (select kind, host, sum(value) as value from (
        select e.kind, e.dst as host, e.share * r.value * {damping} as value from e join r{i - 1} r on r.kind = e.kind and r.host = e.src
        union all select kind, host, value * {1 - damping} from r0) group by 1, 2)"""], range(1, rounds + 1), [])  # fmt: skip
    return f"""with u as (select page_id, html, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    p as (select page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
    j as (select *, {case(lambda v, r: r)} as rule, {case(lambda v, r: v)} as said from p),
    s as (select host, sum(case when said = 'allow' then 1.0 else 0.0 end)::double as t, sum(case when said = 'block' then 1.0 else 0.0 end)::double as d from j where said is not null and host <> '' group by 1),
    links as (select host as src, unnest(list_transform(regexp_extract_all(html, '{TAG}', 0), {target})) as dst from j where html is not null and host <> ''),
    g as (select src, dst, count(*)::double as n from links where dst <> '' and src <> dst group by 1, 2),
    b as (select 'trust' as kind, src, dst, n from g union all select 'distrust', dst, src, n from g),
    e as (select kind, src, dst, n / sum(n) over (partition by kind, src) as share from b),
    r0 as (select 'trust' as kind, host, t / (select sum(t) from s) as value from s where t > 0 union all select 'distrust', host, d / (select sum(d) from s) from s where d > 0),
    {", ".join(steps)},
    k as (select host, coalesce(sum(case when kind = 'trust' then value end), 0) as t, coalesce(sum(case when kind = 'distrust' then value end), 0) as d from r{rounds} group by 1)
    select page_id, j.host, path, rule, coalesce(said, case when d > 0 and d >= {ratio} * t and d >= {floor * (1 - damping)} / (select count(*) from s where s.d > 0) then 'block' else 'allow' end) as verdict from j left join k on k.host = j.host"""
