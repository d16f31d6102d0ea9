"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell of source, language and topic. The cells' weights are raked to the target shares of each
margin in turn until all hold, with no document drawn more often than allowed: cells at that bound are fixed and the
others raked on. A document is drawn with its cell's calibrated probability by a digest of its id, so a rerun draws
the same. Values without a target of their own share one cell each ("other"), so the number of
cells is bounded by the targets given, not by the data, and the fit runs on the driver.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, table

OTHER = "other"
MARGINS = ("source", "lang", "topic")
#: Sweeps of a fit at most, and the change of a weight below which it has settled; targets that exclude one another never
#: do, and are reported. LEAST and its inverse bound the factors of those.
MOST_SWEEPS, SETTLED, LEAST = 5000, 1e-13, 1e-100

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Targets:
    """Wanted share of tokens by value of each margin.

    Values that no target names are "other" together. Its share, unless given, is what the named ones leave; where they
    leave nothing it keeps its natural share of the tokens and the named ones divide the rest, so no unlabelled source
    is lost unless "other" is given 0. Within a cell all values are drawn at one rate.
    """

    source: dict[str, float] = field(default_factory=lambda: {"src0": 0.12, "src1": 0.1, "src2": 0.08, "src3": 0.08, "src4": 0.06, "src5": 0.06, "src6": 0.05, "src7": 0.05, "src8": 0.04, "src9": 0.03})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1})
    topic: dict[str, float] = field(default_factory=lambda: {"prose": 0.88, "tabular": 0.08, "legal": 0.03, "noise": 0.01})
    #: Share of all tokens to draw.
    budget: float = 0.5
    #: Times that a document may be drawn at most; a bound of the fit.
    repeats: int = 4
    #: Sweeps that the SQL writes out; the fit here runs until it has settled.
    sweeps: int = 40

    def shares(self, margin: str) -> dict[str, float]:
        own = getattr(self, margin)
        return own | ({OTHER: max(0.0, 1 - sum(own.values()))} if OTHER not in own else {})


def n_words(text: Column) -> Column:
    """Tokens as the mix weighs them where documents bring no count: longest runs without a space, tab or line end."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[^ \t\r\n]+")).cast("long")


#: A topic's marks, and the words of text to each mark with which a text is of the topic.
TOPICS = {"tabular": ((" | ",), 10), "noise": (("!!",), 10), "legal": (("icens", "icenc", "opyright", "ICENS", "ICENC", "OPYRIGHT"), 400)}


def topic_of(text: Column, words: Column) -> Column:
    """What a text of so many words is mostly about, where documents bring no topic: rows of cells, shouting, licences, prose."""
    t = F.coalesce(text, F.lit(""))
    count = lambda mark: (F.octet_length(t) - F.octet_length(F.replace(t, F.lit(mark), F.lit("")))) / len(mark)
    out = F.lit("prose")
    for topic, (marks, most) in reversed(TOPICS.items()):
        n = reduce(Column.__add__, map(count, marks))
        out = F.when(n * most >= F.greatest(words, F.lit(1)), topic).otherwise(out)  # some marks, and enough; n stands here once, as it reads the text
    return out


def _named(value: Column, names: list[str]) -> Column:
    """value if it is one of the names, else "other"; value stands here once, as a topic's reads the whole text."""
    known = F.create_map(*[F.lit(x) for k in names for x in (k, k)]) if names else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, value), F.lit(OTHER))


def in_cells(docs: DataFrame, targets: Targets) -> DataFrame:
    """docs with _source, _lang, _topic (their values, or "other") and _tokens.

    Columns topic and n_tokens (say, of the token counts' operator) are used where there are such.
    """
    # words are counted below, once, and only where a column does not say what they are counted for
    if not {"topic", "n_tokens"} <= set(docs.columns):
        docs = docs.withColumn("_words", n_words(F.col("text")))
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(F.col("text"), F.col("_words"))
    tokens = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)) if "n_tokens" in docs.columns else F.col("_words")
    own = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    named = {f"_{m}": _named(c, [k for k in getattr(targets, m) if k != OTHER]) for m, c in own.items()}
    return docs.withColumns(named | {"_tokens": tokens})


def _factor(pairs: list[tuple[float, float]], want: float) -> float:
    """The factor f with sum(min(most, f * x)) = want over pairs (x, most); the least that fills all if want is beyond their sum."""
    full, rest = 0.0, sum(x for x, _ in pairs)
    for x, most in sorted(pairs, key=lambda p: p[1] / p[0]):  # in the order in which they reach their bound
        f = (want - full) / rest
        if f * x <= most:
            return max(0.0, f)
        full, rest, last = full + most, rest - x, most / x
    return last


def wanted(cells: dict[tuple[str, str, str], float], targets: Targets, margin: str) -> dict[str, float]:
    """Target shares of a margin, with the natural one for "other" where the named values leave it none."""
    shares = targets.shares(margin)
    if OTHER in getattr(targets, margin) or shares[OTHER] > 1e-9:
        return shares
    natural = sum(n for c, n in cells.items() if c[MARGINS.index(margin)] == OTHER) / (sum(cells.values()) or 1.0)
    return {v: x * (1 - natural) for v, x in shares.items()} | {OTHER: natural}


def goals(shares: dict[str, float], room: dict[str, float]) -> dict[str, float]:
    """A margin's shares of its values that sum to 1, none above its room; what has no room is spread over the others' shares."""
    want, full = {v: shares.get(v, 0.0) for v, x in room.items() if x > 0}, {}
    while (scale := sum(want.values())) > 0:
        left = max(0.0, 1 - sum(full.values()))
        if not (over := [v for v, x in want.items() if x * left / scale > room[v]]):
            return full | {v: x * left / scale for v, x in want.items()}
        full |= {v: room[v] for v in over}
        want = {v: x for v, x in want.items() if v not in full}
    return full | want


def rake(cells: dict[tuple[str, str, str], float], targets: Targets, most: dict[tuple[str, str, str], float] | None = None) -> dict[tuple[str, str, str], float]:
    """Weights of the cells, summing to 1, whose margins are the targets' as far as the cells allow.

    No weight exceeds its cell's `most`: the cells at their bound stay there and the others are scaled until the
    margins hold. Shares that values have no cells or no room for are spread over the others of their margin. A sweep
    fits each margin once; sweeps end when no weight moves.
    """
    total = sum(cells.values())
    u = {c: n / total for c, n in sorted(cells.items()) if n > 0} if total else {}
    most, shares = most or {}, {m: wanted(cells, targets, m) for m in MARGINS}
    held = lambda: {c: min(x, most.get(c, math.inf)) for c, x in u.items()}
    w = held()
    for _ in range(MOST_SWEEPS):
        for i, m in enumerate(MARGINS):
            by: dict[str, list[tuple[str, str, str]]] = {}
            for c, x in u.items():
                if x > 0:
                    by.setdefault(c[i], []).append(c)
            want = goals(shares[m], {v: sum(most.get(c, math.inf) for c in cs) for v, cs in by.items()})
            if sum(want.values()) > 0:
                f = {v: _factor([(u[c], most.get(c, math.inf)) for c in cs], want.get(v, 0.0)) for v, cs in by.items()}
                u = {c: min(max(x * f[c[i]], LEAST), 1 / LEAST) if x > 0 and f[c[i]] > 0 else 0.0 for c, x in u.items()}
        was, w = w, held()
        if all(abs(x - was[c]) <= SETTLED for c, x in w.items()):
            break
    return {c: w.get(c, 0.0) for c in sorted(cells)} if total else {}


def rates(cells: dict[tuple[str, str, str], float], targets: Targets) -> dict[tuple[str, str, str], float]:
    """Expected number of times that each cell's documents are drawn, `repeats` at most.

    The bound is part of the fit. Warns of the values whose targets, or of a budget, that the bound or the cells leave
    out of reach.
    """
    total = sum(cells.values())
    drawn = targets.budget * total
    w = rake(cells, targets, {c: targets.repeats * n / drawn for c, n in cells.items()} if drawn else None)
    rate = {c: min(float(targets.repeats), drawn * w[c] / n) if n else 0.0 for c, n in cells.items()}
    if missed := [f"{m} {v}: {got:.4f} for {want:.4f}" for m, v, want, got in reached(cells, rate, targets) if abs(got - want) > 1e-6]:
        log.warning("the mix misses targets: %s", "; ".join(missed))
    return rate


def reached(cells: dict[tuple[str, str, str], float], rate: dict[tuple[str, str, str], float], targets: Targets) -> list[tuple[str, str, float, float]]:
    """(margin, value, target, expected share of the drawn tokens), and the budget with the expected share of all tokens."""
    total, drawn = sum(cells.values()), {c: rate[c] * n for c, n in cells.items()}
    if not (all_drawn := sum(drawn.values())):
        return []
    out = [("budget", "", targets.budget, all_drawn / total)]
    for i, m in enumerate(MARGINS):
        shares = wanted(cells, targets, m)
        values = shares | {c[i]: shares.get(c[i], 0.0) for c in cells}
        out += [(m, v, x, sum(d for c, d in drawn.items() if c[i] == v) / all_drawn) for v, x in values.items()]
    return out


def chance(key: Column) -> Column:
    """A number in [0, 1) from a digest of a document's id."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def cell_sums(each: DataFrame) -> dict[tuple[str, str, str], float]:
    """Tokens by cell: at most one row for each combination of targets."""
    return {(r["_source"], r["_lang"], r["_topic"]): float(r["n"]) for r in each.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("n")).collect()}


def margins(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:  # noqa: B008  frozen
    """margin, value, target, reached: what the mix of docs expects to draw beside what it was asked for."""
    cells = cell_sums(in_cells(apart(docs, "_source", "_lang", "_topic", "_tokens", "_words")[0], targets))
    return docs.sparkSession.createDataFrame(reached(cells, rates(cells, targets), targets), "margin string, value string, target double, reached double")


def sampled(docs: DataFrame, targets: Targets = Targets(), miss: float | None = None, shares: bool = False) -> DataFrame:  # noqa: B008  frozen
    """docs drawn for the mix, with n_tokens, rate and copies; documents drawn no time are left out.

    With shares, source_share, lang_share and topic_share follow: what the document's source, language and topic (or the
    others together) are expected to get of the tokens drawn, so what raking reached of their targets.

    copies is the rate rounded down, and one more with the chance of the rest. Null sources and languages are
    "other"; null and empty texts have no tokens and are never drawn; repeated rows are drawn alike; texts of any length
    are counted whole. Columns topic and n_tokens are used if there are such; columns rate and copies are replaced.
    miss: raises if a share is further than this from its target, rather than warn.
    """
    own, back = apart(docs, "_source", "_lang", "_topic", "_tokens", "_words", "_rate", "_copies", *(f"_{m}_share" for m in MARGINS))
    columns = [c for c in own.columns if c not in ("n_tokens", "rate", "copies", *(f"{m}_share" for m in MARGINS if shares))]
    each = in_cells(own, targets)
    keys = ["_source", "_lang", "_topic"]
    cells = cell_sums(each)
    rate = rates(cells, targets)
    if miss is not None and (bad := [f"{m} {v}: {got:.4f} for {want:.4f}" for m, v, want, got in reached(cells, rate, targets) if abs(got - want) > miss]):
        raise ValueError(f"targets out of reach: {'; '.join(bad)}")
    share = {(m, v): got for m, v, _, got in reached(cells, rate, targets)}
    rows = [(*c, x, *(share.get((m, v), 0.0) for m, v in zip(MARGINS, c, strict=True))) for c, x in sorted(rate.items())]
    known = docs.sparkSession.createDataFrame(rows, "_source string, _lang string, _topic string, _rate double, _source_share double, _lang_share double, _topic_share double")
    drawn = each.join(F.broadcast(known), keys).where("_tokens > 0")
    copies = F.floor("_rate") + (chance(F.col("doc_id")) < F.col("_rate") - F.floor("_rate")).cast("long")
    return drawn.withColumn("_copies", copies).where("_copies > 0").select(*columns, F.col("_tokens").alias("n_tokens"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"), *[F.col(f"_{m}_share").alias(f"{m}_share") for m in MARGINS if shares]).withColumnsRenamed(back)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn for the default mix."""
    return sampled(table(spark, sf_dir, "documents"), shares=True).select("doc_id", "source", "lang", "n_tokens", F.round("rate", 6).alias("rate"), "copies", *[F.round(f"{m}_share", 6).alias(f"{m}_share") for m in MARGINS])


def sql(targets: Targets = Targets()) -> str:  # noqa: B008
    """The same in SQL over a table of documents, with the sweeps written out; whole where the bound leaves the targets in reach."""
    name = lambda m: f"case when {m} in ({', '.join(repr(k) for k in getattr(targets, m) if k != OTHER)}) then {m} else '{OTHER}' end"

    def share(m: str) -> str:
        own, k = targets.shares(m), m[0]
        natural = "0.0::double" if OTHER in getattr(targets, m) or own[OTHER] > 1e-9 else f"(select coalesce(sum(case when {k} = '{OTHER}' then n end), 0) / sum(n) from c)"
        each = [f"when '{v}' then {x!r}::double * (1 - {natural})" for v, x in own.items() if v != OTHER]
        return f"case {k} {' '.join(each)} when '{OTHER}' then {own[OTHER]!r}::double + {natural} else 0.0::double end"

    def step(ctes: list[str], i: int) -> list[str]:
        m = MARGINS[i % 3]
        k = m[0]
        rows = f"over (partition by {k} order by most / u, s, l, t rows between"
        # the factor of a value's cells whose bounded weights sum to its share: cells reach their bound in order of most / u
        one = f"""w{i + 1} as materialized (select s, l, t, n, most, greatest(u * greatest(f, 0), 1e-100) as u from (
            select *, max(case when fit * u <= most then fit end) over (partition by {k}) as f from (
            select *, (want / sum(want * first) over () - full_) / rest as fit from (
            select *, {share(m)} as want, case when row_number() over (partition by {k} order by s, l, t) = 1 then 1 else 0 end as first,
            coalesce(sum(most) {rows} unbounded preceding and 1 preceding), 0) as full_, sum(u) {rows} current row and unbounded following) as rest from w{i}))))"""
        return [*ctes, one]

    def topic(topic: str) -> str:
        marks, words = TOPICS[topic]
        count = " + ".join(f"(length(x) - length(replace(x, '{m}', ''))) / {len(m)}" for m in marks)
        return f"when {count} > 0 and ({count}) * {words} >= n_tokens then '{topic}'"

    steps = ", ".join(reduce(step, range(3 * targets.sweeps), []))
    return f"""with b as (select doc_id, source, lang, coalesce(text, '') as x, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+'))::bigint as n_tokens from documents),
    d as (select doc_id, source, lang, n_tokens, case {' '.join(map(topic, TOPICS))} else 'prose' end as topic from b),
    e as (select *, {name('source')} as s, {name('lang')} as l, {name('topic')} as t from d),
    c as (select s, l, t, sum(n_tokens)::double as n from e group by 1, 2, 3),
    w0 as (select s, l, t, n, {float(targets.repeats)} * n / ({targets.budget} * sum(n) over ()) as most, n / sum(n) over () as u from c where n > 0), {steps},
    y as (select s, l, t, n, least(u, most) as w, sum(n) over () as all_n from w{3 * targets.sweeps}),
    r as (select s, l, t, {targets.budget} * all_n * w / n as rate, sum(w) over (partition by s) / sum(w) over () as ss, sum(w) over (partition by l) / sum(w) over () as ls, sum(w) over (partition by t) / sum(w) over () as ts from y),
    z as (select doc_id, source, lang, n_tokens, rate, ss, ls, ts, (floor(rate) + case when ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0 < rate - floor(rate) then 1 else 0 end)::bigint as copies
        from e join r using (s, l, t) where n_tokens > 0)
    select doc_id, source, lang, n_tokens, round(rate, 6) as rate, copies, round(ss, 6) as source_share, round(ls, 6) as lang_share, round(ts, 6) as topic_share from z where copies > 0"""
