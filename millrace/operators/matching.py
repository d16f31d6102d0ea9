"""Record linkage that accepts a match only when the evidence names one source."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text, urls

#: Methods from the strongest.
METHODS = ("source_url", "exact_sku", "dab_product_prefix", "source_product_identifier", "source_url_title")


def unsized(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides: what is exploded or read from a well packed file is taken for far smaller than it
    is, and would be broadcast through the driver."""
    return df.hint("merge")


def unique_by(rows: DataFrame, keys: list[str], url: str, keep: list[str]) -> DataFrame:
    """One row for each key whose rows all name one URL: the first by `keep`'s order. Empty keys match nothing."""
    fine = reduce(lambda a, k: a & F.col(k).isNotNull() & (F.col(k) != ""), keys, F.lit(True))
    each = rows.where(fine).groupBy(*keys).agg(F.count_distinct(url).alias("_n"), F.min(F.struct(*keep)).alias("_first"))
    return each.where("_n = 1").select(*keys, "_first.*")


def unique_or_base(left: DataFrame, right: DataFrame, vendor: str, exact: str, base: str, url: str, pos: str) -> DataFrame:
    """left with `url` and method of its one match by exact title, else by base title; both together with the vendor."""
    by_exact = unique_by(right, [vendor, exact], url, [pos, url]).withColumnsRenamed({url: "_exact_url"}).drop(pos)
    by_base = unique_by(right, [vendor, base], url, [pos, url]).withColumnsRenamed({url: "_base_url"}).drop(pos)
    both = left.join(by_exact, [vendor, exact], "left").join(by_base, [vendor, base], "left")
    method = F.when(F.col("_exact_url").isNotNull(), "exact_title").when(F.col("_base_url").isNotNull(), "base_title")
    return both.withColumn(url, F.coalesce("_exact_url", "_base_url")).withColumn("method", method).drop("_exact_url", "_base_url")


def unique_evidence(left: DataFrame, right: DataFrame, kinds: list[list[str]], id: str, url: str, pos: str) -> DataFrame:
    """id, pos, url of left rows if all right rows that agree with them by any of the kinds (columns) name one URL.

    That is so where the least and the greatest URL are the same, so the right side is a row for each value of a kind, and no
    pair of rows is made. Null columns agree with none; pos is the least.
    """
    found = left
    for i, keys in enumerate(kinds):
        each = right.groupBy(*keys).agg(F.min(F.col(pos)).alias(f"_pos{i}"), F.min(F.col(url)).alias(f"_least{i}"), F.max(F.col(url)).alias(f"_most{i}"))
        found = found.join(unsized(each), keys, "left")
    of = lambda f, name: reduce(lambda a, b: f(a, b), [F.col(f"_{name}{i}") for i in range(len(kinds))])  # noqa: E731  nulls count for nothing
    own = found.groupBy(id).agg(F.min(of(F.least, "pos")).alias(pos), F.min(of(F.least, "least")).alias(url), F.max(of(F.greatest, "most")).alias("_most"))
    return own.where(F.col(url) == F.col("_most")).drop("_most")


def cascade(products: DataFrame, evidence: DataFrame, titles: DataFrame, explicit: str = "has_explicit_url") -> DataFrame:
    """product, status, method, row of every product.

    evidence and titles: product, method, canonical, exact_sku (0 if the row's SKU is the product's, else 1), priority,
    row_number. Titles count only for products without other evidence. One canonical URL: matched, by the strongest
    method and the first row; several: needs_review; none: needs_review if the product names a URL itself, else
    needs_link.
    """
    weak = titles.join(evidence.select("product"), "product", "left_anti")
    rank = reduce(lambda out, im: F.when(F.col("method") == im[1], im[0]).otherwise(out), enumerate(METHODS), F.lit(len(METHODS)))
    every = evidence.unionByName(weak).withColumn("_rank", rank)
    found = every.groupBy("product").agg(
        F.count_distinct("canonical").alias("urls"),
        F.min_by("method", "_rank").alias("best"),
        F.min(F.struct("exact_sku", "priority", "row_number")).alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_rank", "method"))), lambda x: x["method"]), ",").alias("methods"),
    )
    one = F.col("urls") == 1
    out = products.join(found, "product", "left").withColumn("urls", F.coalesce("urls", F.lit(0)))
    return out.select(
        "product",
        F.when(one, "matched").when(F.col("urls") > 1, "needs_review").when(F.col(explicit), "needs_review").otherwise("needs_link").alias("status"),
        F.when(one, F.col("best")).when(F.col("urls") > 1, "ambiguous").when(F.col(explicit), "source_url_not_in_sheets").otherwise("none").alias("method"),
        F.when(one, F.col("first.row_number")).alias("row_number"),
        F.coalesce("methods", F.lit("")).alias("evidence"),
    )


def one_to_one(pairs: DataFrame, *keys: str) -> DataFrame:
    """Pairs whose every key stands in one pair only."""
    marked = reduce(lambda df, k: df.withColumn(f"_{k}", F.count("*").over(W.Window.partitionBy(k))), keys, pairs.distinct())
    return marked.where(reduce(lambda a, k: a & (F.col(f"_{k}") == 1), keys, F.lit(True))).drop(*[f"_{k}" for k in keys])


def contained(texts: DataFrame, codes: DataFrame, vendor: str, text: str, code: str, least: int = 5) -> DataFrame:
    """texts with each code of their vendor (of `least` characters or more) that their text contains.

    An index of `least`-grams: a text is met by its vendor's codes on one gram of the code, the one that fewest texts of
    the vendor hold, and only then searched. A code with a gram that no text holds meets none.
    """
    def grams(x):
        return F.when(F.length(x) >= least, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - (least - 1)), lambda i: F.substr(x, i, F.lit(least)))))

    texts = texts.repartition(vendor, text)  # a file of few row groups is few tasks, and each row becomes a row a gram
    held = texts.select(vendor, F.explode(grams(F.col(text))).alias("_gram"))
    often = held.groupBy(vendor, "_gram").agg(F.count("*").alias("_n"))
    own = codes.select(vendor, code).where(F.length(code) >= least).distinct()
    each = own.select(vendor, code, F.explode(grams(F.col(code))).alias("_gram"))
    rarest = each.join(unsized(often), [vendor, "_gram"]).groupBy(vendor, code).agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.count("*").alias("_met"))
    asked = rarest.where(F.col("_met") == F.size(grams(F.col(code)))).select(vendor, code, "_gram")  # beside the explode the size would carry all grams with each
    met = texts.withColumn("_gram", F.explode(grams(F.col(text)))).join(unsized(asked), [vendor, "_gram"])
    return met.where(F.contains(text, code)).drop("_gram")


def token_sets(rows: DataFrame, tokens: str) -> DataFrame:
    """rows with `set_id`, the least id of those with the same tokens, whatever their order; rows without tokens have none.

    rows: id and tokens, an array.
    """
    own = rows.withColumn("_set", F.array_sort(F.array_distinct(tokens))).where(F.size("_set") > 0)
    least = own.groupBy("_set").agg(F.min("id").alias("set_id"))
    return own.join(least, "_set").withColumnRenamed("_set", "set")


def overlapping_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left_set, right_set, overlap of distinct sets (set_id, set) whose tokens overlap by at least `least` of the smaller's.

    A pair shares c = ceil(least * m) of the smaller set's m tokens. With tokens in order of rarity, the first two that it
    shares stand among the first m - c + 2 of the smaller and the first n - c + 2 of the larger set, so sets meet on pairs
    of those (on single tokens where c is 1), under the size m that they are for: prefix, length and position in one key.
    A pair is taken where its first two shared tokens meet, and so once, without a further shuffle.
    """
    each = left.select("set").unionByName(right.select("set"))
    often = each.select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def ordered(side: DataFrame, name: str) -> DataFrame:
        met = side.select(F.col("set_id").alias(name), F.explode("set").alias("token")).join(often, "token")
        return met.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias(f"{name}_tokens"))

    shared = lambda m: F.ceil(m * F.lit(least) - 1e-9).cast("int")

    def keys(tokens, m):
        """The keys under which a set is met by, or as, one of m tokens."""
        c = shared(m)
        first = F.slice(tokens, F.lit(1), F.greatest(F.lit(1), F.least(F.size(tokens), F.size(tokens) - c + F.least(c, F.lit(2)))))
        two = F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda b: F.struct(m.alias("m"), a.alias("a"), b.alias("b")))))
        one = F.transform(first, lambda a: F.struct(m.alias("m"), a.alias("a"), F.lit("").alias("b")))
        return F.when(c >= 2, two).otherwise(one)

    a, b = ordered(left, "left_set"), ordered(right, "right_set")
    sizes = lambda df, name: df.select(F.size(f"{name}_tokens").alias("m")).distinct()  # noqa: E731  a row a length
    as_smaller = lambda df, name: df.withColumn("key", F.explode(keys(F.col(f"{name}_tokens"), F.size(f"{name}_tokens"))))

    def as_larger(df: DataFrame, name: str, other: DataFrame, other_name: str, strictly: bool) -> DataFrame:
        n = F.size(f"{name}_tokens")
        longer = n > F.col("m") if strictly else n >= F.col("m")
        return df.join(F.broadcast(sizes(other, other_name)), longer).withColumn("key", F.explode(keys(F.col(f"{name}_tokens"), F.col("m")))).drop("m")

    met = as_smaller(a, "left_set").join(as_larger(b, "right_set", a, "left_set", False), "key").unionByName(
        as_larger(a, "left_set", b, "right_set", True).join(as_smaller(b, "right_set"), "key")
    )
    both = met.withColumn("both", F.array_intersect("left_set_tokens", "right_set_tokens"))
    smaller = F.least(F.size("left_set_tokens"), F.size("right_set_tokens"))
    here = (F.col("key.a") == F.col("both")[0]) & ((F.col("key.b") == "") | (F.col("key.b") == F.get("both", F.lit(1))))
    fine = both.where((F.size("both") >= shared(smaller)) & here)
    return fine.select("left_set", "right_set", (F.size("both") / smaller).alias("overlap"))


def weighted_unique(left: DataFrame, right: DataFrame, key: str, weights: dict[str, int]) -> DataFrame:
    """left_id, right_id, score: each left row's best right row with the same key, if no other one scores as much.

    A score is the sum of the weights (positive, no two sums alike) of the columns that agree; null columns agree with
    none. A left row asks for each set of agreeing columns at once, best first, how many right rows agree on
    them: the right side is one row for each combination of values, so no pair of rows is made. At the first set with
    any, those agree on nothing more.
    """
    columns = list(weights)
    subsets = sorted(((sum(w for c, w in weights.items() if c in s), s) for n in range(len(columns) + 1) for s in combinations(columns, n)), key=lambda x: -x[0])
    if len({w for w, _ in subsets}) < len(subsets):
        raise ValueError("two sets of columns weigh the same")

    def asked(df: DataFrame) -> DataFrame:
        level = lambda i, s: F.when(reduce(lambda a, c: a & F.col(c).isNotNull(), s, F.lit(True)), F.struct(F.lit(i).alias("level"), *[(F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in columns]))
        return df.select("id", key, F.explode(F.array_compact(F.array(*[level(i, s) for i, (_, s) in enumerate(subsets)]))).alias("_by")).where(F.col(key).isNotNull())

    there = asked(right).groupBy(key, "_by").agg(F.count("*").alias("_n"), F.min("id").alias("_id"))
    best = asked(left).join(unsized(there), [key, "_by"]).groupBy("id").agg(F.min(F.struct(F.col("_by.level").alias("level"), "_n", "_id")).alias("b")).where("b._n = 1")
    score = F.array(*[F.lit(w) for w, _ in subsets])
    return best.select(F.col("id").alias("left_id"), F.col("b._id").alias("right_id"), score[F.col("b.level")].alias("score"))


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """keys, change (added, removed, changed, same), old and new value, by a full outer join."""
    a, b = old.withColumnRenamed(value, "old_value").withColumn("_o", F.lit(True)), new.withColumnRenamed(value, "new_value").withColumn("_n", F.lit(True))
    same = F.coalesce(F.abs(F.col("old_value") - F.col("new_value")) < tolerance, F.lit(False))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(same, "same").otherwise("changed")
    return a.join(b, keys, "full_outer").withColumn("change", change).drop("_o", "_n")


def guarded_difference(managed: DataFrame, authoritative: DataFrame, key: str, failed_sources: int, least_urls: int = 5000, most_ratio: float = 0.35, small: int = 100) -> DataFrame:
    """Managed rows that the authority lacks, or none at all if it is not to be trusted.

    It is not if a source failed, if it names too few, or if more than most_ratio of over `small` managed would go.
    """
    gone = managed.join(authoritative.select(key).distinct(), key, "left_anti")
    facts = authoritative.agg(F.count_distinct(key).alias("_urls")).crossJoin(managed.agg(F.count("*").alias("_managed"))).crossJoin(gone.agg(F.count("*").alias("_gone")))
    safe = facts.where((F.lit(failed_sources) == 0) & (F.col("_urls") >= least_urls) & ~((F.col("_managed") > small) & (F.col("_gone") > most_ratio * F.col("_managed"))))
    return gone.join(F.broadcast(safe.select(F.lit(1).alias("_ok"))), F.lit(True), "left_semi")  # one row


def relation_audit(products: DataFrame, live: DataFrame) -> DataFrame:
    """product, vendor_exact, title_exact, identity_exact, unrelated of linked products against what the shop has of them.

    products, live: product, vendor, title, ids (an array). Vendors and titles are compared normalised, identities if any
    of three characters or more is on both sides. A link is unrelated only if all three can be compared and all differ.
    """
    norm = lambda df, side: df.select(
        "product", text.vendor_relation(F.col("vendor")).alias(f"{side}_vendor"), text.title_relation(F.col("title")).alias(f"{side}_title"),
        F.filter(F.transform("ids", text.compact), lambda x: F.length(x) >= 3).alias(f"{side}_ids"),
    )
    both = norm(products, "own").join(norm(live, "live"), "product")
    filled = lambda c: (F.coalesce(f"own_{c}", F.lit("")) != "") & (F.coalesce(f"live_{c}", F.lit("")) != "")
    ids = (F.coalesce(F.size("own_ids"), F.lit(0)) > 0) & (F.coalesce(F.size("live_ids"), F.lit(0)) > 0)
    exact = {"vendor": filled("vendor") & (F.col("own_vendor") == F.col("live_vendor")), "title": filled("title") & (F.col("own_title") == F.col("live_title")), "identity": ids & F.coalesce(F.arrays_overlap("own_ids", "live_ids"), F.lit(False))}
    unrelated = filled("vendor") & filled("title") & ids & ~exact["vendor"] & ~exact["title"] & ~exact["identity"]
    return both.select("product", *[F.coalesce(c, F.lit(False)).alias(f"{k}_exact") for k, c in exact.items()], F.coalesce(unrelated, F.lit(False)).alias("unrelated"))


def self_confirmed(rows: DataFrame, key: str, mentions: Column, title: Column, sku: Column, plausible) -> DataFrame:
    """key, url of rows that name exactly one plausible product URL which their own title or SKU confirms.

    A title confirms if it and the URL's last words have three words or more each and share four fifths of the fewer; a SKU
    if it holds an id of the URL, or is held by one. plausible: of a URL, whether it may be a product's.
    """
    each = rows.select(key, F.filter(urls.urls_in(mentions), plausible).alias("_urls"), title.alias("_title"), text.compact(sku).alias("_sku")).where(F.size("_urls") == 1)
    each = each.select(key, "_title", "_sku", F.col("_urls")[0].alias("url"))
    a, b = text.tokens(text.title_relation(F.col("_title")), stop=()), text.tokens(urls.last_segment_title(F.col("url")), stop=())
    titled = (F.size(a) >= 3) & (F.size(b) >= 3) & (F.size(F.array_intersect(a, b)) >= 0.8 * F.least(F.size(a), F.size(b)))
    held = F.exists(urls.identifiers(F.col("url")), lambda i: F.contains(F.col("_sku"), i) | F.contains(i, F.col("_sku")))
    return each.where(F.coalesce(titled, F.lit(False)) | ((F.col("_sku") != "") & held)).select(key, "url")


def reconciled(rows: DataFrame, located: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """url, status, product of every group of sheet rows with one URL: what may be done about it, the first that applies.

    rows: url, multiplier. located: url, product, the shop's products that match with the best confidence. source: url,
    colour, identified (of each variant read). target: product, colour, mapped, placeholder (of each variant there).
    conflict: several multipliers; ambiguous: several products; missing: none; colour_ambiguity: several colours there and
    at most one read; rebuild_required: fewer variants there than were read, if all of those are identified, or
    some that are not mapped, or placeholders; else verified.
    """
    colour = lambda: F.count_distinct(F.nullif(text.label(F.col("colour")), F.lit("")))
    group = rows.groupBy("url").agg((F.count_distinct("multiplier") > 1).alias("conflict"))
    found = located.groupBy("url").agg(F.count_distinct("product").alias("products"), F.min("product").alias("product"))
    read = source.groupBy("url").agg(F.count("*").alias("read"), colour().alias("read_colours"), F.bool_and(F.coalesce("identified", F.lit(False))).alias("identified"))
    there = target.groupBy("product").agg(F.count("*").alias("there"), colour().alias("colours"), F.count_if(~F.coalesce("mapped", F.lit(False))).alias("unmapped"), F.count_if("placeholder").alias("placeholders"))
    each = group.join(found, "url", "left").join(read, "url", "left").join(there, "product", "left").fillna(0, ["products", "read", "read_colours", "there", "colours", "unmapped", "placeholders"])
    fewer = F.coalesce("identified", F.lit(False)) & (F.col("read") > 1) & (F.col("there") < F.col("read"))
    status = (
        F.when(F.col("conflict"), "conflict").when(F.col("products") > 1, "ambiguous").when(F.col("products") == 0, "missing")
        .when((F.col("colours") > 1) & (F.col("read_colours") <= 1), "colour_ambiguity")
        .when(fewer | (F.col("unmapped") > 0) | (F.col("placeholders") > 0), "rebuild_required").otherwise("verified")
    )
    return each.select("url", status.alias("status"), F.when(~F.col("conflict") & (F.col("products") == 1), F.col("product")).alias("product"))
