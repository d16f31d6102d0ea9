"""Benchmark decontamination with a positional inverted index over the training text.

The index holds a posting (document, term, position) for every occurrence of a word that any benchmark item uses,
written once by the tasks that read the documents, without a shuffle. Windows of 10 consecutive item words are looked up
from their rarest term: its postings meet those of the second rarest term in reach, by stretches of the text. Where
both stand at their offsets the postings of all the others, shifted by theirs, make an exact match; where all terms of
the window stand in one stretch of SLOP more places, in any order, it is a proximity match. DataFrame operations only.

Rows of documents and windows are numbered where they are written, so no two share an identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WORD, small, table, written

WINDOW = 10
#: Most pairs of the two rarest terms, of some 50 bytes, that are sent to the postings of the third; beyond that both are
#: shuffled.
PAIRS = 1_000_000
#: Places by which the stretch of a proximity match is longer than its window.
SLOP = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The term of the posting that marks the end of each document, at position n_words; not a word.
END = "\n"


def words_of(text: Column) -> Column:
    """A text's words in order; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, window (its number), offset, word of every window; to be written, as the number is given where it runs.

    An item of fewer words is one window, one of none has none; repeated rows count once.
    """
    listed = items.select("item_id", "text").distinct().withColumn("words", words_of(F.col("text"))).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    each = listed.select("item_id", "words", F.explode(starts).alias("start")).withColumn("window", F.monotonically_increasing_id())
    return each.select("item_id", "window", F.posexplode(F.slice("words", F.col("start") + 1, size)).alias("offset", "word"))


def index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings doc (a row's number), doc_id, term, position of the vocabulary's words (word, term), and an END posting a row."""
    each = docs.select("doc_id", "text").withColumn("doc", F.monotonically_increasing_id())
    each = each.select("doc_id", "doc", F.posexplode(F.concat(words_of(F.col("text")), F.array(F.lit(END)))).alias("position", "word"))
    return written(each.join(small(vocabulary), "word").select("doc", "doc_id", "term", "position"), "postings")


def matches(postings: DataFrame, terms: DataFrame, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """(item_id, window, doc, start, size of every exact occurrence of a window; item_id, doc of every proximity match).

    terms: item_id, window, offset, term. Only documents that hold the window's two rarest terms at their offsets, or
    the three rarest in reach, have their other postings read again.
    """
    number = postings.groupBy("term").agg(F.count("*").alias("n"))
    window = ["item_id", "window"]
    order = W.Window.partitionBy(*window).orderBy("n", "term", "offset")
    size = F.count("*").over(W.Window.partitionBy(*window))
    # a term that no document has makes its window impossible: it is ranked first and finds nothing
    counted = terms.join(number, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = written(counted.select("*", F.dense_rank().over(W.Window.partitionBy(*window).orderBy("n", "term")).alias("kind"), F.row_number().over(order).alias("rank"), size.alias("size")), "ranked")
    kinds = ranked.groupBy(*window).agg(F.max("kind").alias("kinds"), F.first("size").alias("size"))

    def places(kind: int) -> DataFrame:
        """Postings of the windows' terms of that rarity, at one of their offsets."""
        own = ranked.where(F.col("kind") == kind).groupBy(*window, "term").agg(F.min("offset").alias("offset"))
        own = small(written(own.join(kinds, window), "anchors"))
        return postings.join(own, "term").select(*window, "doc", "position", "offset", "size", "kinds")

    reach = F.col("size") + slop
    bucket = F.floor(F.col("position") / reach)
    first = places(1)
    alone = first.where("kinds = 1")
    left = first.where("kinds > 1").withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    right = places(2).select(*window, "doc", F.col("position").alias("position2"), F.col("offset").alias("offset2"), bucket.alias("bucket"))
    near = left.join(right, [*window, "doc", "bucket"]).where(F.abs(F.col("position") - F.col("position2")) < reach)
    at_offsets = F.col("position") - F.col("offset") == F.col("position2") - F.col("offset2")
    pairs = written(near.groupBy(*window, "doc", "position", "offset", "size", "kinds").agg(F.bool_or(at_offsets).alias("exact")), "pairs")

    # pairs that are not at their offsets are many: those of proximity have the third rarest term in reach too
    left = written(pairs.where("kinds > 2").select(*window, "doc", "position", "size", "kinds").withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))), "thirds")
    right = places(3).select(*window, "doc", F.col("position").alias("position2"), bucket.alias("bucket"))
    triples = right.join(small(left, PAIRS), [*window, "doc", "bucket"]).where(F.abs(F.col("position") - F.col("position2")) < reach)
    triples = written(triples.select(*window, "doc", F.col("position").alias("anchor"), "size", "kinds").distinct(), "triples")

    # a window of one repeated term has its matches among the term's own postings
    anchors = pairs.unionByName(written(alone.withColumn("exact", F.lit(True)), "alone"))
    open_ = anchors.where("exact and (kinds > 2 or size > kinds)").select("doc").unionByName(triples.select("doc"))
    few = small(written(open_.distinct(), "near"))
    near_postings = written(postings.join(few, "doc", "left_semi").select("doc", "term", "position"), "near_postings")

    start = (F.col("position") - F.col("offset")).alias("start")
    exact = anchors.where("exact").select(*window, "doc", start, "size", "kinds").where("start >= 0")
    sure, open_ = exact.where("size = kinds and kinds <= 2"), exact.where("size > kinds or kinds > 2")
    rest = small(written(ranked.select(*window, "offset", "term"), "rest"))
    wanted = open_.join(rest, window).select(*window, "doc", "start", "size", "term", (F.col("start") + F.col("offset")).alias("position"))
    met = wanted.join(near_postings, ["doc", "term", "position"]).groupBy(*window, "doc", "start", "size").agg(F.count("*").alias("met"))
    columns = [*window, "doc", "start", "size"]
    found = sure.select(columns).unionByName(met.where("met = size").select(columns)).distinct()

    # proximity: all kinds of terms in one stretch that holds the anchor
    kind_terms = small(written(ranked.select(*window, "term").distinct(), "kind_terms"))
    about = triples.join(kind_terms, window)
    width = F.lit(WINDOW + slop)  # one width of stretches for all, so that postings are cut once
    cut = lambda p: F.floor(p / width)
    about = about.withColumn("cut", F.explode(F.array(cut(F.col("anchor")) - 1, cut(F.col("anchor")), cut(F.col("anchor")) + 1)))
    held = about.join(near_postings.withColumn("cut", cut(F.col("position"))), ["doc", "term", "cut"]).where(F.abs(F.col("position") - F.col("anchor")) < reach)
    stood = held.groupBy(*window, "doc", "anchor", "size", "kinds").agg(F.collect_list(F.struct("position", "term")).alias("stood"), F.count_distinct("term").alias("met")).where("met = kinds")
    inside = lambda s: F.filter("stood", lambda x: (x["position"] >= s) & (x["position"] < s + reach))
    full = F.exists(F.sequence(F.col("anchor") - reach + 1, F.col("anchor")), lambda s: F.size(F.array_distinct(F.transform(inside(s), lambda x: x["term"]))) == F.col("kinds"))
    close = stood.where(full).select("item_id", "doc").unionByName(anchors.where("kinds <= 2").select("item_id", "doc"))
    return found, close.distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), n_near, near_items, contaminated of every row.

    n_hit counts the words inside exact occurrences of a window, items are those of exact windows, near_items those
    of proximity matches, exact ones among them. A null text has no words, a null item_id is no item; repeated rows
    each get their own row; doc_id, of any type, is only carried; an empty benchmark leaves every document clean; texts of any length are indexed whole.
    """
    if size > WINDOW:
        raise ValueError(f"stretches are cut for windows of {WINDOW} words at most")
    spelled = written(windows_of(items.where("item_id is not null"), size), "windows")
    # equal words get one number
    words = spelled.select("word").unionByName(spelled.sparkSession.createDataFrame([(END,)], "word string")).distinct()
    vocabulary = written(words.withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    postings = index(docs, vocabulary)
    is_end = F.col("term") == (vocabulary.where(F.col("word") == END).first() or {"term": -1})["term"]
    terms = written(spelled.join(small(vocabulary), "word").select("item_id", "window", "offset", "term"), "terms")
    exact, close = matches(postings.where(~is_end), terms, slop)
    found, close = written(exact, "occurrences"), written(close, "close")
    hit = found.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("position")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    listed = lambda df, n, names: df.select("doc", "item_id").distinct().groupBy("doc").agg(F.count("*").alias(n), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias(names))
    rows = postings.where(is_end).select("doc", "doc_id", F.col("position").cast("long").alias("n_words"))
    about = listed(close, "n_near", "near_items").join(listed(found, "n_items", "items"), "doc", "left").join(hit, "doc", "left")
    none, n = F.array().cast("array<string>"), lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(about, "doc", "left").select(
        "doc_id", "n_words", n("n_hit"), n("n_items"), F.coalesce("items", none).alias("items"), n("n_near"), F.coalesce("near_items", none).alias("near_items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside passages of 10 words that a benchmark item has too, and proximity matches."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = lambda names: F.sha2(F.array_join(names, ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest("items").alias("items_sha256"), "contaminated", "n_near", digest("near_items").alias("near_sha256"))


SQL = f"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as words from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as words from benchmark where item_id is not null),
iw as (select distinct item_id, array_to_string(words[s + 1:s + {WINDOW}], ' ') as gram, least(len(words), {WINDOW}) as size from (select item_id, words, unnest(range(greatest(len(words) - {WINDOW} + 1, 1))) as s from i where len(words) > 0)),
sizes as (select distinct size from iw),
dw as (select doc_id, size, s, array_to_string(words[s + 1:s + size], ' ') as gram from (select doc_id, words, size, unnest(range(len(words) - size + 1)) as s from w, sizes where len(words) >= size)),
o as (select doc_id, item_id, s, iw.size from dw join iw on iw.gram = dw.gram and iw.size = dw.size),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from o) group by 1),
n as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from o group by 1),
t as (select distinct item_id, gram, size, unnest(string_split(gram, ' ')) as word from iw),
k as (select item_id, gram, count(*) as kinds from t group by 1, 2),
p as (select doc_id, unnest(range(len(words))) as p, unnest(words) as word from w),
f as (select word, count(*) as n from p group by 1),
r as (select item_id, gram, size, word from (select t.*, row_number() over (partition by item_id, gram order by coalesce(n, 0), t.word) as place from t left join f using (word)) where place = 1),
a as (select r.item_id, r.gram, r.size + {SLOP} as reach, p.doc_id, p.p as anchor from r join p using (word)),
near as (select a.*, p.p, p.word from a join p on p.doc_id = a.doc_id and p.p > a.anchor - reach and p.p < a.anchor + reach join t on t.item_id = a.item_id and t.gram = a.gram and t.word = p.word),
st as (select item_id, gram, doc_id, anchor, s, count(distinct word) as met from (select *, unnest(range(greatest(p, anchor) - reach + 1, least(p, anchor) + 1)) as s from near) group by all),
c as (select doc_id, count(distinct item_id) as n_near, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from st join k using (item_id, gram) where met = kinds group by 1)
select w.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(n.items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
coalesce(n_near, 0)::bigint as n_near, sha256(coalesce(c.items, '')) as near_sha256
from w left join h using (doc_id) left join n using (doc_id) left join c using (doc_id)"""
