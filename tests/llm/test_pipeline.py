import hashlib
import re

import corpus_pipeline
from millrace.llm import decontamination, jaccard, language, mixing, secrets
from millrace.llm.common import table, written


def test_stages_like_brute_force(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = written(stage(spark, docs, data), name)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert after and after.keys() <= before.keys()
        if name == "near_duplicates":
            found = jaccard.brute_force({k: r["text"] for k, r in before.items()})
            assert after.keys() == {k for k, (c, _, _) in found.items() if c == k}
        if name == "secret_scan":
            words = secrets.automaton()
            assert after.keys() == {k for k, r in before.items() if not secrets.spans(r["text"], words)}
        if name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in table(spark, data, "benchmark").collect()]
            from tests.llm.test_decontamination import plain

            assert after.keys() == {k for k, _, n, _ in plain([(k, r["text"]) for k, r in before.items()], items) if not n}
        if name == "language_id":
            assert all(before[k]["text"] and any(c.isalpha() for c in before[k]["text"]) for k in after)
            assert len(after) > 0.9 * len(before) and language.UNKNOWN == "und"
            assert after.keys() == languages_kept(spark, before)
        if name == "source_mix":
            assert after == drawn(before, after)
        if name != "source_mix":
            assert docs.columns == columns
    assert decontamination.WINDOW == 10


def languages_kept(spark, before):
    """Documents that the language stage keeps, by substring search for the phrases of each."""
    docs = spark.createDataFrame([(k, r["text"], r["lang"]) for k, r in before.items()], "doc_id bigint, text string, lang string")
    texts = language.consistent(language.labelled_sample(docs.where(language.crc_mod3() != 1)))
    model, samples = language.Model(texts), {k: " ".join(v).lower() for k, v in texts.items()}
    out = set()
    for k, r in before.items():
        if any(c.isalpha() for c in r["text"] or ""):
            n = language.brute_force(model, samples, r["text"].lower())
            bits = [n[x] * cost / len(model.codes(r["text"])) for x, cost in zip(model.languages, model.cost, strict=True)]
            weight = [2 ** (-(b - min(bits)) * min(len(model.codes(r["text"])), language.SURE_LETTERS)) for b in bits]
            said, score = model.languages[bits.index(min(bits))], max(weight) / sum(weight)
            if said == r["lang"] or score < corpus_pipeline.SURE or len(r["text"]) < corpus_pipeline.LEAST_CHARS:
                out.add(k)
    return out


def drawn(before, after):
    """Rows that the mix draws, by its rates over cells summed here and the digests of the ids."""
    def cell(r):
        n = len(re.findall(r"[^ \t\r\n]+", r["text"]))
        of = lambda topic: sum(r["text"].count(m) for m in mixing.TOPICS[topic][0])
        topic = next((t for t, (_, most) in mixing.TOPICS.items() if 0 < of(t) and n <= of(t) * most), "prose")
        named = lambda v, targets: v if v in targets else "other"
        t = mixing.Targets()
        return (named(r["source"], t.source), named(r["lang"], t.lang), named(topic, t.topic)), n

    cells: dict = {}
    for r in before.values():
        c, n = cell(r)
        cells[c] = cells.get(c, 0.0) + n
    rates, out = mixing.rates(cells, mixing.Targets()), {}
    for k, r in before.items():
        c, n = cell(r)
        part = int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) / 2**32
        copies = int(rates[c]) + (part < rates[c] - int(rates[c]))
        if copies and n:
            assert after[k]["copies"] == copies and after[k]["n_tokens"] == n
            out[k] = after[k]
    return out


def test_rows_that_share_or_lack_an_id(spark, data):
    t, u = "these are the words of a text that some rows share", "and here are the words of another one, that is clean"
    bad = "a token = abcdefghijklmnopqrst is in here"
    passage = next(r["text"] for r in table(spark, data, "benchmark").collect() if len(r["text"].split()) > 12)
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string"
    docs = spark.createDataFrame([(i, x, "en", "s", 1, "k") for i, x in ((7, t), (7, t), (9, t), (None, t), (7, u), (None, bad), (9, bad), (None, u + " now and then"), (8, passage), (8, "what is clean stays"))], columns)
    ids = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    once = written(corpus_pipeline.near_duplicates(spark, docs, data), "once")
    assert once.columns == docs.columns and ids(once) == ids(spark.createDataFrame([(i, x, "en", "s", 1, "k") for i, x in ((7, t), (7, u), (9, bad), (None, u + " now and then"), (8, passage), (8, "what is clean stays"))], columns))
    clean = corpus_pipeline.decontaminate(spark, docs, data)
    assert clean.columns == docs.columns and ids(clean) == [x for x in ids(docs) if x[1] != passage]
    assert {x for _, x in ids(corpus_pipeline.secret_scan(spark, docs, data))} == {t, u, u + " now and then", passage, "what is clean stays"}


def test_empty_documents(spark, data):
    docs = table(spark, data, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.collect() == []


def test_stages_keep_columns_of_any_name(spark, data):
    """Columns under the names that stages use for themselves come out as they went in."""
    from pyspark.sql import functions as F

    mine = {c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in ("score", "lang_pred", "_text_key", "_h1", "_tokens", "_source", "_words", "_rate", "Text_Key")}
    docs = table(spark, data, "documents").withColumns(mine)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data), name)
        rows = docs.select("doc_id", *mine).collect()
        assert rows and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in mine), name


def test_unlearned_label_rejects_nothing(spark, data, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    docs = table(spark, data, "documents").where("text rlike '[a-z]'")
    most = docs.where(language.crc_mod3() != 1).groupBy("lang").count().orderBy("count", ascending=False).first()["lang"]
    assert corpus_pipeline.language_id(spark, docs, data).where(f"lang <> '{most}'").count() == docs.where(f"lang <> '{most}'").count()
