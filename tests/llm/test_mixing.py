import pytest

from millrace.llm import mixing
from tests.oracle import same

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies string"


def test_margins_are_met():
    cells = {(s, g, t): float(10 + 7 * i + 3 * j + 11 * k) for i, s in enumerate(("a", "other")) for j, g in enumerate(("en", "fr")) for k, t in enumerate(("prose", "short"))}
    targets = mixing.Targets(source={"a": 0.7}, lang={"en": 0.4, "fr": 0.6}, topic={"prose": 0.9, "short": 0.1})
    w = mixing.rake(cells, targets)
    assert sum(x for c, x in w.items() if c[0] == "a") == pytest.approx(0.7, abs=1e-9)
    assert sum(x for c, x in w.items() if c[1] == "fr") == pytest.approx(0.6, abs=1e-9)
    assert sum(x for c, x in w.items() if c[2] == "short") == pytest.approx(0.1, abs=1e-9)
    assert sum(mixing.rates(cells, targets)[c] * n for c, n in cells.items()) == pytest.approx(0.5 * sum(cells.values()))


def test_bound_is_part_of_the_fit():
    # (a, en, short) alone would be drawn 10 times for the margins; the other cells can take up what it leaves
    cells = {("a", "en", "short"): 10.0, ("a", "fr", "short"): 40.0, ("other", "en", "short"): 40.0, ("a", "fr", "prose"): 200.0, ("other", "fr", "prose"): 900.0, ("a", "en", "prose"): 10.0, ("other", "en", "prose"): 60.0}
    targets = mixing.Targets(source={"a": 0.5}, lang={"en": 0.5, "fr": 0.5}, topic={"prose": 0.6, "short": 0.4}, budget=0.3)
    assert max(mixing.rake(cells, targets)[c] * 0.3 * 1260 / n for c, n in cells.items()) > 4
    rate = mixing.rates(cells, targets)
    assert max(rate.values()) == pytest.approx(4) and min(rate.values()) >= 0
    for margin, value, want, got in mixing.reached(cells, rate, targets):
        assert got == pytest.approx(want, abs=1e-9), (margin, value)


def test_targets_out_of_reach_fill_the_bound_and_are_told(caplog):
    cells = {("a", "en", "short"): 1.0, ("other", "en", "prose"): 500.0, ("a", "en", "prose"): 499.0}
    targets = mixing.Targets(source={"a": 0.5}, lang={"en": 1.0}, topic={"prose": 0.9, "short": 0.1})
    rate = mixing.rates(cells, targets)
    got = {(m, v): x for m, v, _, x in mixing.reached(cells, rate, targets)}
    assert rate["a", "en", "short"] == pytest.approx(4)
    assert got["topic", "short"] == pytest.approx(4 / 500) and got["topic", "prose"] == pytest.approx(496 / 500)
    assert got["source", "a"] == pytest.approx(0.5) and got["budget", ""] == pytest.approx(0.5)
    assert "topic short: 0.0080 for 0.1000" in caplog.text


def test_unnamed_values_keep_their_share(spark):
    cells = {(s, g, "prose"): n for (s, g), n in {("src0", "en"): 300.0, ("other", "en"): 300.0, ("src0", "other"): 100.0, ("other", "other"): 300.0}.items()}
    targets = mixing.Targets(source={"src0": 0.3}, lang={"en": 1.0}, topic={"prose": 1.0})
    got = {(m, v): x for m, v, _, x in mixing.reached(cells, mixing.rates(cells, targets), targets)}
    assert got["lang", "other"] == pytest.approx(0.4) and got["source", "src0"] == pytest.approx(0.3)
    none = mixing.rates(cells, mixing.Targets(source={"src0": 0.3}, lang={"en": 1.0, "other": 0.0}, topic={"prose": 1.0}))
    assert none["src0", "other", "prose"] == none["other", "other", "prose"] == 0
    text = "w " * 100 + "x" * 200
    docs = spark.createDataFrame([(i, text, "en" if i % 4 else ("it", None)[i % 8 > 0], f"src{i % 5}") for i in range(2000)], "doc_id bigint, text string, lang string, source string")
    drawn = mixing.sampled(docs, mixing.Targets(source={}, lang={"en": 1.0}, topic={"prose": 1.0})).collect()
    for lang in ("it", None):
        assert sum(r["copies"] for r in drawn if r["lang"] == lang) == pytest.approx(125, rel=0.25)


def test_expected_tokens_and_odd_rows(spark):
    rows = [(i, "w " * 60 + "x" * 200, "en" if i % 2 else "fr", "src0" if i % 3 else "q", 1, "z") for i in range(600)]
    rows += [(1000, None, "en", "q", 0, "z"), (1001, "", "en", None, 0, "z"), (None, "some words here", None, None, 1, "z"), (5, rows[5][1], "en", "src0", 1, "z")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = mixing.Targets(source={"src0": 0.5}, lang={"en": 0.5, "fr": 0.5}, topic={"prose": 1.0})
    got = mixing.sampled(docs, targets).collect()
    assert mixing.sampled(docs, targets).columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "rate", "copies"]
    drawn = sum(r["n_tokens"] * r["copies"] for r in got)
    assert drawn == pytest.approx(0.5 * 601 * 61, rel=0.15)
    assert sum(r["n_tokens"] * r["copies"] for r in got if r["source"] == "src0") == pytest.approx(drawn / 2, rel=0.2)
    assert not {1000, 1001} & {r["doc_id"] for r in got}
    assert len({r["copies"] for r in got if r["doc_id"] == 5}) <= 1


def test_topic_column_is_used_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", "news")], "doc_id bigint, text string, lang string, source string, topic string")
    targets = mixing.Targets(source={}, lang={}, topic={"news": 1.0}, budget=2.0)
    assert [(r["copies"], r["topic"]) for r in mixing.sampled(docs, targets).collect()] == [(2, "news")]
    assert mixing.sampled(docs.limit(0), targets).collect() == []


def test_token_counts_of_the_documents_are_used(spark):
    docs = spark.createDataFrame([(i, "some words", "en", "s", i % 3, "x") for i in range(30)], "doc_id bigint, text string, lang string, source string, n_tokens bigint, rate string")
    got = mixing.sampled(docs, mixing.Targets(source={}, lang={}, topic={}, budget=2.0)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["copies"]) for r in got} == {(i, i % 3, 2) for i in range(30) if i % 3}


def test_topics_by_their_share_of_the_text(spark):
    texts = ["a | b | c\nd | e | f", "word " * 50 + "a | b", "NO!! WAY!! STOP!!", "All rights: licensed under a licence. Copyright.", "", None, "word " * 500 + "license"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in docs.select(mixing.topic_of(docs["text"], mixing.n_words(docs["text"]))).collect()] == ["tabular", "prose", "noise", "legal", "prose", "prose", "prose"]


def test_infeasible_targets_can_be_refused(spark):
    docs = spark.createDataFrame([(i, "word " * 60, "en", "src0") for i in range(20)], "doc_id bigint, text string, lang string, source string")
    with pytest.raises(ValueError, match="topic tabular: 0.0000 for 0.0800"):
        mixing.sampled(docs, miss=0.01)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_margins_of_the_default_mix_hold(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    for r in mixing.margins(docs).collect():
        assert r["reached"] == pytest.approx(r["target"], abs=1e-6), r
    drawn = mixing.sampled(docs, shares=True).collect()
    targets = mixing.Targets()
    for r in drawn[:200]:
        for m, value in (("source", r["source"]), ("lang", r["lang"])):
            assert r[f"{m}_share"] == pytest.approx(targets.shares(m)[value if value in getattr(targets, m) else "other"], abs=1e-6)
    assert len(targets.source) == 10 and {round(r["topic_share"], 6) for r in drawn} <= set(targets.topic.values())
    tokens = sum(r["n_tokens"] * r["copies"] for r in drawn)
    if sf == "sf0.1":
        for lang, share in mixing.Targets().lang.items():
            assert sum(r["n_tokens"] * r["copies"] for r in drawn if r["lang"] == lang) / tokens == pytest.approx(share, abs=0.02)  # long documents are drawn whole
    assert max(r["rate"] for r in drawn) <= 4


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    same(spark, mixing.op2_source_mix, mixing.sql(), f"/root/testdata/{sf}")
