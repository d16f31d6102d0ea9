import time
from pyspark.sql import functions as F

from millrace.llm import language
from millrace.llm.common import table


def test_phrases_match_substring_search():
    samples = {"a": "the cat sat on the mat and the dog", "b": "le chat est sur la table avec le chien"}
    model = language.Model({k: [v] for k, v in samples.items()})
    texts = ["the dog sat", "le chien sur the mat", "xyz", "", None, "123 !!", "é" * 5, "the cat " * 400]
    n, size = model.phrases(texts)
    for t, row, length in zip(texts, n, size, strict=True):
        want = language.brute_force(model, samples, t or "")
        assert length == len(model.codes(t or "")) and (not length or row.tolist() == [want["a"], want["b"]])
    said = model.predict(texts)
    assert said[0][0] == "a" and said[3] == said[4] == said[5] == ("und", 0.0)


def test_held_out_accuracy(spark, data):
    got = language.op3_language_id(spark, data).join(table(spark, data, "documents").select("doc_id", "lang", "text"), "doc_id")
    held = got.where(F.col("held_out") & (F.length("text") > 40)).collect()
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in held)
    assert {r["held_out"] for r in got.collect()} == {True, False}


def test_query_like_substring_search(spark, data):
    docs = table(spark, data, "documents")
    learned = docs.where(language.crc_mod3() != 1).select("doc_id", "text", "lang")
    texts = language.consistent(language.labelled_sample(learned))
    model = language.Model(texts)
    samples = {k: " ".join(v).lower() for k, v in texts.items()}
    whole = [r["text"] or "" for r in learned.collect()]
    assert all(any(piece in t for t in whole) for v in texts.values() for piece in v[:3])
    got = {r["doc_id"]: r["lang_pred"] for r in language.op3_language_id(spark, data).collect()}
    for r in docs.where("doc_id % 7 = 0").collect():
        n = language.brute_force(model, samples, (r["text"] or "").lower())
        bits = {k: n[k] * cost for k, cost in zip(model.languages, model.cost, strict=True)}
        want = min(sorted(bits), key=bits.get) if any(c.isalpha() for c in r["text"] or "") else language.UNKNOWN
        assert got[r["doc_id"]] == want, r["doc_id"]


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "hello there my friend", "en", "p"), (1, "hello there my friend", "en", "p"), (2, None, "en", "p"), (None, "12 34", None, "p"), (3, "word " * 50000, None, "p")], "doc_id bigint, text string, lang string, rank string")
    model = language.fit(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predicted(docs, model).collect()}
    assert got == {(1, "en"), (2, "und"), (None, "und"), (3, "en")}
    named = language.predicted(docs.withColumnsRenamed({"rank": "lang_pred"}).withColumn("score", F.lit("s")), model)
    assert named.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and {r["lang_pred"] for r in named.collect()} == {"en", "und"}
    empty = docs.limit(0)
    assert language.predicted(empty, language.fit(empty)).collect() == []
    assert language.predicted(docs, language.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_mislabelled_samples_are_left_out():
    words = {"a": "the cat sat on the mat and the dog ran to the house with a ball", "b": "le chat est sur la table avec le chien dans la maison et le jardin"}
    texts = {"a": [words["a"], words["a"][::2], words["a"][4:], words["b"]], "b": [words["b"], words["b"][3:], words["b"][6:]]}
    assert words["b"] not in language.consistent(texts)["a"]
    assert language.consistent({"a": ["x y"]}) == {"a": ["x y"]}


def test_long_lines_are_learned_and_long_texts_walked(spark):
    en, fr = "the cat sat on the mat and the dog ran to the house ", "le chat est sur la table avec le chien dans la maison "
    docs = spark.createDataFrame([(i, en if i % 2 else fr * (29_400 // len(fr)), "en" if i % 2 else "fr") for i in range(60)], "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["en", "fr"]
    assert {(r["lang"], r["lang_pred"]) for r in language.predicted(docs, model).collect()} == {("en", "en"), ("fr", "fr")}
    began = time.time()
    assert model.predict([fr * (10_000_000 // len(fr))])[0][0] == "fr"
    assert time.time() - began < 30


def test_pieces_cover_whole_texts(spark):
    """Every letter of a drawn text is in some piece; lines without spaces are cut in the middle."""
    text = " ".join(f"w{i}" for i in range(400)) + "\n" + "x" * 1000 + "\r\nend"
    got = language.labelled_sample(spark.createDataFrame([(1, text, "a"), (2, "other", None), (3, "12", "b")], "doc_id bigint, text string, lang string"))
    assert list(got) == ["a"] and max(map(len, got["a"])) <= language.PIECE
    assert sorted("".join(got["a"]).replace(" ", "")) == sorted(text.replace(" ", "").replace("\n", "").replace("\r", ""))


def test_stretches(monkeypatch):
    monkeypatch.setattr(language, "STRETCH", 7)
    samples = {"a": "the cat sat on the mat", "b": "le chat est sur la table"}
    model = language.Model({k: [v] for k, v in samples.items()})
    for t in ("the cat sat on the mat " * 9, "le chat", "the ca", ""):
        n, size = model.phrases([t])
        want = language.brute_force(model, samples, t)
        assert n[0].tolist() == [want["a"], want["b"]] and size[0] == len(model.codes(t))
