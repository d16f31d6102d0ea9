import random

from millrace.llm import tokens
from millrace.llm.common import table


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_like_the_library_on_odd_texts():
    rng, own, t = random.Random(3), tokens.Pieces(tokens.vocabulary_path()), library()
    bits = [" ", "  ", "\n", "\t ", " \n", "word", "don't", "é", "123", "<|endoftext|>", "　", "\xa0", "\x1c", "!?", "日本語", "🙂", "'s", " ", "\r\n", "ſ", "x" * 60]
    texts = ["", " ", "  a", "a  ", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(3000))]
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert own.counts(texts) == want
    assert own.counts(texts) == want  # from what is remembered
    assert all(len(p) <= tokens.LONG_PART for p in own.known)


def test_documents(spark, data):
    docs = table(spark, data, "documents")
    got = {r["doc_id"]: r for r in tokens.op6_token_counts(spark, data).collect()}
    rows = docs.collect()
    want = library().encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)
    for r, e in zip(rows, want, strict=True):
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_bytes"], g["over_limit"]) == (len(e.ids), len((r["text"] or "").encode()), len(e.ids) > 512)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "a b", 1), (2, "a b", 1), (None, "", 1)], "doc_id bigint, text string, n_tokens int")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tokens.count(docs).collect()) == [(0, 0), (1, 0), (2, 2), (2, 2)]
    assert tokens.count(docs.limit(0)).collect() == []
