import hashlib
import random

import numpy as np

from millrace.llm import jaccard
from millrace.llm.common import table


def copies(seed: int) -> dict[int, str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out: dict[int, str | None] = {0: None, 1: "", 2: "?!", 3: "One two", 4: "one  TWO", 5: "one two three", 6: "x " * 40000}
    passage = [word() for _ in range(30)]
    for g in range(30):
        base = [word() for _ in range(rng.randint(20, 150))] + passage * (g % 2)
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            out[len(out) + 10] = " ".join(text)
    return out


def found(df) -> dict[int, tuple[int, int, int]]:
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in df.collect()}


def test_like_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 8)
    texts = copies(11)
    docs = spark.createDataFrame([(k, v, "c") for k, v in texts.items()], "doc_id bigint, text string, class string")
    assert found(jaccard.near_duplicates(docs)) == jaccard.brute_force(texts)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SET_BLOCK", 6)
    texts = copies(12)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert found(jaccard.near_duplicates(docs)) == jaccard.brute_force(texts)


def test_documents(spark, data):
    texts = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}
    assert found(jaccard.op8_jaccard_join(spark, data)) == jaccard.brute_force(texts)


def test_chained_sets_are_split_on_paths(spark, monkeypatch):
    for name, n in (("SMALL", 4), ("LARGE", 20), ("SET_BLOCK", 8), ("BLOCK", 16)):
        monkeypatch.setattr(jaccard, name, n)
    took: list[int] = []
    split = jaccard.split_on_paths
    monkeypatch.setattr(jaccard, "split_on_paths", lambda c, b: took.append(c.count()) or split(c, b))
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(700)]
    texts: dict[int, str | None] = {i: " ".join(words[3 * i : 3 * i + 80]) for i in range(200)}  # a chain: neighbours are similar
    base = [rng.choice(words) for _ in range(90)]
    for i in range(40):  # and a group of sets that are all alike
        texts[1000 + i] = " ".join([*base[: 40 + i % 2], f"n{i}", *base[41:]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got, want = found(jaccard.near_duplicates(docs)), jaccard.brute_force(texts)
    assert got == want and took and took[0] >= 200


def test_rows_are_told_apart_by_their_texts(spark):
    a, b = "a b c d e f", "some other words than those"
    docs = spark.createDataFrame([(7, a), (7, b), (9, b), (8, a), (None, a), (7, a), (5, None), (5, "")], "doc_id bigint, text string")
    got = jaccard.near_duplicates(docs).collect()
    keys = {t: {r["class_key"] for r in got if r["text_key"] == hashlib.md5(t.encode()).digest()} for t in (a, b)}
    assert all(len(k) == 1 for k in keys.values()) and keys[a] != keys[b]
    assert sorted((str(r["doc_id"]), r["class_id"], r["n_copies"], r["stays"]) for r in got) == [
        ("5", 5, 1, True), ("5", 5, 1, True), ("7", 7, 2, True), ("7", 7, 4, True), ("7", 7, 4, True), ("8", 7, 4, False), ("9", 7, 2, False), ("None", 7, 4, False),
    ]
    assert jaccard.near_duplicates(docs.limit(0)).collect() == []
    ids = docs.selectExpr("concat('id ', doc_id) as doc_id", "text")
    assert {r["class_id"] for r in jaccard.near_duplicates(ids).collect()} == {"id 7", "id 5"}


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}é" for i in range(3000)) + " " + "x" * 500
    whole = jaccard.shingles([text, "b c", text[5:]])
    monkeypatch.setattr(jaccard, "CHUNK", 64)
    assert all((a == b).all() for a, b in zip(whole, jaccard.shingles([text, "b c", text[5:]]), strict=True))


def test_hashes_agree_with_words():
    a, b, c = jaccard.shingles(["Eins zwei drei vier fünf sechs", "eins, ZWEI drei\nvier fünf", "sechs"])
    assert len(a) == 2 and len(b) == 1 and b[0] in a and len(c) == 1
    near = jaccard.exact([np.arange(10, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(5, 30, dtype=np.uint64)], 0.8)
    assert near.tolist() == [[False, True, False], [True, False, False], [False, False, False]]


def test_pairs_of_blocks_add_only_what_joins():
    near = np.ones((6, 6), bool)
    part = np.array([0, 0, 0, 1, 1, 1])
    assert len(jaccard.links_of(near, part, True)) == 5 and len(jaccard.links_of(near, part, False)) == 1
    near = np.eye(6, dtype=bool)
    near[0, 3] = near[3, 0] = near[1, 3] = near[3, 1] = near[4, 2] = near[2, 4] = True
    assert sorted(jaccard.links_of(near, part, False)) == [(0, 3), (1, 3), (2, 4)]
    assert jaccard.links_of(np.eye(6, dtype=bool), part, False) == []
