import random
import re

from millrace.llm import decontamination
from millrace.llm.common import WORD
from tests.oracle import same

LOW = {65 + i: 97 + i for i in range(26)}


def plain(docs, items, size=10):
    words = lambda t: re.findall(WORD, (t or "").translate(LOW))
    windows = {}
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(k)
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                if (g := tuple(w[i : i + n])) in windows and len(g) == n:
                    hit |= set(range(i, i + n))
                    found |= windows[g]
        out.append((k, len(w), len(hit), sorted(map(str, found))))
    return sorted(out, key=str)


def got(spark, docs, items):
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id bigint, text string, term string, position int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contamination(d, i).collect()), key=str)


def test_like_plain_windows(spark):
    a = "The quick brown fox jumps over the lazy dog and then the quick brown fox sleeps"
    items = [(1, a), (2, "short item"), (3, ""), (4, None), (5, "one"), (6, "a a a a a a a a a a a"), (10, "two words"), (2, "short item")]
    docs = [
        (1, "x " + a.upper() + " y"), (2, "Short, item! two; WORDS"), (3, None), (4, ""), (5, "a " * 30), (6, "One one"), (7, "the quick brown fox jumps over the lazy cat"),
        (8, " ".join(a.split()[3:14])), (9, "z " * 50000 + "short item"), (1, "x " + a.upper() + " y"), (None, "one"), (11, "one two"),
    ]
    assert got(spark, docs, items) == plain(docs, items)
    assert got(spark, docs, []) == plain(docs, [])
    assert got(spark, [], items) == []


def near(docs, items, size=10, slop=3):
    """Items of each document by trying every stretch of it for every window."""
    words = lambda t: re.findall(WORD, (t or "").translate(LOW))
    out = []
    for k, t in docs:
        w, found = words(t), set()
        for item, u in items:
            v = words(u)
            for i in range(max(1, len(v) - size + 1) if v else 0):
                g = v[i : i + size]
                if any(set(g) <= set(w[j : j + len(g) + slop]) for j in range(len(w))):
                    found.add(str(item))
        out.append((k, sorted(found)))
    return sorted(out, key=str)


def test_proximity(spark):
    d = [(1, "alpha noise beta gamma delta epsilon"), (2, "epsilon delta x gamma beta alpha"), (3, "alpha a b c d e f beta gamma delta epsilon"), (4, None), (5, "pair of a kind"), (6, "alpha alpha beta beta x alpha")]
    i = [(1, "alpha beta gamma delta epsilon"), (2, "a pair"), (3, "kind"), (4, "alpha beta alpha"), (5, "alpha alpha")]
    rng = random.Random(3)
    d += [(100 + k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(60))) for k in range(60)]
    i += [(100 + k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([4, 5, 6, 12])))) for k in range(30)]
    docs = spark.createDataFrame(d, "doc_id bigint, text string")
    items = spark.createDataFrame(i, "item_id bigint, text string")
    found = decontamination.contamination(docs, items).collect()
    want = near(d, i)
    assert sorted(((r["doc_id"], r["near_items"]) for r in found), key=str) == want and sum(len(x) for _, x in want) > 50
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=str) == plain(d, i)


def test_against_sql(spark, data):
    same(spark, decontamination.op9_decontamination, decontamination.SQL, data)
