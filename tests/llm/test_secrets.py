import base64
import random

from millrace.llm import secrets


def test_like_plain_search():
    rng, words = random.Random(5), secrets.automaton()
    bits = ["token", "TOKEN=", "secret: ", "api_key", "apikey = '", "password\"", ":", "=", " ", "abcdef0123456789", "0123456789abcdef" * 2, "AKIA", "ABCDEFGHIJKLMNOP", "zz", "é", "İ", "K", "passwd", "a1", "deadbeefdeadbeef", "ſecret=abcdefghijklmnop", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        assert [s for s in secrets.spans(t, words) if s[1] < 3] == secrets.brute_force(t), t


def test_checked_tokens_and_consumed_hits():
    words = secrets.automaton()
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = f"ghp_{body}{secrets.base62_crc(body)}"
    assert secrets.spans(f"x {good} y", words) == [(2, 3, 2 + len(good))]
    assert secrets.spans(f"x ghp_{body}000000 y", words) == []
    assert secrets.spans("token: secret: abcdefghijklmno", words) == []  # the short match takes the second keyword


def test_key_headers_and_web_tokens():
    words = secrets.automaton()
    head = "-----BEGIN RSA PRIVATE KEY-----"
    assert secrets.spans(f"x {head} y -----BEGIN CERTIFICATE-----", words) == [(2, 4, 2 + len(head))]
    part = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    good, bad = (f"{part(h)}.{part('{"sub": 1}')}.c2ln" for h in ('{"alg": "HS256"}', '{"no": 1}'))
    assert secrets.spans(f"a {good} {bad} eyJx.eyJ", words) == [(2, 5, 2 + len(good))]
    assert secrets.spans("-----BEGIN " * 50000 + "eyJ" * 50000, words) == []


def test_rows(spark):
    docs = spark.createDataFrame([(1, 'a token = "0123456789abcdef0123"', "k"), (2, None, "k"), (2, "", "k"), (None, "x" * 300000 + " AKIA" + "A" * 16, "k")], "doc_id bigint, text string, spans string")
    got = {(r["doc_id"], r["spans"]) for r in secrets.spark_digest(secrets.scan(docs)).collect()}
    assert got == {(1, "assign:2:31,hex:11:31"), (2, ""), (None, "access:300001:300021")}
    digest = {r["doc_id"]: r["base_sha256"] for r in secrets.spark_digest(secrets.scan(docs)).collect()}
    assert digest[1] == secrets.digest([(2, 0, 31), (11, 2, 31)])
    kept = secrets.without_secrets(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2, 2]
    assert secrets.scan(docs.limit(0)).collect() == []
