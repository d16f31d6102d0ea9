import hashlib
import hmac
import time

import pytest
import regex

from millrace.llm import pii
from millrace.llm.common import table

LUHN = lambda s: sum((d * 2 - 9 * (d > 4) if i % 2 else d) for i, d in enumerate(int(c) for c in reversed(s))) % 10 == 0
IBAN_OK = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
KEY = "a test's key"


def out(spark, texts, key=KEY, columns=("k", 3)):
    docs = spark.createDataFrame([(i, t, *columns) for i, t in enumerate(texts)], "doc_id bigint, text string, kind string, n_entities int")
    return {r["doc_id"]: r for r in pii.replaced(docs, key).collect()}


# -- the whole operator in plain Python ------------------------------------------------------------------------------

ENTITY = regex.compile(pii.ENTITY)
DIGITS, LATIN, CYRILLIC, GREEK = "0123456789", *(pii.ALPHABETS[k] for k in ("latin", "cyrillic", "greek"))


def kind_and_canon(e):
    """[(kind, canon, lead, raw)] of an entity."""
    digits = "".join(c for c in e if c in DIGITS)
    if "@" in e:
        return [("email", e.lower(), "", e)]
    if regex.match("[A-Z]{2}[0-9]{2}", e):
        return [("iban", e.replace(" ", ""), "", e)]
    if ":" in e:
        return [("ipv6", e.lower(), "", e)]
    if e.count(".") == 3 and e.replace(".", "").isdigit():
        return [("ip", e, "", e)]
    if regex.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", e):
        return [("ssn", digits, "", e)]
    if e[0] in "+(" or (e[0] in DIGITS and len(digits) == 10):
        return [("phone", digits if e[0] == "+" else "1" + digits, "", e)]
    if e[0] in DIGITS:
        return [("card", digits, "", e)]
    honorific, *names = regex.match(rf"({pii.HONORIFIC}\s+)({pii.NAME})(?: ({pii.NAME}))?$", e).groups()
    title = regex.match(r"\w+", honorific)[0]
    gender = "f" if title in pii.WOMEN else "m" if title in pii.MEN else "x"
    script = lambda n: "cyrillic" if regex.search(r"\p{Cyrillic}", n) else "greek" if regex.search(r"\p{Greek}", n) else "latin"
    first, last = names
    if last is None:
        return [(f"last:x:{script(first)}", first.lower(), honorific, first)]
    return [(f"first:{gender}:{script(first)}", first.lower(), honorific, first), (f"last:x:{script(last)}", last.lower(), " ", last)]


def plain_surrogate(kind, canon, attempt):
    digest = lambda m: hmac.new(KEY.encode(), m.encode(), hashlib.sha256).hexdigest()
    a = digest(f"{kind}\n{canon}\n{attempt}")
    byte = lambda i: int(a[i % 32 * 2 : i % 32 * 2 + 2], 16)
    pick = lambda alphabet, i: alphabet[byte(i) % len(alphabet)]

    def chars(text):
        alphabet = lambda c: DIGITS if c in DIGITS else CYRILLIC if regex.match(r"\p{Cyrillic}", c) else GREEK if regex.match(r"\p{Greek}", c) else LATIN if c.isalpha() else None
        return "".join(pick(alphabet(c), i + 1) if alphabet(c) else c for i, c in enumerate(text))

    over = max(attempt - pii.OWN_FORM, 0)
    longer = "".join(pick(DIGITS, i + 20) for i in range(over))
    if kind == "email":
        local, domain = canon.split("@")
        host = digest(domain)[:8].translate(str.maketrans(DIGITS, "ghijklmnop"))
        return chars(local) + "".join(pick(LATIN, i + 20) for i in range(attempt)) + f"@{host}.example"
    if kind == "ip":
        return ".".join(str(byte(i) % 254 + 1) for i in range(4 + over))
    if kind == "ipv6":
        return "2001:db8:" + ":".join(a[i * 4 : i * 4 + 4] for i in range(6))
    if kind == "phone":
        code = regex.match(pii.COUNTRY, canon)[0]
        return code + str(byte(0) % 8 + 2) + chars(canon)[len(code) + 1 :] + longer
    if kind == "ssn":
        return "9" + chars(canon)[1:] + longer
    if kind == "card":
        body = canon[0] + chars(canon)[1:-1]
        check = next(c for c in DIGITS if LUHN(body + c))
        return body + (check if LUHN(canon) else str((int(check) + byte(31) % 9 + 1) % 10)) + longer
    if kind == "iban":
        bank = chars(canon[4:].lower()).upper()
        return next(f"{canon[:2]}{n:02d}{bank}" for n in range(2, 99) if IBAN_OK(f"{canon[:2]}{n:02d}{bank}")) + longer
    _, gender, script = kind.split(":")
    return "".join(pick(pii.SYLLABLES[script], i) for i in range(3 + attempt)) + pii.ENDINGS[script]["mfx".index(gender)]


def cased(raw, new):
    return new.upper() if raw.upper() == raw and len(raw) > 1 else new[:1].upper() + new[1:]


def plain(texts):
    """Each text replaced, by the rules of the module's description."""
    found = [[kind_and_canon(m[0]) for m in ENTITY.finditer(t or "")] for t in texts]
    left = sorted({(kind, canon) for ms in found for m in ms for kind, canon, _, _ in m})
    taken, new, attempt = {c for _, c in left}, {}, 0
    while left:
        tried = [(plain_surrogate(k, c, attempt), k, c) for k, c in left]
        won = {}
        for s, k, c in sorted(tried):
            if s not in taken and s not in won:
                won[s] = (k, c)
        new |= {e: s for s, e in won.items()}
        taken |= won.keys()
        left, attempt = [e for e in left if e not in new], attempt + 1

    def written(kind, canon, lead, raw):
        s = new[kind, canon]
        if kind == "email":
            return s.upper() if raw == raw.upper() else s
        if kind in ("ip", "ipv6"):
            return s
        if ":" in kind:
            return lead + cased(raw, s)
        s = iter(s[1:] if kind == "phone" and raw[0] != "+" else s)
        return "".join(next(s) if c.isalnum() else c for c in raw) + "".join(s)

    result = []
    for t, ms in zip(texts, found, strict=True):
        names = {}
        for kind, canon in sorted({(k, c) for m in ms for k, c, _, _ in m if ":" in k}):
            names[canon] = new[kind, canon]

        def bare(m, names=names):
            w = m[0]
            base = w if w.lower() in names else regex.sub("['’]s$", "", w)
            return cased(base, names[base.lower()]) + w[len(base) :] if base.lower() in names and w[0].isupper() else w

        gaps = [regex.sub(r"[\p{L}'’-]++", bare, g) if names else g for g in ENTITY.split(t or "")]
        result.append(t if not ms else "".join(g + o for g, o in zip(gaps, ["".join(written(*p) for p in m) for m in ms] + [""], strict=True)))
    return result


TEXTS = [
    "Write to Ann.Lee7@mail3.example.com or +1 (017) 555-7713, from 97.51.17.173. Or (017) 555-7713, ANN@B.CO.UK.",
    "ann.lee7@mail3.example.com again, +1-017-555-7713; card 4485 1688 4491 7329 and 4845168114407329, id 078-05-1120",
    "Mrs. Jane SMITH met Mr Smith and господин Иванов, then Frau Weiß. Smith's dog bit Jane, not Smithson; smith left. ИВАНОВ!",
    "Call +44 20 7946 0958 or +971 4 123 4567 or 555-123-4567. Pay DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819.",
    "Dr. House at 2001:db8:85a3:0:0:8a2e:370:7334 and fe80:1:2::8a2e; жук@почта.ru, жук@mail.ru, κύριος Νικος Παππας",
    "clean text with 3.14 and 2024-01-02 and v1.2.3 and a@b", None, "", "Mr. " + "x" * 100000, "std::vector, a::b, 12:30:15, AB12",
]


@pytest.fixture(scope="module")
def got(spark):
    return out(spark, TEXTS)


def test_like_plain_python(spark, got):
    assert [got[i]["text"] for i in range(len(TEXTS))] == plain(TEXTS)
    assert [got[i]["n_entities"] for i in range(len(TEXTS))] == [5, 5, 4, 5, 5, 0, 0, 0, 0, 0]
    assert all(r["kind"] == "k" for r in got.values())
    assert out(spark, TEXTS[:1], key="other")[0]["text"] != got[0]["text"]


def test_forms_are_kept(got):
    a, b, c, d, e = (got[i]["text"] for i in range(5))
    m = regex.fullmatch(r"Write to ([a-z]{3}\.[a-z]{3}\d@[a-p]+\.example) or (\+1 \(\d{3}\) \d{3}-\d{4}), from (\d+\.\d+\.\d+\.\d+)\. Or (\(\d{3}\) \d{3}-\d{4}), [A-Z]{3}@[A-P]+\.EXAMPLE\.", a)
    assert m[2][3:] == m[4]
    assert m[1] in b and regex.sub(r"\D", "", m[2]) == regex.sub(r"\D", "", regex.search(r"\+1-[\d-]+", b)[0])
    grouped, single = regex.search(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}),", b).groups()
    assert grouped[0] == single[0] == "4" and LUHN(grouped.replace(" ", "")) == LUHN("4485168844917329") and LUHN(single) == LUHN("4845168114407329")
    m = regex.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+) and господин ([А-Яа-я]+), then Frau (\w+)\. (\w+)'s dog bit (\w+), not Smithson; smith left\. ([А-Я]+)!", c)
    assert m[2] == m[3].upper() and m[1].endswith("na") and m[6] == m[3] and m[7] == m[1] and m[8] == m[4].upper()
    m = regex.fullmatch(r"Call \+44 \d{2} \d{4} \d{4} or \+971 \d \d{3} \d{4} or \d{3}-\d{3}-\d{4}\. Pay (DE\d{2} \d{4} \d{4} \d{4} \d{4} \d{2}) or (GB\d{2}[A-Z]{4}\d{14})\.", d)
    assert IBAN_OK(m[1].replace(" ", "")) and IBAN_OK(m[2])
    assert regex.fullmatch(r"Dr\. \w+ at 2001:db8(:[0-9a-f]{4}){6} and 2001:db8(:[0-9a-f]{4}){6}; жук@почта\.ru, [а-я]{3}@[a-p]+\.example, κύριος \p{Greek}+ \p{Greek}+", e)


def test_distinct_entities_stay_distinct(spark):
    numbers = [f"{i:03d}-{j:02d}-{k:04d}" for i in range(100, 110) for j in range(10, 20) for k in range(1000, 1020)]
    ips = [f"10.0.{i}.{j}" for i in range(40) for j in range(50)]
    got = out(spark, [" ".join(numbers), " ".join(ips)])
    for i, old in ((0, numbers), (1, ips)):
        new = got[i]["text"].split(" ")
        assert len(set(new)) == len(old) and not set(new) & set(old)


def test_full_forms_are_lengthened(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    old = [f"{c}@x{d}.com" for c in letters + DIGITS for d in range(10)]
    began = time.time()
    new = out(spark, [" ".join(old)])[0]["text"].split(" ")
    assert len(set(new)) == len(old) and len({x.split("@")[1] for x in new}) == 10
    assert time.time() - began < 60


def test_no_text_ends_the_executor(spark):
    n = 2 * 10**5
    texts = ["x@" + "a." * 10**6 + "com", "x@" + "a." * n, "a." * n + "@", "a-" * n, "+1" * n, "1-" * n, "1." * n, "1:" * n, "AB12" * n, "AB12 " * n, "Mr " * n, "Mr A" + "a𝐀" * n, "Mr" + " " * n, "((" * n, "@" * n]
    began = time.time()
    got = out(spark, texts)
    assert time.time() - began < 90
    assert got[0]["n_entities"] == 1 and regex.fullmatch(r"[a-z]@[a-p]{8}\.example", got[0]["text"])
    assert all(len(got[i]["text"]) == len(t) for i, t in enumerate(texts) if not got[i]["n_entities"])


def test_documents(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").collect()]
    spark.conf.set(pii.KEY_CONF, KEY)
    got = {r["doc_id"]: r for r in pii.op7_pii_surrogates(spark, data).collect()}
    spark.conf.unset(pii.KEY_CONF)
    assert [got[k]["text"] for k, _ in docs] == plain([t for _, t in docs])
    assert sum(r["n_entities"] > 0 for r in got.values()) > 0


def test_repeated_rows_hot_entities_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(pii, "HOT_MENTIONS", 2)
    docs = spark.createDataFrame([(1, "a@b.com"), (1, "a@b.com"), (None, "a@b.com"), (2, "c@d.com")], "doc_id bigint, text string")
    got = [r["text"] for r in pii.replaced(docs, KEY).collect()]
    assert len(got) == 4 and len(set(got)) == 2
    assert pii.replaced(docs.limit(0), KEY).collect() == []
    assert pii.replaced(docs).columns == ["doc_id", "text", "n_entities"]


def test_plans_do_not_show_the_key(spark, monkeypatch):
    key, plans = "supersecret-7f3a", []
    keep = pii.written
    monkeypatch.setattr(pii, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or keep(df, name))
    got = out(spark, TEXTS[:1], key=key)
    assert got and len(plans) > 3 and any("_inner" in p for p in plans)
    inner, outer = (bytes(b ^ x for b in key.encode()) for x in (0x36, 0x5C))
    for p in plans:
        assert not any(x in p or x.upper() in p for x in (key, inner.hex(), outer.hex())) and not any(str(list(x))[1:40] in p for x in (inner, outer))


def test_keyed_digest_is_hmac(spark):
    import hashlib
    import hmac

    row = spark.range(1).crossJoin(pii.pads(spark, "k" * 40)).select(pii.hmac(pii.F.lit("message é"))).first()[0]
    assert row == hmac.new(b"k" * 40, "message é".encode(), hashlib.sha256).hexdigest()
