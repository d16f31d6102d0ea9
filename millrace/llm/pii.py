"""Surrogates for personal data, by DataFrame operations alone.

One pattern finds e-mail addresses, IP addresses, phone numbers, IBANs, card and social-security numbers, and names
after an honorific; other mentions of such a name in the same text are found by it. Each distinct entity gets a
replacement made from an HMAC of its canonical form: digits stay digits, letters letters of their case and script, a
phone number keeps its country code, an IBAN its country and valid check digits, a card its first digit and whether its
check digit holds, a name its honorific, gender and script. Replacements are tried, in ever longer forms, until none
equals another entity's replacement or any entity of the corpus, so distinct entities stay distinct and mentions of one
entity, however written, get one replacement. Only documents that hold an entity are shuffled.

Every repetition in the patterns is bounded or possessive: they never recurse or go back, so a text of any length is
searched in one pass with a flat stack.
"""

from __future__ import annotations

import itertools
import logging
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

log = logging.getLogger(__name__)

#: Names the session's setting with the secret of the keyed digest; without it each run draws its own.
KEY_CONF = "spark.millrace.pii.key"
#: Attempts in an entity's own form; further ones lengthen it, so some attempt always finds a free replacement.
OWN_FORM = 12
#: An entity with more mentions than this, or than a two-thousandth of all, is joined in so many parts.
HOT_MENTIONS, HOT_PARTS = 100_000, 64

# fixed values: honorifics by gender
MEN = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин", "κύριος", "Κύριος")
WOMEN = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа", "κυρία", "Κυρία")
EITHER = ("Dr", "Prof")
# fixed values: syllables of replacement names, and endings by gender, for each script
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fe", "ga", "ka", "ke", "la", "lo", "ma", "mi", "na", "no", "ra", "re", "sa", "so", "ta", "ve"),
    "cyrillic": ("ба", "ве", "га", "до", "жа", "ка", "ле", "ма", "но", "па", "ра", "се", "та", "фе", "хо", "ша"),
    "greek": ("βα", "γε", "δα", "ζο", "θα", "κα", "λε", "μα", "νο", "πα", "ρε", "σα", "το", "φα", "χε", "ψα"),
}
ENDINGS = {"latin": ("n", "na", "l"), "cyrillic": ("н", "на", "л"), "greek": ("ς", "να", "λης")}
# fixed values: the alphabets of letters that are replaced one by one
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
DIGITS = "0123456789"
# fixed value: country calling codes, of one, two or three digits
COUNTRY = r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

HONORIFIC = "(?:" + "|".join(sorted(MEN + WOMEN + EITHER, key=len, reverse=True)) + r")\.?"
SPACE = r"[ \t\r\n]"
NAME = r"\p{Lu}[\p{L}'’-]++"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?<=\.[A-Za-z]{2,24})"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
GROUP = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![:.])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{2,6}}(?::{GROUP}){{1,5}})(?![\w:])"
PHONE = r"(?:(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w-])|(?<![\w+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![\w-]))"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
CARD = r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![\w-]|\.[0-9])"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![\w])"
PERSON = rf"{HONORIFIC}{SPACE}{{1,4}}+{NAME}(?:[ ]{NAME})?+"
#: Most places fail the first test of a branch: an entity starts no word in its middle.
ENTITY = rf"{EMAIL}|(?<![\p{{L}}\p{{N}}_])(?:(?=[0-9+(])(?:{IP}|{PHONE}|{SSN}|{CARD})|(?=[A-Z]{{2}}[0-9]){IBAN}|(?={GROUP}:){IPV6}|{PERSON})"
#: What any entity but a name holds. Names are hinted at by honorifics, looked for one by one: far quicker than a pattern of all.
HINT = rf"@|[0-9](?:\.[0-9]|[0-9]{{3}}|-[0-9])|\+[0-9]|\([0-9]|:{GROUP}:|[A-Z]{{2}}[0-9]{{2}}"


def may_hold(text: Column) -> Column:
    """Whether a text may hold an entity; most do not and are not searched further."""
    return text.rlike("[@0-9]|:[A-Fa-f]") & text.rlike(HINT) | reduce(Column.__or__, map(text.contains, MEN + WOMEN + EITHER))


def kind_of(entity: Column) -> Column:
    tests = (("email", "@"), ("iban", "^[A-Z]{2}[0-9]{2}"), ("ipv6", ":"), ("ip", r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\."), ("ssn", "^[0-9]{3}-[0-9]{2}-"), ("card", "^[0-9]{4}(?:[ -]|[0-9]{9})"), ("phone", "^[0-9+(]"))
    return reduce(lambda out, t: F.when(entity.rlike(t[1]), t[0]).otherwise(out), reversed(tests), F.lit("person"))


def script_of(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def canonical(kind: Column, entity: Column) -> Column:
    """One spelling of an entity: a number without its separators, a national phone number with its country code."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    phone = F.when(entity.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits))
    return F.when(kind.isin("ssn", "card"), digits).when(kind == "phone", phone).when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(F.lower(entity))


def parts_of(entity: Column) -> Column:
    """array<struct<kind,canon,lead,raw>>: an entity as the parts that are replaced, each with the text before it."""
    kind = kind_of(entity)
    whole = F.array(F.struct(kind.alias("kind"), canonical(kind, entity).alias("canon"), F.lit("").alias("lead"), entity.alias("raw")))
    group = lambda i: F.regexp_extract(entity, rf"^({HONORIFIC}{SPACE}+)({NAME})(?:( )({NAME}))?$", i)
    gender = F.when(entity.rlike(rf"^(?:{'|'.join(WOMEN)})\b"), "f").when(entity.rlike(rf"^(?:{'|'.join(MEN)})\b"), "m").otherwise("x")
    part = lambda role, lead, raw: F.struct(F.concat_ws(":", F.lit(role), gender if role == "first" else F.lit("x"), script_of(raw)).alias("kind"), F.lower(raw).alias("canon"), lead.alias("lead"), raw.alias("raw"))
    single = F.array(part("last", group(1), group(2)))
    two = F.array(part("first", group(1), group(2)), part("last", group(3), group(4)))
    return F.when(kind != "person", whole).when(group(4) == "", single).otherwise(two)


def pads(spark: SparkSession, key: str) -> DataFrame:
    """One row with the key's two pads as _inner and _outer: plans name the columns, and so do not show the key."""
    block = key.encode()
    if len(block) > 64:
        raise ValueError("the key is longer than 64 bytes")
    pad = lambda x: bytearray(b ^ x for b in block.ljust(64, b"\0"))
    return spark.createDataFrame([(pad(0x36), pad(0x5C))], "_inner binary, _outer binary")


def hmac(message: Column) -> Column:
    """HMAC-SHA256 of a string beside the key's pads, as hexadecimal digits."""
    return F.sha2(F.concat("_outer", F.unhex(F.sha2(F.concat("_inner", message.cast("binary")), 256))), 256)


def _byte(digest: Column, i: Column | int) -> Column:
    """The i-th byte of a hexadecimal digest, from 0 and around."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(digest, at % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, digest: Column, i: Column) -> Column:
    return F.substring(F.lit(alphabet), _byte(digest, i) % len(alphabet) + 1, F.lit(1))


def _each(text: Column, f) -> Column:
    """text with every character c at place i (from 1) as f(c, i)."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: f(F.substring(text, i, F.lit(1)), i)), "")


def _chars(text: Column, digest: Column) -> Column:
    """text with digits and lower-case letters replaced by others of their kind."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), _pick(DIGITS, digest, i)).when(c.rlike(r"\p{IsCyrillic}"), _pick(ALPHABETS["cyrillic"], digest, i))
        return out.when(c.rlike(r"\p{IsGreek}"), _pick(ALPHABETS["greek"], digest, i)).when(c.rlike(r"\p{L}"), _pick(ALPHABETS["latin"], digest, i)).otherwise(c)

    return _each(text, one)


def _luhn_sum(digits: Column) -> Column:
    place = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(place(i))).otherwise(place(i)))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of the number that an IBAN's letters (A is 10) and digits spell."""
    c = lambda i: F.substring(text, i, F.lit(1))
    step = lambda a, i: F.when(c(i).rlike("[0-9]"), a * 10 + c(i).cast("int")).otherwise(a * 100 + F.ascii(c(i)) - 55) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def surrogate(kind: Column, canon: Column, attempt: Column, a: Column, domain: Column) -> Column:
    """The attempt-th replacement of a canonical entity, in canonical form; a and domain are digests, columns of their own."""
    more = lambda n, alphabet: F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(alphabet, a, i + 19)), "")).otherwise("")
    longer = more(F.greatest(attempt - OWN_FORM, F.lit(0)), DIGITS)
    rest = lambda text, n: F.substring(text, n + 1, F.length(text))
    # a domain's replacement hangs on the domain alone, under a name that is reserved for examples
    local = F.concat(_chars(F.regexp_extract(canon, "^([^@]*)@", 1), a), more(attempt, ALPHABETS["latin"]))
    email = F.concat(local, F.lit("@"), F.translate(F.substring(domain, 1, 8), DIGITS, "ghijklmnop"), F.lit(".example"))
    octet = lambda i: (_byte(a, i) % 254 + 1).cast("string")
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3) + F.greatest(attempt - OWN_FORM, F.lit(0))), octet), ".")
    ipv6 = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(a, i * 4 + 1, F.lit(4))), ":"))
    code = F.regexp_extract(canon, f"^{COUNTRY}", 0)
    digits = _chars(canon, a)
    # the first digit after the country code is no trunk prefix
    phone = F.concat(code, (_byte(a, 0) % 8 + 2).cast("string"), rest(digits, F.length(code) + 1), longer)
    ssn = F.concat(F.lit("9"), rest(digits, F.lit(1)), longer)
    body = F.concat(F.substring(canon, 1, 1), F.substring(digits, F.lit(2), F.length(digits) - 2))
    check = F.pmod(F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    off = F.when(_luhn_sum(canon) % 10 == 0, 0).otherwise(_byte(a, 31) % 9 + 1)
    card = F.concat(body, ((check + off) % 10).cast("string"), longer)
    bank = F.upper(_chars(F.lower(rest(canon, F.lit(4))), a))
    land = F.substring(canon, 1, 2)
    iban = F.concat(land, F.lpad((F.lit(98) - _mod97(F.concat(bank, land, F.lit("00")))).cast("string"), 2, "0"), bank, longer)

    def name(script: str) -> Column:
        own, (m, f, x) = SYLLABLES[script], ENDINGS[script]
        stems = F.array(*map(F.lit, own))
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + attempt), lambda i: F.element_at(stems, _byte(a, i) % len(own) + 1)), "")
        return F.concat(stem, F.when(kind.contains(":f:"), f).when(kind.contains(":m:"), m).otherwise(x))

    names = reduce(lambda out, s: F.when(kind.endswith(s), name(s)).otherwise(out), ("cyrillic", "greek"), name("latin"))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "phone", phone)
    return out.when(kind == "ssn", ssn).when(kind == "card", card).when(kind == "iban", iban).otherwise(names)


def named(raw: Column, new: Column) -> Column:
    """A replacement name in the case of the mention."""
    return F.when((F.upper(raw) == raw) & (F.length(raw) > 1), F.upper(new)).otherwise(F.initcap(new))


def rendered(kind: Column, raw: Column, new: Column) -> Column:
    """A canonical replacement written as the mention was: its separators, or its letters' case."""
    one, mark = F.lit(1), F.when(kind == "iban", F.lit("[^A-Z0-9]")).otherwise(F.lit("[^0-9]"))
    held = F.length(F.regexp_replace(raw, mark, F.lit("")))
    # a national phone number leaves the country code out
    own = F.when((kind == "phone") & ~raw.startswith("+"), F.substring(new, F.lit(2), F.length(new))).otherwise(new)
    at = lambda i: F.length(F.regexp_replace(F.substring(raw, one, i), mark, F.lit("")))
    in_form = F.concat(_each(raw, lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substring(own, at(i), one)).otherwise(c)), F.substring(own, held + 1, F.length(own)))
    email = F.when(F.upper(raw) == raw, F.upper(new)).otherwise(new)
    return F.when(kind.isin("phone", "ssn", "card", "iban"), in_form).when(kind.isin("ip", "ipv6"), new).when(kind == "email", email).otherwise(named(raw, new))


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, new for distinct entities (kind, canon): no two share a replacement, none is an entity itself."""
    entities = written(entities.select("kind", "canon").distinct(), "entities")
    secret = F.broadcast(pads(entities.sparkSession, key))  # one row
    taken = entities.select(F.col("canon").alias("new")).distinct()
    left, done = entities, None
    for attempt in itertools.count():
        tried = left.withColumn("_try", F.lit(attempt))
        message = F.concat_ws("\n", "kind", "canon", F.col("_try").cast("string"))
        # the shuffle keeps the digests columns: inlined, they would be computed anew for every character
        keyed = tried.crossJoin(secret).select(*tried.columns, hmac(message).alias("_a"), hmac(F.regexp_extract("canon", "@(.*)$", 1)).alias("_d")).repartition("kind", "canon")
        new = keyed.select("kind", "canon", surrogate(F.col("kind"), F.col("canon"), F.col("_try"), F.col("_a"), F.col("_d")).alias("new"))
        free = new.join(taken, "new", "left_anti")
        if done is not None:
            free = free.join(done.select("new"), "new", "left_anti")
        won = written(free.groupBy("new").agg(F.min(F.struct("kind", "canon")).alias("e")).select("e.kind", "e.canon", "new"), "surrogates")
        done = won if done is None else done.unionByName(won)
        left = written(left.join(won, ["kind", "canon"], "left_anti"), "open")
        if left.isEmpty():
            return done
    raise AssertionError  # count() does not end


def with_replacement(each: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions (kind, canon, ...) with new: an entity that holds a large part of all mentions is met in HOT_PARTS parts."""
    number = written(each.groupBy("kind", "canon").agg(F.count("*").alias("n")), "mentions")
    most = max(HOT_MENTIONS, (number.agg(F.sum("n")).first()[0] or 0) // 2000)
    hot = number.where(F.col("n") > most).select("kind", "canon", F.lit(HOT_PARTS).alias("_parts"))  # fewer than 2,000 rows
    parts = F.coalesce("_parts", F.lit(1))
    left = each.join(F.broadcast(hot), ["kind", "canon"], "left").withColumn("_part", F.floor(F.rand(7) * parts).cast("int")).drop("_parts")
    right = new.join(F.broadcast(hot), ["kind", "canon"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, ["kind", "canon", "_part"]).drop("_part")


def replaced(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with personal data in text replaced, and n_entities; other columns stay.

    key: the secret of the digests; without it the session's spark.millrace.pii.key, and without that a random one,
    so that runs differ. n_entities counts the pattern's matches, not further mentions of their names; a column of
    that name is replaced. Null and empty texts and texts without an entity stay as they are, with n_entities 0;
    repeated rows are each replaced, alike; texts of any length are searched whole.
    """
    spark = docs.sparkSession
    key = key or spark.conf.get(KEY_CONF, None)
    if not key:
        key = secrets.token_hex(32)
        log.warning("%s is not set: surrogates of this run hang on a key that is not kept", KEY_CONF)
    columns = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*columns)
    row, found, parts = "_pii_row", "_pii_found", "_pii_parts"
    text = F.coalesce("text", F.lit(""))
    plain = docs.where(~(may_hold(text) & text.rlike(ENTITY))).withColumn("n_entities", F.lit(0).cast("long"))
    # the row number keeps the filter above the search: pushed below, it would search every text twice
    search = F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    held = written(docs.withColumns({row: F.monotonically_increasing_id(), found: search}).where(F.size(found) > 0), "carriers")
    mention = held.select(row, F.posexplode(found).alias("at", "entity")).select(row, "at", parts_of(F.col("entity")).alias(parts))
    each = mention.select(row, "at", F.posexplode(parts).alias("part", "p")).select(row, "at", "part", "p.*")
    out = with_replacement(each, mapping(each, key)).withColumn("out", F.concat("lead", rendered(F.col("kind"), F.col("raw"), F.col("new"))))
    joined = out.groupBy(row, "at").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "out"))), lambda x: x["out"]), "").alias("out"),
        F.filter(F.collect_list(F.when(F.col("kind").contains(":"), F.struct("canon", "kind", "new"))), lambda x: x.isNotNull()).alias("who"),
    )
    by_row = joined.groupBy(row).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]).alias("_pii_out"),
        F.array_distinct(F.flatten(F.collect_list("who"))).alias("_pii_who"),
    )
    # one name may be of several kinds: a bare mention takes the last by kind, a family name
    who = F.array_sort("_pii_who")
    last = F.filter(who, lambda x, i: (i == F.size(who) - 1) | (x["canon"] != F.get(who, i + 1)["canon"]))
    names = F.map_from_entries(F.transform(last, lambda x: F.struct(x["canon"], x["new"])))
    back = held.join(by_row, row).withColumn("_pii_names", names).withColumn("_pii_gaps", F.split("text", ENTITY, -1))
    gaps = F.when(F.size("_pii_names") > 0, F.transform("_pii_gaps", lambda gap: with_names(gap, F.col("_pii_names")))).otherwise(F.col("_pii_gaps"))
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, F.concat("_pii_out", F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    back = back.withColumn("n_entities", F.size(found).cast("long")).withColumn("text", rebuilt)
    return plain.unionByName(back.select(*columns, "n_entities"))


def with_names(gap: Column, names: Column) -> Column:
    """The text between entities with words that are names of the map, also before 's, replaced as those are."""

    def word(w: Column) -> Column:
        base = F.regexp_replace(w, "['’]s$", "")
        new = F.when(w.rlike(r"^\p{Lu}"), F.coalesce(names[F.lower(w)], names[F.lower(base)]))
        own = F.when(names[F.lower(w)].isNotNull(), w).otherwise(base)
        return F.when(new.isNull(), w).otherwise(F.concat(named(own, new), F.substring(w, F.length(own) + 1, F.length(w))))

    return F.array_join(F.transform(F.regexp_extract_all(gap, F.lit(r"[\p{L}'’-]++|[^\p{L}'’-]++"), F.lit(0)), word), "")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by surrogates."""
    return replaced(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")
