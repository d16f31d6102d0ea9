import hashlib
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat
from millrace.llm.common import table

TEXT = st.text(alphabet="<|\\im_endstar>\n aé", max_size=40)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
@settings(max_examples=500, deadline=None)
def test_reads_back(turns):
    formatted, _ = chat.rendered(turns)
    assert chat.read_back(formatted) == turns


def test_fold(spark):
    rows = [
        (1, 1, "a", "assistant", 0, "open", ""), (1, 1, "a", "assistant", 2, "delta", "lo"), (1, 1, "a", "assistant", 1, "delta", "hel"),
        (1, 0, "u", "user", 0, "open", "hi"), (1, 2, "b", "assistant", 0, "open", "x"), (1, 2, "b", None, 1, "regenerate", None), (1, 2, "b", None, 2, "delta", "new"),
        (1, 3, "c", "user", 0, "open", "gone"), (1, 3, "c", "user", 1, "delete", ""), (1, 4, "d", "user", 0, "open", "one"), (1, 4, "d", "user", 1, "edit", "two"),
    ]
    log = spark.createDataFrame(rows, "conv_id bigint, turn bigint, message string, role string, seq bigint, kind string, text string")
    got = chat.format_log(log).collect()
    turns = [("user", "hi"), ("assistant", "hello"), ("assistant", "new"), ("user", "two")]
    assert [chat.read_back(r["formatted"])[0] for r in got] == turns and [r["place"] for r in got] == [0, 1, 2, 3]
    (whole,) = chat.conversations(chat.format_log(log)).collect()
    text, mask = chat.rendered(turns)
    assert (whole["formatted"], [(m["start"], m["end"]) for m in whole["mask"]]) == (text, mask)
    assert chat.format_log(log.limit(0)).collect() == []


def test_digests_and_probe(spark, data):
    rows = table(spark, data, "conversations").collect()
    want: dict = {-1: [(0, "user", chat.PROBE), (1, "assistant", chat.PROBE)]}
    for r in rows:
        want.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    got = {r["conv_id"]: r for r in chat.op10_chat_format(spark, data).collect()}
    assert got.keys() == want.keys()
    for k, turns in want.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert got[k]["n_turns"] == len(turns) and got[k]["loss_chars"] == len(loss)
        assert got[k]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, 5, "assistant", "y" * 200000)], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.format_log(chat.events_of(rows))).collect()}
    assert got == {1: (2, 0), None: (1, 0), 2: (1, 200000)}


def plain_fold(events):
    """Turns of each conversation by a fold over its sorted events."""
    out: dict = {}
    for e in sorted(events, key=lambda e: (e["conv_id"], e["turn"], e["message"], e["seq"])):
        m = out.setdefault(e["conv_id"], {}).setdefault((e["turn"], e["message"]), {"text": "", "gone": False})
        m["role"] = e["role"]
        m["text"] = e["text"] if e["kind"] in ("open", "edit") else "" if e["kind"] == "regenerate" else m["text"] + e["text"]
        m["gone"] = e["kind"] == "delete"
    return {k: [(m["role"], m["text"]) for _, m in sorted(v.items()) if not m["gone"]] for k, v in out.items()}


def test_log_of_the_query_uses_every_kind_and_folds_back(spark, data):
    rows = table(spark, data, "conversations")
    events = chat.events_of(rows, delta=40).collect()
    kinds = {e["kind"] for e in events}
    assert kinds == {"open", "delta", "edit", "regenerate", "delete"} and max(e["seq"] for e in events) > 5
    want: dict = {}
    for r in rows.collect():
        want.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    assert plain_fold(events) == {k: [(role, t) for _, role, t in sorted(v)] for k, v in want.items()}


def test_a_hundred_thousand_deltas_and_a_long_conversation(spark):
    n = 100_000
    deltas = spark.range(n).selectExpr("1L conv_id", "0L turn", "'m' message", "'assistant' role", "id seq", "'delta' kind", "'ab' text")
    turns = spark.range(n).selectExpr("2L conv_id", "id turn", "'m' message", "'user' role", "0L seq", "'open' kind", "'x' text")
    began = time.time()
    got = {r["conv_id"]: r for r in chat.digests(chat.format_log(deltas.unionByName(turns))).collect()}
    assert time.time() - began < 30
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (1, 2 * n, hashlib.sha256(b"ab" * n).hexdigest())
    assert (got[2]["n_turns"], got[2]["turns_sha256"]) == (n, hashlib.sha256(b"user\nx\n" * n).hexdigest())
