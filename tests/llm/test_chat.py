import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harvestry.llm import chat, queries
from tests.llm.oracle import same

texts = st.text(st.sampled_from("<>[]/\\s|INST\n aé\U0001f389"), max_size=25)


@given(st.lists(st.tuples(texts, texts), max_size=4))
def test_round_trip(turns):
    rendered = "".join(chat.segment(role, text)[0] for role, text in turns)
    assert list(chat.parse(rendered)) == turns
    for role, text in turns:
        for part in (role, text):
            inner = chat.escape(part)
            assert not any(c in inner for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|", "<<"))
        whole, start, end = chat.segment(role, text)
        assert chat.unescape(whole[start:end]) == text


def brute(rows):
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        found.setdefault(conv, []).append((role, text or ""))
    for conv, turns in found.items():
        said = "".join(t for r, t in turns if r == "assistant")
        yield conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    quoted = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)]
    got = queries.op1_chat_formatting(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute(rows))
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_query_against_sql(spark, sf):
    assert same(queries.op1_chat_formatting(spark, sf), queries.ORACLES["op1_chat_formatting"], sf)


def test_fold(spark):
    log = [
        (1, 0, "a", "message", "user", "helo"), (1, 1, "b", "message", "assistant", ""), (1, 2, "b", "delta", None, "fir"), (1, 3, "b", "delta", None, "st"),
        (1, 4, "a", "edit", None, "hello"), (1, 5, "b", "regenerate", None, None), (1, 6, "b", "delta", None, "<s>"), (1, 7, "b", "delta", None, "cond"),
        (1, 8, "c", "message", "user", "gone"), (1, 9, "c", "delete", None, None), (1, 10, None, "message", "user", "x"), (1, 10, None, "message", "user", "x"),
        (1, 11, "d", "noise", "user", "?"), (None, 0, "a", "delta", "assistant", "only"),
    ]
    events = spark.createDataFrame([(*r, "extra") for r in log], "conv_id long, seq long, m string, kind string, role string, text string, place string")
    got = [(r.conv, r.role, r.text) for r in chat.render(events, "m").orderBy("conv", "place").collect()]
    assert got == [(None, "assistant", "only"), (1, "user", "hello"), (1, "assistant", "<s>cond"), (1, "user", "x"), (1, "user", "x")]
    back = {r.conv: (r.n_turns, r.loss_chars) for r in chat.digests(chat.render(events, "m")).collect()}
    assert back == {None: (1, 4), 1: (4, 7)}


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 5, "tool", "y" * 2_000_000), (2, 0, "assistant", ""), (None, 0, "user", "hi")]
    events = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string")
    got = {r.conv: (r.n_turns, r.loss_chars) for r in chat.digests(chat.render(events)).collect()}
    assert got == {1: (2, 0), 2: (1, 0), None: (1, 0)}
    assert chat.digests(chat.render(events.limit(0))).count() == 0


def test_log_folds_into_its_turns(spark):
    said = ["", "a", "ab", "abc\U0001f389d", "</s>[INST]", "y" * 1000, None]
    rows = [(c, t, r, said[(c + t) % 7]) for c in range(40) for t in range(6) for r in ("user", "assistant")]
    rows += [(3, 2, "user", "tie"), (3, 2, "user", "tie"), (5, None, "user", "first"), (None, 1, None, "x")]
    turns = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    log = chat.as_log(turns)
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["message"] == len(rows)
    got = [tuple(r) for r in chat.render(log, "message").orderBy("conv", "place", "message").select("conv", "role", "text").collect()]
    order = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2], x[3]))
    assert got == [(c, r, x) for c, _, r, x in order]
    assert chat.as_log(turns.limit(0)).count() == 0
