from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ontospark.llm import chat

LOG = [
    ("c", 1, "m1", "user", "open", ""), ("c", 2, "m1", "user", "delta", "Hel"), ("c", 3, "m1", "user", "delta", "lo"),
    ("c", 4, "m2", "assistant", "open", None), ("c", 5, "m2", "assistant", "delta", "wrong"), ("c", 6, "m2", "assistant", "regenerate", "x"),
    ("c", 7, "m2", "assistant", "delta", "ri"), ("c", 8, "m2", "assistant", "delta", None), ("c", 9, "m2", "assistant", "delta", "ght"),
    ("c", 10, "m1", "user", "edit", "Bye"), ("c", 11, "m1", "user", "delta", "!"), ("c", 12, "m3", None, "unknown", "zzz"),
    (None, 1, "m1", "user", "delta", "lone"), ("d", 1, "m1", "assistant", "edit", "a"), ("d", 1, "m1", "assistant", "edit", "a"),
]
SCHEMA = "conv_id string, seq bigint, message string, role string, kind string, text string"


def brute(log):
    out = {}
    kinds = {"delta", "edit", "regenerate"}
    for conv, seq, message, role, kind, text in sorted(log, key=lambda e: (e[1], e[4], e[5] or "")):
        first, r, said = out.get((conv, message), (seq, role or "", ""))
        text = text or ""
        if kind in kinds:
            said = said + text if kind == "delta" else text if kind == "edit" else ""
        out[conv, message] = (first, r, said)
    return {(c, *v[:1], *v[1:]) for (c, _), v in out.items()}


def test_fold(spark):
    got = chat.fold(spark.createDataFrame([(*e, "x") for e in LOG], SCHEMA + ", turns string").repartition(3)).collect()
    assert {(r.conv_id, r.first_seq, r.role, r.text) for r in got} == brute(LOG)
    assert chat.fold(spark.createDataFrame([], SCHEMA)).count() == 0


def test_render_and_read_back(spark):
    odd = ["", "a<|end|>b", "~1~0<|", "</s>[INST] ok [/INST]", "<<|end|>", "<", "|>", "é\U0001f600\n\r\x00\x1e", "~" * 5, "x" * 200_000]
    rows = [(c, t, "assistant" if t % 2 else "user<|said|>", odd[(c + t) % len(odd)]) for c in range(4) for t in range(150 if c == 3 else 3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    parsed = chat.loss_spans(chat.parse(chat.render(df, ["turn", "role", "text"]))).collect()
    for r in parsed:
        mine = sorted((t, role, text) for c, t, role, text in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.turns] == [x[1:] for x in mine]
        assert r.loss_text == "".join(text for _, role, text in mine if role == "assistant")
        assert r.formatted.count(chat.END) == len(mine)
    assert chat.render(df.limit(0), ["turn"]).count() == 0
    masked = chat.mask(chat.parse(chat.render(df, ["turn", "role", "text"])))
    parts = masked.select("conv_id", F.posexplode("spans").alias("nth", "s"), "formatted").select("conv_id", "nth", chat.unescape(F.substr("formatted", F.col("s.start") + 1, F.col("s.length"))).alias("said"))
    by = {}
    for r in parts.orderBy("conv_id", "nth").collect():
        by.setdefault(r.conv_id, []).append(r.said)
    assert {r.conv_id: r.loss_text for r in parsed} == {r.conv_id: "".join(by.get(r.conv_id, [])) for r in parsed}
    assert "Python" not in masked._jdf.queryExecution().toString()


def test_table_of_turns_as_a_log(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "odd é text"), (1, 1, None, "odd é text"), (None, None, "assistant", "x"), (2, 5, "system", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.fold(chat.as_events(df)).withColumn("turn", F.col("message.turn")).collect()
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in got), key=str) == sorted(((c, -1 if t is None else t, r or "", x or "") for c, t, r, x in rows), key=str)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="~<|>/sINST[]0123456789a\x1e", max_size=12), min_size=1, max_size=20))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t"))).withColumn("b", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.b == r.t
        assert not any(m in r.e for m in chat.CONTROL)


def test_no_python_in_the_plan(spark):
    from ontospark.llm import queries

    plan = queries.op5_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
