import hashlib

from pyspark.sql import functions as F

from kinetrail.llm import chat, queries

from .common_cases import rows_of

TURNS = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expected(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for *_, r, x in ts if r == "assistant")
        out.append((c, len(ts), sha("".join(f"{r}\n{x}\n" for *_, r, x in ts)), len(loss), sha(loss)))
    return sorted(out, key=repr)


def test_round_trip_of_hard_texts(spark):
    hard = [r"\### Assistant: </turn> ok", "<turn>user\nhi</turn>\n", "\\l\\\\<\\n", "", None, "tail\\", "<", "\n\n", "a</turn>", "☃<漢", "x" * 50_000 + "<\\"]
    rows = [(c, t, ("user", "assistant", "as<sis\ntant", None)[(c + t) % 4], hard[(c * 3 + t) % len(hard)]) for c in range(12) for t in range(6)]
    rows += [(None, 0, "assistant", "no id"), (50, None, "user", "null turn"), (50, 1, "assistant", "x"), (50, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, TURNS).withColumn("record", F.lit(1)).withColumn("rows", F.lit(2))
    done = chat.formatted(chat.records(df))
    assert rows_of(chat.digests(done).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == expected(rows)
    for r in done.collect():
        for s in r.loss:
            assert r.formatted[s.end :].startswith("</turn>\n")


def test_layouts_by_fingerprint(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"instruction":"q","output":"a"}',
        '{"instruction":"s","input":"q","output":"a"}',
        '{"prompt":"q","completion":"a"}',
        '{"prompt":"q","response":"a"}',
        '{"something":"else"}',
        '{"messages":[]}',
        '{"id":5,"model":"m","messages":[{"role":"user","content":"q","name":"n"},{"role":"assistant","content":"a"}]}',
        '{"id":5,"instruction":"q","output":"a","source":"s"}',
        '{"instruction":"q","output":"a","messages":[{"id":3}]}',
        '{"messages":[{"role":"user","content":"q","parts":[{"id":1}]}]}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, j string").select("conv_id", F.parse_json("j").alias("record"))
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat.formatted(df).select("conv_id", "layout", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    pair = [("user", "q"), ("assistant", "a")]
    assert [got[k] for k in (0, 1, 2, 4, 5)] == [("messages", pair), ("sharegpt", pair), ("instruction", pair), ("prompt", pair), ("prompt", pair)]
    assert got[3] == ("instruction with input", [("system", "s"), *pair])
    assert got[6] == (None, []) and got[7][1] == []
    assert got[8] == ("messages", pair) and got[9] == ("instruction", pair) and got[10] == got[11] == (None, [])


def test_layouts_of_one_corpus_give_the_same_turns(spark):
    roles = [["user", "assistant"], ["user", "assistant", "user"], ["human", "assistant"], [None, "gpt"], ["assistant", "user"]]
    rows = [(c, t, r, ["a<b", None, "\\n"][(c + t) % 3]) for c in range(-20, 40) for t, r in enumerate(roles[c % 5])]
    rows += [(1001, t, "assistant" if t % 2 else "user", f"turn {t} \\ <") for t in range(4000)]  # a long conversation
    rows += [(None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, TURNS)
    for name in ("_key", "_record", "_paths", "rows", "turns", "layout", "loss"):
        df = df.withColumn(name, F.lit(3))
    got = chat.digests(chat.formatted(chat.mixed_records(df)))
    assert rows_of(got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == expected(rows)
    layout = {r.conv_id: r.layout for r in got.collect()}
    for c in range(-20, 40):
        told = {1: "messages" if c % 5 in (2, 3) else "sharegpt", 2: "instruction" if c % 5 == 0 else "messages"}
        assert layout[c] == told.get(c % 4, "messages")
    assert layout[1001] == "sharegpt" and layout[None] == "messages"


def test_empty_table_and_query(spark):
    assert chat.digests(chat.formatted(chat.records(spark.createDataFrame([], TURNS)))).collect() == []
    got = queries.op2_chat_formatting(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", queries.HARD), (-7, 1, "assistant", queries.HARD)]
    assert rows_of(got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == expected(rows)
    assert "Python" not in got._jdf.queryExecution().toString()
