"""Chat formatting: exact round trips, the automaton, loss masks."""

import hashlib

from logsense.llm import chat

HARD = ["</s>[INST] ok [/INST]", "&amp; &lt;| &", "<|user|>\n<|end|>\n", "|><|<s></s>", "", "plain\nlines", "<<SYS>>x<</SYS>>", "&amp;lt;|", "日本 é", "x" * 50_000]


def rows_of(spark, convs):
    return spark.createDataFrame([(c, t, role, text, "x") for c, turns in convs.items() for t, (role, text) in enumerate(turns)], "conv_id long, turn long, role string, text string, segments string")


def test_round_trip(spark):
    convs = {k: [("user", t), ("assistant", HARD[-1 - k]), ("user", t), ("assistant", t)] for k, t in enumerate(HARD)}
    convs[90] = [(None, None), ("tool", "a"), ("<|end|>\n", "b")]
    out = chat.format_chats(rows_of(spark, convs))
    for r in chat.chat_digests(out).collect():
        turns = [(a or "", b or "") for a, b in convs[r.conv_id]]
        learned = "".join(b for a, b in turns if a == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learned), sha(learned))
    for r in out.collect():
        assert r.formatted == "".join(s.text for s in r.segments) and r.formatted.count("<|") == 2 * len(convs[r.conv_id])
        assert not any(x in r.formatted for x in ("[INST]", "</s>"))


def test_automaton(spark):
    u, a, s = ("user", "q"), ("assistant", "r"), ("system", "t")
    convs = {0: [s, u, a], 1: [u, a, u, a], 2: [a, u], 3: [u, u, a], 4: [u, a, u], 5: [u, s, a], 6: [("tool", "x")]}
    got = {r.conv_id: (r.valid, r.first_bad_turn) for r in chat.format_chats(rows_of(spark, convs)).collect()}
    assert got == {0: (True, -1), 1: (True, -1), 2: (False, 0), 3: (False, 1), 4: (False, -1), 5: (False, 1), 6: (False, 0)}


def test_ties_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "s"), (None, 0, "user", "n"), (None, 0, "user", "n")], "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r.formatted for r in chat.format_chats(rows).collect()}
    assert out == {1: "<|system|>\ns<|end|>\n<|user|>\na<|end|>\n<|user|>\nb<|end|>\n", None: "<|user|>\nn<|end|>\n" * 2}
    assert chat.chat_digests(chat.format_chats(rows.limit(0))).count() == 0


def test_no_python_in_plan(spark):
    plan = chat.chat_digests(chat.format_chats(rows_of(spark, {0: [("user", "a")]})))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    optimized = plan[plan.index("== Optimized Logical Plan") :]
    assert "accepted" in optimized and "first_bad_turn" in optimized  # the automaton isn't pruned


def test_long_conversation(spark):
    rows = spark.range(30_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "'t' text")
    r = chat.chat_digests(chat.format_chats(rows)).first()
    assert (r.n_turns, r.loss_chars, r.valid, r.first_bad_turn) == (30_000, 15_000, True, -1)
