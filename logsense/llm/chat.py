"""Chat formatting from a declarative template, with DataFrame functions only.

A template names the roles with what stands before and after their text and whether their text is
learned, the turns that each state of the automaton accepts, and the control strings. The automaton's steps
judge the turns and emit the segments; a refused turn is emitted too, so no text is lost. Control strings
inside a text are escaped with character references, so the text of a conversation can be read back.

Defined cases: a null text is empty and a null role is the empty role; roles outside the template are
marked like the others and never learned; turns are ordered by turn, then role and text, null first;
rows with a null conv_id form one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "open": "<|{role}|>\n",
    "close": "<|end|>\n",
    "learned": ["assistant"],
    # state after a role -> roles that may follow; "" is the start.
    "accepts": {"": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "final": ["assistant"],
    # control string -> what stands for it inside a text; & itself is escaped first and read back last.
    "escapes": {"<|": "&lt;|", "|>": "|&gt;", "<s>": "&lt;s>", "</s>": "&lt;/s>", "[INST]": "&lsqb;INST]", "[/INST]": "&lsqb;/INST]", "<<SYS>>": "&lt;&lt;SYS>>", "<</SYS>>": "&lt;&lt;/SYS>>"},
}


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    """text without control strings; unescape() undoes it."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in template["escapes"].items():
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    """The text that escape() was given."""
    for raw, safe in reversed(template["escapes"].items()):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _accepted(state: Column, role: Column, template: dict) -> Column:
    """Whether a state's turns may have a role."""
    ok = F.lit(False)
    for name, roles in template["accepts"].items():
        ok = ok | ((state == name) & role.isin(roles))
    return ok


def run_machine(turns: Column, template: dict = TEMPLATE) -> Column:
    """The automaton's step at every turn: role, text, whether the state before accepts it, and whether its text is learned.

    The state after a turn is its role, so every step finds the state before it at the turn before: no step waits
    for another, and a conversation of any length takes linear time.
    """

    def step(t: Column, i: Column) -> Column:
        state = F.when(i == 0, F.lit("")).otherwise(F.get(turns, i - 1)["role"])
        return F.struct(t["role"].alias("role"), t["text"].alias("text"), _accepted(state, t["role"], template).alias("accepted"), t["role"].isin(template["learned"]).alias("loss"))

    return F.transform(turns, step)


def emitted(steps: Column, template: dict = TEMPLATE) -> Column:
    """The segments (text, loss) that the automaton's steps emit: mark, escaped text, mark."""
    before, after = template["open"].split("{role}")
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def parts(s: Column) -> Column:
        head = F.concat(F.lit(before), escape(s["role"], template), F.lit(after))
        return F.array(piece(head, F.lit(False)), piece(escape(s["text"], template), s["loss"]), piece(F.lit(template["close"]), F.lit(False)))

    return F.flatten(F.transform(steps, parts))


def format_chats(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text).

    conv_id, segments (text, loss), formatted, valid (all turns accepted, the last state final), first_bad_turn (index, -1 if none).
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = convs.select("conv_id", run_machine(F.col("turns"), template).alias("steps"))
    convs = convs.select("conv_id", emitted(F.col("steps"), template).alias("segments"), F.transform("steps", lambda s: s["accepted"]).alias("accepted"), F.element_at("steps", -1)["role"].alias("state"))
    bad = (F.array_position("accepted", False) - 1).cast("int")
    valid = (bad < 0) & F.col("state").isin(template["final"])
    return convs.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), valid.alias("valid"), bad.alias("first_bad_turn"))


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns (role, text) of a formatted conversation."""
    before, after = template["open"].split("{role}")
    pieces = F.split(formatted, r"\Q" + template["close"] + r"\E")
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        at = F.locate(after, p)
        role = F.substring(p, F.lit(len(before) + 1), at - len(before) - 1)
        return F.struct(unescape(role, template).alias("role"), unescape(F.substring(p, at + len(after), F.length(p)), template).alias("text"))

    return F.transform(pieces, turn)


def chat_digests(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """What a reader of format_chats() gets back: counts and digests of turns and of the learned text."""
    x = formatted.select("conv_id", "formatted", "valid", "first_bad_turn", read_turns(F.col("formatted"), template).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "").alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_bad_turn")
