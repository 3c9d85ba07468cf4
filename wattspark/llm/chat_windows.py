"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned windows. With S = half of the room a
window has for new turns, a turn belongs to the window number floor(tokens before it / S); a turn
longer than S stands in a window of its own. So the new turns of a window never exceed the room,
unless one turn alone does, and every turn finds its window by itself, without walking through the
conversation. Each window starts with the conversation's system turn, repeats the last turns before
it as far as `history` tokens reach, and then holds its new turns. The loss mask covers the texts of
new assistant turns only, so each target counts once though it may be repeated as history.

Prefix sums are taken in two steps, within runs of `RUN` turn numbers and over the runs, and history
is found by a join on token ranges, so a conversation with very many turns is spread over tasks. A
window holds at most its budget in turns, the only rows that are gathered.

Template: <s>role\\ntext</s> for each turn. Control strings inside texts (<s>, </s>, [INST], [/INST],
<<SYS>>, <</SYS>>, <|) get a backslash after their opening characters; reading back takes one
away, so texts survive whatever they contain. Roles are URL-encoded.

Defined cases: null texts and roles read as empty; rows without a conversation id form one
conversation of their own; null turn numbers come first; turns of equal number are ordered by role
and text, and repeated rows are repeated turns; only a first turn of role `system` is the system
turn; a conversation of a system turn alone is one window; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
RUN = 256
TURN_TOKENS = 4  # what the marks of a turn take

_ESCAPE = r"(<<?/?|\[/?)(\\*)(s>|INST\]|SYS>>|\|)"
_UNESCAPE = r"(<<?/?|\[/?)\\(\\*)(s>|INST\]|SYS>>|\|)"
OPEN, CLOSE = "<s>", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def turn_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, and the turn's marks."""
    return (F.ceil(F.char_length(text) / 4) + TURN_TOKENS).cast("long")


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str, tokens) -> DataFrame:
    """k, conv_id, pos, role, text, tok, at (tokens before the turn), sys_tok."""
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{conv}`").cast("string")), F.lit("null")).alias("k"),
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(2**62)))).withColumn("tok", tokens(F.col("text")))
    inside = Window.partitionBy("k", "run").orderBy("turn", "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rn", F.row_number().over(inside)).withColumn("at", F.coalesce(F.sum("tok").over(before), F.lit(0)))
    # The runs of a conversation are few; the first turn of the first run may be the system turn.
    runs = rows.groupBy("k", "run").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tok").alias("t"), F.min_by(F.struct("role", "tok"), "rn").alias("head")
    )
    over = Window.partitionBy("k").orderBy("run")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    head = F.first("head").over(over)
    runs = runs.select(
        "k",
        "run",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"),
        F.when(head["role"] == "system", head["tok"]).otherwise(F.lit(0)).alias("sys_tok"),
    )
    return rows.join(runs, ["k", "run"]).select(
        "k", "conv_id", (F.col("n0") + F.col("rn") - 1).alias("pos"), "role", "text", "tok", (F.col("t0") + F.col("at")).alias("at"), "sys_tok"
    )


def format_windows(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens=turn_tokens,
) -> DataFrame:
    """One row per window: conv_id, window (rising), formatted, n_tokens, fresh (array of boolean, one
    per turn of the window) and loss (array of start and end in `formatted`, code points)."""
    t = _turns(conversations, conv, turn, role, text, tokens)
    is_system = (F.col("pos") == 0) & (F.col("role") == "system")
    half = F.greatest(F.floor((budget - history - F.col("sys_tok")) / 2), F.lit(1))
    start = F.col("at") - F.col("sys_tok")
    body = t.where(~is_system).select(
        "k", "conv_id", "pos", "role", "text", "tok", start.alias("at"), (2 * F.floor(start / half) + (F.col("tok") > half).cast("long")).alias("window")
    )
    windows = body.groupBy("k", "window").agg(F.min("at").alias("from"))
    firsts = windows.groupBy("k").agg(F.min("window").alias("first"))
    system = t.where(is_system).select("k", "conv_id", "role", "text", "tok")
    opened = (
        system.join(windows, "k", "left")
        .join(firsts, "k", "left")
        .select(
            "k", "conv_id", F.coalesce("window", F.lit(0)).alias("window"), F.lit(-1).cast("long").alias("pos"), "role", "text", "tok",
            (F.coalesce("window", F.lit(0)) == F.coalesce("first", F.lit(0))).alias("fresh"),
        )
    )
    parts = [opened, body.select("k", "conv_id", "window", F.col("pos").cast("long").alias("pos"), "role", "text", "tok", F.lit(True).alias("fresh"))]
    if history > 0:
        slot = F.floor(F.col("from") / history)
        reach = windows.where("from > 0").select("k", F.col("window").alias("to"), "from", F.explode(F.array(slot - 1, slot)).alias("slot"))
        past = body.withColumn("slot", F.floor(F.col("at") / history)).join(reach, ["k", "slot"]).where((F.col("at") >= F.col("from") - history) & (F.col("at") < F.col("from")))
        parts.append(past.select("k", "conv_id", F.col("to").alias("window"), F.col("pos").cast("long").alias("pos"), "role", "text", "tok", F.lit(False).alias("fresh")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    mark = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))
    rows = rows.withColumn("head", mark).withColumn("body", escape(F.col("text"))).withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    ahead = Window.partitionBy("k", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(ahead), F.lit(0)) + F.char_length("head"))
    gathered = rows.groupBy("k", "conv_id", "window").agg(
        F.sum("tok").alias("n_tokens"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos", "piece", "fresh", "start", (F.col("start") + F.char_length("body")).alias("end"), (F.col("fresh") & (F.col("role") == "assistant")).alias("loss")
                )
            )
        ).alias("turns"),
    )
    return gathered.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        "n_tokens",
        F.transform("turns", lambda x: x["fresh"]).alias("fresh"),
        F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What the formatted text says, per window: conv_id, window, turns (role, text) that are new in
    it, loss_text (the unescaped text under the mask), formatted."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    parsed = F.zip_with(
        pieces,
        "fresh",
        lambda p, fresh: F.struct(
            fresh.alias("fresh"),
            F.url_decode(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )
    turns = F.transform(F.filter(parsed, lambda x: x["fresh"]), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    under = F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.select("conv_id", "window", turns.alias("turns"), F.array_join(under, "").alias("loss_text"), "formatted")


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from the read-back windows: counts and digests of its turns and targets."""
    read = read_windows(windows)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    per_window = read.select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), "loss_text", F.char_length("formatted").alias("chars"))
    whole = per_window.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", "said", "loss_text"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    text = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(text("said"), 256).alias("turns_sha256"),
        F.char_length(text("loss_text")).cast("long").alias("loss_chars"),
        F.sha2(text("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
