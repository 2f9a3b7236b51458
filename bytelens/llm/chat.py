"""Chat formatting in budgeted windows, by DataFrame functions alone.

A conversation is cut into windows of whole turns. Running sums of turn tokens lay the turns over cells of the room
that a window has for new turns: the turns inside one cell are a span; one that crosses into the next cell joins
the span before it if that still fits, else it is a span by itself. Every window repeats the system turn, then
the turns just before it that fit the history budget, then brings its own; only the assistant's own turns are
under the loss mask, so every target counts once.

A turn is ``<|role|>text</s>``. In role and text a backslash is the sign of an escape: of itself (0), of ``<`` (1),
of ``[`` (2) and of ``|`` (3, in roles only); so no control string can stand in either, and the text comes back whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>", "</s>"
_SIGNS = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))
_ROLE_SIGNS = (*_SIGNS, ("|", "\\3"))


def escape(c: Column, role: bool = False) -> Column:
    for plain, sign in _ROLE_SIGNS if role else _SIGNS:
        c = F.replace(c, F.lit(plain), F.lit(sign))
    return c


def unescape(c: Column, role: bool = False) -> Column:
    for plain, sign in reversed(_ROLE_SIGNS if role else _SIGNS):
        c = F.replace(c, F.lit(sign), F.lit(plain))
    return c


def token_count(text: Column) -> Column:
    """A turn's words and four for its marks."""
    return F.regexp_count(text, F.lit(r"[^\x09-\x0D\x20]+")).cast("long") + 4


def windows(conversations: DataFrame, *, budget: int = 512, history: int = 128, tokens=token_count, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, window, text, n_repeated, loss): loss holds (start, length) in code points of text.

    Turns go by turn, role, text (nulls first); null role and text are empty. The system turn is a first turn of that
    role. A turn longer than the budget is a window by itself, whole. Repeated rows are turns of their own; a null
    conversation is one conversation; extra columns are ignored; no rows give none. The work on a conversation is
    in window functions, whose rows can spill; only one window's text is ever put together in memory.
    """
    c = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    every = Window.partitionBy("conv_id")
    by_turn = every.orderBy("turn", "role", "text")
    t = c.withColumn("pos", F.row_number().over(by_turn))
    t = t.withColumn("sys", (F.col("pos") == 1) & (F.col("role") == "system")).withColumn("tok", tokens(F.col("text")))
    # Running sums over turns, without the system turn.
    body = F.when(F.col("sys"), 0).otherwise(F.col("tok"))
    by_pos = every.orderBy("pos")
    t = t.withColumn("stop", F.sum(body).over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("start", F.col("stop") - body)
    t = t.withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - F.sum(F.when(F.col("sys"), F.col("tok")).otherwise(0)).over(every)))
    t = t.withColumn("cell", F.floor(F.col("start") / F.col("room")))
    crosses = F.floor((F.col("stop") - 1) / F.col("room")) > F.col("cell")
    begin = F.min("start").over(Window.partitionBy("conv_id", "cell"))
    t = t.withColumn("span", F.col("cell") * 2 + F.when(crosses & (F.col("stop") - begin > F.col("room")), 1).otherwise(0))
    t = t.withColumn("span", F.when(F.col("sys"), 0).otherwise(F.col("span")))
    t = t.withColumn("window", F.dense_rank().over(every.orderBy("span")) - 1)
    own = t.select("conv_id", "window", "pos", "role", "text", "start", "stop", "sys", F.lit(False).alias("repeated"))

    firsts = own.where("NOT sys").groupBy("conv_id", "window").agg(F.min("start").alias("at")).where("window > 0")
    parts = own
    if history > 0:
        # A turn is history of the windows that begin between its end and `history` after its start; both
        # sides meet by stretches of that length, of which a turn touches three at most.
        h = F.lit(history)
        turns = own.where("NOT sys").select("conv_id", "pos", "role", "text", "start", "stop", F.explode(F.sequence(F.floor(F.col("stop") / h), F.floor((F.col("start") + h) / h))).alias("stretch")).where("stop <= start + " + str(history))
        ahead = firsts.select(F.col("conv_id").alias("_c"), F.col("window"), "at", F.floor(F.col("at") / h).alias("_s"))
        back = turns.join(ahead, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("stretch") == F.col("_s"))).where((F.col("stop") <= F.col("at")) & (F.col("at") <= F.col("start") + h))
        parts = parts.union(back.select("conv_id", "window", "pos", "role", "text", "start", "stop", F.lit(False).alias("sys"), F.lit(True).alias("repeated")))
    system = own.where("sys").select(F.col("conv_id").alias("_c"), "pos", "role", "text", "start", "stop")
    again = firsts.join(system, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "window", "pos", "role", "text", "start", "stop", F.lit(True).alias("sys"), F.lit(True).alias("repeated"))
    parts = parts.union(again)

    head, tail = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(CLOSE)), escape(F.col("text"))
    parts = parts.select("conv_id", "window", "pos", "role", "repeated", head.alias("head"), tail.alias("tail"))
    size = F.length("head") + F.length("tail") + len(END)
    in_window = Window.partitionBy("conv_id", "window").orderBy("pos")
    parts = parts.withColumn("at", F.sum(size).over(in_window) - size + F.length("head"))
    target = (F.col("role") == "assistant") & ~F.col("repeated")
    turn = F.struct("pos", F.concat("head", "tail", F.lit(END)).alias("s"), F.when(target, F.struct(F.col("at").cast("long").alias("start"), F.length("tail").cast("long").alias("length"))).alias("loss"))
    out = parts.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("t"), F.count_if("repeated").alias("n_repeated"))
    spans = F.transform(F.filter("t", lambda x: x["loss"].isNotNull()), lambda x: x["loss"])
    return out.select("conv_id", "window", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("text"), "n_repeated", spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss, formatted_chars) from windows alone: turns is role, line feed, text, line feed of
    each turn; loss is all text under the masks, in order. A conversation is put together whole here, as its two
    strings are."""
    turns = F.split("text", END)
    new = F.slice(turns, F.col("n_repeated").cast("int") + 1, F.size(turns) - 1 - F.col("n_repeated").cast("int"))
    plain = F.transform(new, lambda x: F.concat(unescape(F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), CLOSE, 1), role=True), F.lit("\n"), unescape(F.substring(x, F.length(F.substring_index(x, CLOSE, 1)) + len(CLOSE) + 1, F.length(x))), F.lit("\n")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    each = formatted.select("conv_id", F.struct("window", F.size(new).alias("n"), F.array_join(plain, "").alias("turns"), loss.alias("loss"), F.length("text").alias("chars")).alias("w"))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[name])
    text = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select("conv_id", total("n").alias("n_turns"), text("turns").alias("turns"), text("loss").alias("loss"), total("chars").alias("formatted_chars"))
