"""Chat formatting by budgeted windows (DataFrame functions only).

Prefix sums of turn tokens cut every conversation into turn-aligned spans, each as long as the budget allows.
Each span becomes one training window: the system turn in effect (the last one up to there; a new system turn
opens a new span), a limited history repeated for context, and the span's own turns. Only the span's own
targets carry loss, so a repeated target is masked.

A turn is written ``<|start|>role\\ntext<|end|>``. Control strings inside roles and texts get one
backslash after their first character, and one more if they already have some, so that
``unescape`` restores every text exactly.

Scale: the only shuffle of texts is by conversation and block of turn numbers, so that a conversation of any
length spreads over tasks; what a block needs from those before it (system turn, history, count) comes from
one small row per block, made only for conversations of several blocks. Window functions stream and spill, and
collected turns are bounded by tokens.

Defined results: a null role or text is empty; a null conversation id is a conversation of its own;
turns sort by turn (null first), then role, then text, so repeated rows are turns of their own; an
empty table gives no windows; a turn that alone exceeds the budget gets a window of its own, whole;
other columns of the input are ignored, whatever their names. Turns are numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernix.llm.common import among

START, END = "<|start|>", "<|end|>"
#: What follows the first character of a control string; backslashes may stand between.
_TAIL = r"(\|[A-Za-z_]*\|?>|/?s>|/?INST\]|</?SYS>>)"
_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def _role(c: Column) -> Column:
    """A role on one line: line feeds and backslashes are written as backslash sequences."""
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unrole(c: Column) -> Column:
    mark = "\\\x00"
    c = F.replace(unescape(c), F.lit("\\\\"), F.lit(mark))
    return F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit(mark), F.lit("\\"))


def count_tokens(c: Column) -> Column:
    """The default token estimate: words and single symbols."""
    return F.regexp_count(c, F.lit(_TOKEN))


#: Windows' worth of tokens that are cut at a time.
_SPAN = 64


def _carried(d: DataFrame, is_system: Column, history_turns: int) -> DataFrame:
    """For the blocks of conversations of several blocks: number of turns, last system turn and last turns before them."""
    several = d.groupBy("ch").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select(F.col("ch").alias("h"))
    w = Window.partitionBy(*_KEYS).orderBy(F.col("tn").asc_nulls_first(), "rl", "tx")
    turn = F.struct("ix", "rl", "tx", "tk")
    few = among(d, "ch", several).withColumn("ix", F.row_number().over(w))
    few = few.withColumn("end", F.lead(F.lit(True), history_turns).over(w).isNull() if history_turns else F.lit(False))
    blocks = few.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.max(F.when(is_system, turn)).alias("sys"), F.sort_array(F.collect_list(F.when(F.col("end"), turn))).alias("tail"))
    by = Window.partitionBy("conv_missing", "conv_key").orderBy("block")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    none = F.slice("tail", 1, 0)
    tail = F.concat(*[F.coalesce(F.lag("tail", k).over(by), none) for k in range(max(1, history_turns), 0, -1)])
    return blocks.select(*_KEYS, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"), F.last("sys", ignorenulls=True).over(before).alias("sys0"), tail.alias("tail0"))


_KEYS = ("conv_missing", "conv_key", "block")


def chat_windows(
    df: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = 1024,
    history_tokens: int = 256,
    history_turns: int = 2,
    system_role: str = "system",
    loss_roles: tuple[str, ...] = ("assistant",),
    tokens=count_tokens,
    block_turns: int = 4096,
) -> DataFrame:
    """One row per training window: conv_id, first_turn (rank of its first own turn), n_context, n_new,
    n_tokens, text and loss_spans (code point [start, end) of the targets in text); then what the rows are dealt by
    (conv_missing, conv_key, block) and whether the conversation may have several blocks (split).

    Spans are cut afresh at every block of turn numbers and every _SPAN budgets of tokens.
    """
    is_system = F.col("rl") == system_role
    kind = df.schema[conv].dataType
    d = df.select(
        F.col(conv).isNull().alias("conv_missing"),
        F.coalesce(F.col(conv), F.lit(0).cast(kind)).alias("conv_key"),
        F.coalesce(F.floor(F.col(turn) / block_turns), F.lit(-(1 << 62))).cast("long").alias("block"),
        F.col(turn).alias("tn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("rl"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("tx"),
    ).withColumns({"tk": tokens(F.col("tx")) + F.lit(4), "ch": F.xxhash64("conv_missing", "conv_key")})
    carried = _carried(d, is_system, history_turns)
    d = d.drop("ch").join(carried, list(_KEYS), "left")
    w = Window.partitionBy(*_KEYS).orderBy(F.col("tn").asc_nulls_first(), "rl", "tx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("ix", (F.coalesce("off", F.lit(0)) + F.row_number().over(w)).cast("int"))
    turn_at = F.struct("ix", "rl", "tx", "tk")
    d = d.withColumn("sy", F.coalesce(F.last(F.when(is_system, turn_at), ignorenulls=True).over(upto), F.col("sys0")))
    d = d.withColumn("ep", F.count_if(is_system).over(upto)).withColumn("own", F.when(is_system, 0).otherwise(F.col("tk")))
    room = lambda s: F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.coalesce(s["tk"], F.lit(0)))
    we = Window.partitionBy(*_KEYS, "ep").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("chunk", F.floor((F.sum("own").over(we) - F.col("own")) / (room(F.col("sy")) * _SPAN)))
    at = F.struct("ep", "chunk")
    opens = ~F.lag(at).over(w).eqNullSafe(at)
    no_turns = F.slice(F.array(turn_at), 1, 0)
    before = F.concat(F.coalesce("tail0", no_turns), F.array_compact(F.array(*[F.lag(turn_at, k).over(w) for k in range(history_turns, 0, -1)])) if history_turns else no_turns)
    d = d.withColumn("before", F.when(opens, before))
    g = d.groupBy(*_KEYS, "ep", "chunk").agg(
        F.sort_array(F.collect_list(turn_at)).alias("turns"), F.flatten(F.collect_list("before")).alias("before"), F.max("sy").alias("sy"), F.bool_or(F.col("off").isNotNull()).alias("split")
    )
    # Turns are taken in order while they fit; the positions where a span starts are kept.
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).cast("long").alias("used"), F.expr("CAST(array() AS array<int>)").alias("starts"))

    def take(acc, x):
        own = F.when(x["rl"] == system_role, 0).otherwise(x["tk"]).cast("long")
        fits = (acc["pos"] > 0) & (acc["used"] + own <= room(F.col("sy")))
        starts = F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["pos"])))
        return F.struct((acc["pos"] + 1).alias("pos"), F.when(fits, acc["used"] + own).otherwise(own).alias("used"), starts.alias("starts"))

    g = g.withColumn("starts", F.aggregate("turns", zero, take, lambda acc: acc["starts"])).withColumn("all", F.concat("before", "turns"))

    def recent(p):
        """The last turns before place p of all turns, as many as the history may hold; system turns are no history."""
        last = F.slice("all", F.greatest(p - F.lit(history_turns), F.lit(0)) + 1, F.least(p, F.lit(history_turns)))
        last = F.reverse(F.filter(last, lambda x: x["rl"] != system_role))
        start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(last, 1, 0).alias("kept"))
        # One turn too long ends the history: what is older is left out too.
        over = F.lit(history_tokens + 1).cast("long")
        add = lambda acc, x: F.struct(
            F.when(acc["used"] + x["tk"] <= history_tokens, acc["used"] + x["tk"]).otherwise(over).alias("used"),
            F.when(acc["used"] + x["tk"] <= history_tokens, F.concat(F.array(x), acc["kept"])).otherwise(acc["kept"]).alias("kept"),
        )
        return F.aggregate(last, start, add, lambda acc: acc["kept"])

    def span(s, i):
        new = F.slice("turns", s + 1, F.coalesce(F.get("starts", i + 1), F.size("turns")) - s)
        # The system turn is retained where it is not among the span's own turns.
        held = F.when(F.col("sy").isNotNull() & (F.get("turns", s)["rl"] != system_role), F.array(F.col("sy"))).otherwise(F.slice("turns", 1, 0))
        history = recent(F.size("before") + s) if history_turns else F.slice("turns", 1, 0)
        return F.struct(new.alias("new"), F.concat(held, history).alias("ctx"))

    g = g.select(*_KEYS, "split", F.explode(F.transform("starts", span)).alias("w")).select(*_KEYS, "split", "w.new", "w.ctx")
    part = lambda fresh: lambda x: F.struct(
        F.lit(fresh).alias("new"), (F.lit(fresh) & x["rl"].isin(*loss_roles)).alias("loss"), _role(x["rl"]).alias("rl"), escape(x["tx"]).alias("tx"), x["tk"].alias("tk")
    )
    g = g.select(
        *_KEYS,
        "split",
        F.when(~F.col("conv_missing"), F.col("conv_key")).alias("conv_id"),
        F.col("new")[0]["ix"].cast("long").alias("first_turn"),
        F.size("ctx").alias("n_context"),
        F.size("new").alias("n_new"),
        F.concat(F.transform("ctx", part(False)), F.transform("new", part(True))).alias("parts"),
    )
    head = len(START) + 1
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc, x):
        a = acc["at"] + F.lit(head) + F.char_length(x["rl"])
        b = a + F.char_length(x["tx"])
        spans = F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(a.alias("start"), b.alias("end"))))).otherwise(acc["spans"])
        return F.struct((b + F.lit(len(END))).alias("at"), spans.alias("spans"))

    return g.select(
        "conv_id",
        "first_turn",
        "n_context",
        "n_new",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["tk"]).alias("n_tokens"),
        F.array_join(F.transform("parts", lambda x: F.concat(F.lit(START), x["rl"], F.lit("\n"), x["tx"], F.lit(END))), "").alias("text"),
        F.aggregate("parts", zero, step)["spans"].alias("loss_spans"),
        *_KEYS,
        "split",
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Reads formatted windows back: ``turns`` (role, text) that are new in each, and its unescaped ``targets``."""
    pieces = F.slice(F.split("text", r"<\|end\|>", -1), F.col("n_context") + 1, F.col("n_new"))
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.char_length(p))
    role = lambda p: F.substring_index(p, "\n", 1)
    turns = F.transform(
        F.transform(pieces, body),
        lambda p: F.struct(_unrole(role(p)).alias("role"), unescape(F.substring(p, F.char_length(role(p)) + 2, F.char_length(p))).alias("text")),
    )
    targets = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return windows.withColumn("turns", turns).withColumn("targets", targets)


def chat_digest(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text alone: n_turns, digests of its turns and of the text under loss.

    A conversation of one block is digested where it is; only the texts of split ones travel again, into one row each.
    """
    r = read_windows(windows).select(
        *_KEYS,
        "conv_id",
        "split",
        F.struct(
            F.col("first_turn").alias("at"),
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("targets", "").alias("loss"),
        ).alias("w"),
        F.col("n_new").cast("long").alias("n"),
        F.char_length("text").cast("long").alias("chars"),
    )
    b = r.groupBy(*_KEYS, "conv_id", "split").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sort_array(F.collect_list("w")).alias("ws"))
    b = b.withColumns({"turns": F.array_join("ws.turns", ""), "loss": F.array_join("ws.loss", "")})

    def digests(turns: Column, loss: Column) -> Column:
        sha = lambda c: F.sha2(c.cast("binary"), 256)
        return F.struct(sha(turns).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"))

    b = b.select(
        "conv_id",
        "n",
        "chars",
        F.when(~F.col("split"), digests(F.col("turns"), F.col("loss"))).alias("own"),
        F.when(F.col("split"), F.struct("block", "turns", "loss")).alias("part"),
    )
    g = b.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.max("own").alias("own"), F.sort_array(F.collect_list("part")).alias("parts"))
    both = F.coalesce("own", digests(F.array_join("parts.turns", ""), F.array_join("parts.loss", "")))
    g = g.withColumn("d", both)
    return g.select("conv_id", "n_turns", "d.turns_sha256", "d.loss_chars", "d.loss_sha256", "formatted_chars")
