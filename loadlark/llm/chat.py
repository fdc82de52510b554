"""Chat formatting in budgeted, turn-aligned windows; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings and what stands for them inside texts and roles.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = [("\\", "\\\\"), ("###", "\\3"), ("</turn>", "\\t")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]


def _escape(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for control, stands in pairs:
        text = F.replace(text, F.lit(control), F.lit(stands))
    return text


def _unescape(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Escaped backslashes split the text; between them each other escape is unambiguous."""

    def inner(part: Column) -> Column:
        for control, stands in pairs[1:]:
            part = F.replace(part, F.lit(stands), F.lit(control))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), inner), "\\")


def turn_tokens(text: Column) -> Column:
    """A native estimate of a turn's tokens: a quarter of its bytes, and four for the marks around it."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def format_chats(turns: DataFrame, *, budget: int = 2048, history: int = 512, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conv_id, window, n_system, n_repeated, n_new, n_tokens, formatted, loss (spans of formatted, in characters).

    Prefix sums of turn tokens choose the windows: each holds the system turn, if the first turn is one, then up to `history`
    tokens of the turns before (never in part, and only what the budget leaves beside the first new turn), then new turns while all
    fit in `budget`; a new turn that does not fit beside the system turn has a window of its own, without history. Targets are the texts of assistant turns; those of repeated turns are masked, so each is a target once.

    A null text or role is empty. Turns go in the order of turn, role and text (nulls first), so ties and repeated rows have a
    defined place; repeated rows are turns of their own. A null conv_id is a conversation like others. An empty table gives no
    windows. Other columns of the input are ignored, whatever their names.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("tokens", turn_tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumns({"i": F.row_number().over(order) - 1, "upto": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    first_tokens = F.first("tokens").over(order)
    t = t.withColumns({"before": F.col("upto") - F.col("tokens"), "n_system": F.when(F.first("role").over(order) == "system", 1).otherwise(0)}).withColumn("system_tokens", F.col("n_system") * first_tokens)
    # the first turn of the history before turn i: the earliest whose tokens up to i - 1 are within `history`, and within what the
    # budget leaves beside the system turn and turn i itself; the turns looked at are bounded by `history`
    back = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, 0)
    room = F.least(F.lit(history), F.greatest(F.lit(0), F.lit(budget) - F.col("system_tokens") - F.col("tokens")))
    near = F.filter(F.collect_list(F.struct("before", "i")).over(back), lambda y: (y["before"] >= F.col("before") - F.col("room")) & (y["i"] >= F.col("n_system")))
    t = t.withColumn("room", room).withColumn("near", near)
    t = t.withColumns({"from": F.coalesce(F.array_min(F.transform("near", lambda y: y["i"])), F.col("i")), "from_before": F.coalesce(F.array_min(F.transform("near", lambda y: y["before"])), F.col("before"))})
    conv = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "text", "tokens", "before", "from", "from_before"))).alias("turns"))
    first = F.col("turns")[0]
    conv = conv.withColumn("n_system", F.when(first["role"] == "system", 1).otherwise(0)).withColumn("system_tokens", F.col("n_system") * first["tokens"])

    def base(x: Column) -> Column:
        """Tokens that a window starting with turn x repeats: the system turn and the history after it."""
        repeated = x["before"] - F.greatest(x["from_before"], F.col("system_tokens"))
        return F.when(x["i"] == 0, F.lit(0)).otherwise(F.col("system_tokens") + F.greatest(repeated, F.lit(0)))

    def step(state: Column, x: Column) -> Column:
        fits = (state["used"] + x["tokens"] <= budget) & (x["i"] > 0)
        used = F.when(fits, state["used"] + x["tokens"]).otherwise(base(x) + x["tokens"])
        return F.struct(F.when(fits, state["starts"]).otherwise(F.array_append(state["starts"], x["i"])).alias("starts"), used.cast("long").alias("used"))

    starts = F.aggregate("turns", F.struct(F.expr("array()").cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("used")), step)["starts"]
    windows = conv.withColumn("starts", starts).select("*", F.posexplode("starts").alias("window", "start"))
    n = F.size("turns")
    stop = F.coalesce(F.get("starts", F.col("window") + 1), n)
    head = F.greatest(F.get("turns", F.col("start"))["from"], F.col("n_system"))
    windows = windows.withColumns({"stop": stop, "head": F.least(head, F.col("start"))})
    windows = windows.withColumn("shown", F.when(F.col("start") == 0, F.slice("turns", 1, F.col("stop"))).otherwise(F.concat(F.slice("turns", F.lit(1), F.col("n_system")), F.slice("turns", F.col("head") + 1, F.col("stop") - F.col("head")))))
    marked = F.transform("shown", lambda x: F.struct(
        F.concat(F.lit(OPEN), _escape(x["role"], ROLE_ESCAPES), F.lit(MIDDLE)).alias("lead"),
        _escape(x["text"], ESCAPES).alias("body"),
        ((x["role"] == "assistant") & (x["i"] >= F.col("start"))).alias("target"),
        x["tokens"].alias("tokens"),
    ))
    windows = windows.select("conv_id", "window", "start", "stop", "n_system", F.size("shown").alias("n_shown"), marked.alias("shown"))

    def span(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(x["lead"])
        end = at + F.length(x["body"])
        grown = F.when(x["target"], F.array_append(state["spans"], F.struct(at.alias("start"), end.alias("end")))).otherwise(state["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), grown.alias("spans"))

    spans = F.aggregate("shown", F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<start:int,end:int>>").alias("spans")), span)["spans"]
    n_new = F.col("stop") - F.col("start")
    return windows.select(
        "conv_id", "window", F.when(F.col("start") == 0, F.lit(0)).otherwise(F.col("n_system")).alias("n_system"),
        (F.col("n_shown") - n_new - F.when(F.col("start") == 0, F.lit(0)).otherwise(F.col("n_system"))).alias("n_repeated"), n_new.alias("n_new"),
        F.aggregate("shown", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("shown", lambda x: F.concat(x["lead"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        spans.alias("loss"),
    )


def parse_chats(windows: DataFrame) -> DataFrame:
    """Read windows back: conv_id, window, formatted, turns (role and text of the new turns, unescaped), targets (texts under the loss mask, unescaped)."""
    pieces = F.slice(F.split("formatted", "</turn>\n", -1), F.col("n_system") + F.col("n_repeated") + 1, F.col("n_new"))

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, MIDDLE, 1)
        role = F.substring(body, F.lit(len(OPEN) + 1), F.length(body))
        text = F.substring(piece, F.length(body) + len(MIDDLE) + 1, F.length(piece))
        return F.struct(_unescape(role, ROLE_ESCAPES).alias("role"), _unescape(text, ESCAPES).alias("text"))

    targets = F.transform("loss", lambda s: _unescape(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]), ESCAPES))
    return windows.select("conv_id", "window", "formatted", F.transform(pieces, turn).alias("turns"), targets.alias("targets"))
