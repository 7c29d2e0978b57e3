"""Chat formatting in budgeted windows. DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. A window holds the system turn, a limited history
of turns that earlier windows had already, and the span, all within the budget; the loss mask covers only assistant texts
of the span, so each is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"
OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
#: What each character becomes inside a role or text; after a backslash stands one of these letters, and no control
#: string holds a backslash, so replacing back in reverse order is exact.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(c: Column, table=ESCAPES) -> Column:
    for plain, code in table:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column, table=ESCAPES) -> Column:
    for plain, code in reversed(table):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(turn["role"], ROLE_ESCAPES), F.lit(MID), escaped(turn["text"]), F.lit(CLOSE))


def tokens_of(turn: Column) -> Column:
    """What a turn costs of the budget: a token for each four bytes of it as rendered, escapes and template included."""
    return F.ceil(F.octet_length(rendered(turn)) / 4).cast("bigint")


def windows(turns: DataFrame, budget: int = 2048, history_turns: int = 2, history_budget: int = 256) -> DataFrame:
    """turns (conv_id, turn, role, text) as windows (conv_id, window, n_context, formatted, mask).

    Turns are ordered by turn, role and text, nulls first; null roles and texts count as empty; equal turns all stay. A
    span holds the turns whose prefix sum of tokens ends in the same stretch, half of what the budget leaves beside the
    system turn and the history; one that alone is longer than a stretch is a span of its own. n_context counts the
    leading turns that an earlier window had: the first system turn, then up to history_turns turns right before the
    span while they have at most history_budget tokens together and the window stays within the budget. So a window
    exceeds the budget only where one turn and the system turn do: turns are never cut. mask: array of (start, end) in
    code points of formatted. Other columns are ignored; an empty table gives none. One shuffle by conv_id; windows and
    the frames that they need are bounded by the budget and the longest turn.
    """
    one = F.struct("role", "text")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", tokens_of(one))
    whole = W.partitionBy("conv_id")
    order = whole.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("ends", F.sum("tokens").over(before)).withColumn("no", F.row_number().over(order))
    t = t.withColumn("sys", F.min(F.when(F.col("role") == "system", F.struct("no", "tokens", one.alias("t")))).over(whole))
    left = budget - history_budget - F.coalesce(F.col("sys.tokens"), F.lit(0))
    t = t.withColumn("stretch", F.greatest(F.lit(1), F.floor(left / 2)))
    t = t.withColumn("part", F.floor((F.col("ends") - 1) / F.col("stretch")).cast("bigint"))
    t = t.withColumn("past", F.collect_list(F.struct("no", "tokens", one.alias("t"))).over(order.rowsBetween(-history_turns, -1)))
    head = F.when(~F.col("part").eqNullSafe(F.lag("part").over(order)), F.struct("no", "tokens"))
    t = t.withColumn("head", head).withColumn("head", F.max("head").over(before))
    after_long = (F.col("head.tokens") > F.col("stretch")) & (F.col("no") > F.col("head.no"))
    t = t.withColumn("window", 2 * F.col("part") + after_long.cast("bigint"))
    first = F.min_by(F.struct("no", "sys", "past"), "no")
    w = t.groupBy("conv_id", "window").agg(first.alias("first"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("no", "role", "text"))).alias("span"))
    w = w.select("conv_id", "window", "first.*", "tokens", "span")
    # of the history the longest tail within its budget, without the system turn that stands in front anyway
    led = F.coalesce(F.col("sys.no") < F.col("no"), F.lit(False))
    room = F.least(F.lit(history_budget), budget - F.col("tokens") - F.when(led, F.col("sys.tokens")).otherwise(0))
    w = w.withColumn("room", room)
    tail_of = lambda p: F.aggregate(F.filter("past", lambda q: q["no"] >= p["no"]), F.lit(0).cast("bigint"), lambda a, q: a + q["tokens"])
    history = F.filter("past", lambda p: (tail_of(p) <= F.col("room")) & ~p["no"].eqNullSafe(F.col("sys.no")))
    system = F.when(led, F.array("sys.t")).otherwise(F.array().cast(f"array<{TURN}>"))
    context = F.concat(system, F.transform(history, lambda p: p["t"]))
    w = w.select("conv_id", "window", context.alias("context"), "span")
    ctx = F.array_join(F.transform("context", rendered), "")
    zero = F.struct(F.length("ctx").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(F.concat(F.lit(OPEN), escaped(x["role"], ROLE_ESCAPES), F.lit(MID)))
        end = begin + F.length(escaped(x["text"]))
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return w.withColumn("ctx", ctx).select(
        "conv_id", "window", F.size("context").alias("n_context"),
        F.concat("ctx", F.array_join(F.transform("span", rendered), "")).alias("formatted"),
        F.aggregate("span", zero, step, lambda acc: acc["spans"]).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted window, unescaped, as an array of (role, text)."""
    pieces = F.split(formatted, CLOSE)  # the last piece is empty: each turn ends with the closing string

    def one(piece: Column) -> Column:
        at = F.instr(piece, MID)
        return F.struct(
            unescaped(F.substring(piece, len(OPEN) + 1, at - len(OPEN) - 1), ROLE_ESCAPES).alias("role"),
            unescaped(F.substring(piece, at + len(MID), F.length(piece))).alias("text"),
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), one)


def read_masked(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(mask, lambda m: unescaped(F.substring(formatted, m["start"] + 1, m["end"] - m["start"])))
