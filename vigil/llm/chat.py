"""Chat formatting in windows of a token budget, with limited history and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import let, text_of, word_count

BUDGET = 1024
HISTORY = 128
SYSTEM = 96
TURN_TOKENS = 4
TURNS_PER_RANGE = 64

END = "</turn>\n"
MASK = "array<struct<start:int,length:int>>"


def escaped(text: Column) -> Column:
    """Without ``<`` and ``>``, and with every backslash followed by s, l or g, so it reads back exactly."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _stride(budget: int, history: int, system: int) -> int:
    return max(1, (budget - history - system) // 2)


def _placed(turns: DataFrame, stride: int) -> DataFrame:
    """Every turn with the tokens before it (the system turn counts none) and its window."""
    conv = F.col("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = turns.withColumn("_range", F.coalesce(F.floor(F.col("turn") / TURNS_PER_RANGE), F.lit(-(1 << 62))))
    heads = rows.groupBy("conv_id").agg(F.min(F.struct(
        F.coalesce(F.col("turn"), F.lit(-(1 << 62))).alias("turn"), "role", "text")).alias("_head"))
    heads = heads.select(conv.alias("_c"), (F.col("_head.role") == "system").alias("_has_system"), F.col("_head.turn").alias("_first"),
                         F.col("_head.text").alias("_first_text"))
    rows = rows.join(heads, conv.eqNullSafe(F.col("_c"))).drop("_c")
    alike = Window.partitionBy("conv_id", "_range").orderBy(*order)
    rows = rows.withColumn("_place", F.row_number().over(alike))
    first_range = F.coalesce(F.floor(F.when(F.col("_first") > -(1 << 62), F.col("_first")) / TURNS_PER_RANGE), F.lit(-(1 << 62)))
    rows = rows.withColumn("system", F.col("_has_system") & (F.col("_range") == first_range) & (F.col("_place") == 1))
    rows = rows.withColumn("_tokens", F.when(F.col("system"), F.lit(0)).otherwise(F.col("tokens"))).drop(
        "_has_system", "_first", "_first_text")
    sums = rows.groupBy("conv_id", "_range").agg(F.sum("_tokens").alias("_sum"))
    total = Window.partitionBy("conv_id")
    sums = sums.select(conv.alias("_c"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(
        total.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_sum").over(total).alias("total"))
    inside = F.coalesce(F.sum("_tokens").over(alike.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (rows.withColumn("_inside", inside)
            .join(sums, conv.eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r")))
            .withColumn("start", F.col("_before") + F.col("_inside"))
            .withColumn("end", F.col("start") + F.col("_tokens"))
            .withColumn("window", F.floor(F.col("start") / stride))
            .select("conv_id", "turn", "role", "text", "tokens", "system", "start", "end", "total", "window", "_place"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM) -> DataFrame:
    """(conv_id, window, formatted, mask, n_tokens, over_budget): conversations in turn-aligned windows.

    A turn has its words and four more tokens.  Prefix sums over a conversation place each turn in the window
    of the stride its start lies in; the stride is half of what ``history`` and ``system`` leave of the budget,
    so a window of turns no longer than a stride fits.  A longer turn is never cut: ``over_budget`` tells.
    A first turn with role ``system`` stands at the head of every window.  Turns that start within
    ``history`` tokens of a window's end are repeated in front of the next window.  The mask lists (start,
    length), in code points, of assistant texts where they appear for the first time; repeated turns are
    not under it.

    Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own; null
    role and text are empty; null conv_id is one conversation.  Extra columns are ignored; an empty
    table gives no windows.  Prefix sums run over ranges of turn numbers, so a conversation that holds a
    third of all rows is spread over many tasks, and only a window is ever gathered.
    """
    stride = _stride(budget, history, system)
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"),
                                 text_of().alias("text")).withColumn("tokens", word_count(F.col("text")) + TURN_TOKENS)
    placed = _placed(turns, stride)
    last = F.max("end").over(Window.partitionBy("conv_id", "window"))
    placed = placed.withColumn("_last", last)
    new = placed.select("conv_id", "window", F.lit("n").alias("flag"), "turn", "start", "_place", "system", "role", "text", "tokens")
    again = (placed.where(~F.col("system") & (F.col("_last") < F.col("total")) & (F.col("_last") - F.col("start") <= history))
             .withColumn("window", F.floor(F.col("_last") / stride)).withColumn("flag", F.lit("h")).select(*new.columns))
    heads = placed.where("system").select(F.col("conv_id").alias("_c"), "turn", "start", "_place", "system", "role", "text", "tokens")
    others = placed.where(F.col("window") > 0).select("conv_id", "window").distinct()
    repeated = (others.join(heads, F.col("conv_id").eqNullSafe(F.col("_c"))).withColumn("flag", F.lit("s")).select(*new.columns))
    rows = new.unionByName(again).unionByName(repeated)
    grouped = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct(
            F.when(F.col("system"), F.lit(0)).otherwise(F.lit(1)).alias("rank"), "start", "turn", "_place", "role", "text", "flag"))).alias("turns"),
        F.sum("tokens").alias("n_tokens"))

    def piece(t):
        head = F.concat(F.lit("<turn "), t["flag"], F.lit(" "), escaped(t["role"]), F.lit(">"))
        return F.struct(head.alias("head"), escaped(t["text"]).alias("text"),
                        ((t["flag"] == "n") & (t["role"] == "assistant")).alias("loss"))

    def joined(pieces):
        mask = F.aggregate(
            pieces, F.struct(F.lit(0).alias("at"), F.array().cast(MASK).alias("out")),
            lambda s, p: F.struct(
                (s["at"] + F.length(p["head"]) + F.length(p["text"]) + len(END)).alias("at"),
                F.when(p["loss"], F.concat(s["out"], F.array(F.struct(
                    (s["at"] + F.length(p["head"])).alias("start"), F.length(p["text"]).alias("length"))))).otherwise(
                        s["out"]).cast(MASK).alias("out")),
            lambda s: s["out"])
        text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
        return F.struct(text.alias("formatted"), mask.alias("mask"))

    return grouped.select("conv_id", "window", F.inline(F.array(let(F.transform("turns", piece), joined))), "n_tokens").select(
        "conv_id", "window", "formatted", "mask", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from ``windows`` output alone: its turns, its text under the mask."""
    def read(text):
        pieces = F.filter(F.split(text, END), lambda p: p != "")
        fresh = F.filter(F.transform(pieces, lambda p: let(p, _turn)), lambda t: t["flag"] == "n")
        return fresh

    def _turn(piece):
        close = F.instr(piece, ">")
        return F.struct(F.substring(piece, F.lit(7), F.lit(1)).alias("flag"),
                        unescaped(F.substring(piece, F.lit(9), close - 9)).alias("role"),
                        unescaped(F.substring(piece, close + 1, F.length(piece))).alias("text"))

    rows = formatted.select("conv_id", "window", "formatted", "mask", read(F.col("formatted")).alias("fresh")).select(
        "conv_id", F.struct(
            "window", F.size("fresh").alias("n"),
            F.array_join(F.transform("fresh", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join(F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "").alias("loss"),
            F.length("formatted").alias("chars")).alias("w"))
    whole = rows.groupBy("conv_id").agg(
        F.sum("w.n").alias("n_turns"), F.sum("w.chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("w.window", "w.turns", "w.loss"))).alias("w"))
    turns, loss = (F.array_join(F.col(f"w.{part}"), "") for part in ("turns", "loss"))
    return whole.select("conv_id", "n_turns", turns.alias("turns"), loss.alias("loss"), "formatted_chars")


_LEN = "len({0}) + len({0}) - len(replace(replace(replace({0}, '\\', ''), '<', ''), '>', ''))"

#: The same for DuckDB, from the conversations themselves; formatted_chars adds up the windows' turns.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
placed AS (
  SELECT *, row_number() OVER o = 1 AND role = 'system' AS sys,
         CASE WHEN row_number() OVER o = 1 AND role = 'system' THEN 0
              ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {TURN_TOKENS} END AS tokens,
         row_number() OVER o AS place,
         {len("<turn n >" + END)} + {_LEN.format("role")} + {_LEN.format("text")} AS chars
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sums AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         sum(tokens) OVER (PARTITION BY conv_id) AS total FROM placed),
windowed AS (SELECT *, floor(start / {_stride(BUDGET, HISTORY, SYSTEM)}) AS win FROM sums),
lasts AS (SELECT *, max(start + tokens) OVER (PARTITION BY conv_id, win) AS last_end FROM windowed)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + coalesce(sum(chars) FILTER (NOT sys AND last_end < total AND last_end - start <= {HISTORY}), 0)
        + coalesce(max(chars) FILTER (sys), 0) * count(DISTINCT win) FILTER (win > 0))::BIGINT AS formatted_chars
FROM lasts GROUP BY conv_id
"""
