r"""Chat formatting into budgeted windows.

Turns are marked `<|im_start|>role\ntext<|im_end|>\n`. Inside roles and texts a backslash
is doubled and a lone backslash breaks up what would read as a mark (`<|` becomes `<\|`),
so the marks are unambiguous and the texts come back exactly.

A conversation is cut at turns. The prefix sums of the turns' tokens are laid over cells of
`room` tokens, where room is the budget less the system turn and the history allowance. Turns
that lie in one cell make a window; a turn across a cell's end joins the window before it if
both fit the room, and is a window of its own otherwise. So a window's own turns never have
more tokens than the room, but for a single turn that is longer by itself: such a turn keeps its
window to itself, whole, and only such windows (and those of a conversation whose system
turn leaves less than `history` + 1 tokens) exceed the budget. Each window starts with the
system turn (the first turn, if its role is `system`), then repeats the turns that begin at most
`history` tokens before the window, then has its own turns. The loss mask covers assistant
texts among a window's own turns only, so a repeated turn is never a target twice.

One shuffle by conversation serves the prefix sums, the windows and the reading back. A
conversation's digest needs its turns in one row, so that row grows with the longest
conversation.

Edge cases: a null text or role is empty; a null conv_id is a conversation of its own;
rows with the same turn number are ordered by role, then text, and repeated rows stay
repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, read

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY = 1024, 256
#: Tokens of a turn: UTF-8 bytes / BYTES_PER_TOKEN, rounded up, plus the marks.
BYTES_PER_TOKEN, MARK_TOKENS = 4, 4


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, mask, n_repeated): mask holds [start, end) of code points."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({"role_out": escape_role(F.col("role")), "text_out": escape(F.col("text"))})
    turns = turns.withColumn("tokens", F.ceil((F.octet_length("role_out") + F.octet_length("text_out")) / BYTES_PER_TOKEN).cast("long") + MARK_TOKENS)
    conv = Window.partitionBy("conv_id")
    in_order = conv.orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = turns.withColumn("ord", F.row_number().over(in_order))
    by_ord = conv.orderBy("ord")
    turns = turns.withColumn("is_system", (F.col("ord") == 1) & (F.col("role") == "system"))
    turns = turns.withColumn("system_tokens", F.max(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(conv))
    turns = turns.withColumn("room", F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(history + 1)))
    own = F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("tokens"))
    turns = turns.withColumn("end", F.sum(own).over(by_ord.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("end") - own)
    turns = turns.withColumn("cell", F.floor(F.col("before") / F.col("room")))
    # a turn across the end of its cell; the window before it starts at the cell or after the last such turn
    turns = turns.withColumn("across", ~F.col("is_system") & (F.col("end") > (F.col("cell") + 1) * F.col("room")))
    earlier = by_ord.rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest(F.coalesce(F.max(F.when(F.col("across"), F.col("end"))).over(earlier), F.lit(0)), F.col("cell") * F.col("room"))
    turns = turns.withColumns({"passed": F.coalesce(F.sum(F.col("across").cast("int")).over(earlier), F.lit(0)), "alone": F.col("across") & (F.col("end") - begin > F.col("room"))})
    turns = turns.withColumn("key", F.struct("passed", "cell", "alone"))
    fresh = (F.col("key") != F.lag("key").over(by_ord)) & ~F.lag("is_system").over(by_ord)
    turns = turns.withColumn("fresh", F.coalesce(fresh, F.lit(False)))
    turns = turns.withColumn("window", F.sum(F.col("fresh").cast("int")).over(by_ord.rowsBetween(Window.unboundedPreceding, 0)))
    turns = turns.withColumns({
        "last_window": F.max("window").over(conv),
        "later": F.collect_list(F.when(F.col("fresh"), F.col("window"))).over(conv.orderBy("before").rangeBetween(1, history)),
    })
    places = F.when(F.col("is_system"), F.sequence(F.lit(0).cast("long"), F.col("last_window"))).otherwise(F.concat(F.array("window"), "later"))
    placed = turns.select("conv_id", "ord", "role", "role_out", "text_out", "is_system", F.col("window").alias("first_window"), F.explode(places).alias("window"))
    placed = placed.withColumn("repeated", F.col("window") != F.col("first_window"))
    grouped = placed.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("ord", "role", "role_out", "text_out", "repeated"))).alias("t"),
        F.sum(F.col("repeated").cast("int")).alias("n_repeated"),
    )
    block = lambda x: F.concat(F.lit(START), x["role_out"], F.lit("\n"), x["text_out"], F.lit(END))

    def mask(blocks: Column, t: Column) -> Column:
        at = lambda i: F.aggregate(F.slice(blocks, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))

        def span(x: Column, i: Column) -> Column:
            head = at(i) + len(START) + 1 + F.length(x["role_out"])
            return F.when((x["role"] == "assistant") & ~x["repeated"], F.struct(head.alias("start"), (head + F.length(x["text_out"])).alias("end")))

        return F.filter(F.transform(t, span), lambda x: x.isNotNull())

    grouped = grouped.withColumn("blocks", F.transform("t", block))
    return grouped.select(
        "conv_id", "window", F.array_join("blocks", "").alias("formatted"), let(F.struct("blocks", "t"), lambda s: mask(s["blocks"], s["t"])).alias("mask"), "n_repeated"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars) from windows alone: repeated turns are skipped."""

    def turn(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    blocks = F.split(F.col("formatted"), r"<\|im_start\|>")
    one = formatted.select(
        "conv_id", "window",
        F.transform(F.slice(blocks, F.col("n_repeated") + 2, F.greatest(F.size(blocks) - F.col("n_repeated") - 1, F.lit(0))), turn).alias("turns"),
        F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"]))).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select(
        "conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["loss"])).alias("loss"), "formatted_chars"
    )


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations")
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("x"))
    own = own.select("conv_id", "x.turn", "x.role", F.lit(said).alias("text"))
    both = table.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    out = read_back(windows(both))
    loss = F.array_join("loss", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def oracle(budget: int = BUDGET, history: int = HISTORY) -> str:
    esc = lambda x: f"replace(replace({x}, '\\', '\\\\'), '<|', '<\\|')"
    said = "<|im_end|><|im_start|>assistant ok"
    return f"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{said}' UNION ALL SELECT -1, 1, 'assistant', '{said}'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ord,
    replace({esc("role")}, chr(10), '<\\n>') AS role_out, {esc("text")} AS text_out
  FROM turns
), sized AS (
  SELECT *, (strlen(role_out) + strlen(text_out) + {BYTES_PER_TOKEN - 1}) // {BYTES_PER_TOKEN} + {MARK_TOKENS} AS tokens,
    ord = 1 AND role = 'system' AS is_system,
    length(role_out) + length(text_out) + {len(START) + 1 + len(END)} AS chars
  FROM numbered
), roomed AS (
  SELECT *, greatest({budget - history} - max(CASE WHEN is_system THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id), {history + 1}) AS room,
    sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY ord) AS "end"
  FROM sized
), celled AS (SELECT *, CASE WHEN is_system THEN "end" ELSE "end" - tokens END AS before, before // room AS cell, NOT is_system AND "end" > (cell + 1) * room AS across FROM roomed),
keyed AS (
  SELECT *, coalesce(count(*) FILTER (across) OVER earlier, 0) AS passed,
    across AND "end" - greatest(coalesce(max("end") FILTER (across) OVER earlier, 0), cell * room) > room AS alone
  FROM celled WINDOW earlier AS (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT *, coalesce((passed, cell, alone) <> lag((passed, cell, alone)) OVER o AND NOT lag(is_system) OVER o, false) AS fresh
  FROM keyed WINDOW o AS (PARTITION BY conv_id ORDER BY ord)
), chars AS (
  SELECT conv_id, sum(chars * (1 + CASE WHEN is_system THEN windows ELSE later END))::BIGINT AS formatted_chars FROM (
    SELECT conv_id, chars, is_system, count(*) FILTER (fresh) OVER (PARTITION BY conv_id) AS windows,
      count(*) FILTER (fresh) OVER (PARTITION BY conv_id ORDER BY before RANGE BETWEEN 1 FOLLOWING AND {history} FOLLOWING) AS later
    FROM opened) GROUP BY conv_id
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY ord), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars
FROM numbered JOIN chars USING (conv_id) GROUP BY conv_id
"""
