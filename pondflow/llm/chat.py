"""Chat formatting in budgeted windows, in DataFrame functions only.

Turns are laid out as ``### role: text</turn>`` lines. Prefix sums of the turns' tokens
choose the windows: a conversation's token line is cut into equal steps and a turn
belongs to the window of the step in which it begins, so windows are aligned to
turns. Every window starts with the conversation's system turn, if its first turn is
one, and repeats the turns that begin within ``history`` tokens before it. A step is half of
what the budget leaves beside both, so a window holds at most the budget while none of
its turns is longer than a step (a longer one ends its window and is never cut). The loss mask covers the texts of the window's own
assistant turns; repeated turns are masked, so each assistant text is a target once.

Texts are escaped reversibly: the backslash, ``<`` and ``#`` (in roles the
colon too) become a backslash and a letter, so control strings occur only where the template puts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
# Fixed codes of the escapes; the backslash is coded first and decoded last.
CODES = [("\\", "\\s"), ("<", "\\l"), ("#", "\\h")]
ROLE_CODES = [*CODES, (":", "\\c"), ("\n", "\\n")]


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_windows(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   budget: int = 512, history: int = 128) -> DataFrame:
    """(conv_id, window, text, n_repeated, n_tokens, loss): one row per window.

    ``n_repeated`` counts the leading turns that earlier windows own; ``loss`` is an array of
    (start, end) code point ranges of ``text``. Tokens are white-space separated
    words plus two for a turn's marks. Turns go by ``turn``, ties by role and text;
    repeated rows are turns of their own; null texts and roles count as empty, a null turn comes first,
    and rows with a null conversation id form one conversation. Windows are
    numbered from 0 and steps in which no turn begins are left out. An empty table gives no windows.
    """
    one = Window.partitionBy("conv_id")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) + 2
    turns = (df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
             .withColumn("tokens", words.cast("long"))
             .withColumn("n", F.row_number().over(one.orderBy("turn", "role", "text"))))
    line = one.orderBy("n")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    system = (F.col("n") == 1) & (F.col("role") == "system")
    turns = (turns.withColumn("system", system)
             .withColumn("kept", F.first(F.when(F.col("system"), F.col("tokens")).otherwise(0)).over(so_far))
             .withColumn("stride", F.greatest(F.lit(1), F.floor((budget - history - F.col("kept")) / 2)))
             .withColumn("begin", F.sum("tokens").over(so_far) - F.col("tokens"))
             .withColumn("step", F.floor(F.col("begin") / F.col("stride")))
             .withColumn("fresh", F.col("step") != F.lag("step", 1, -1).over(line))
             .withColumn("window", F.sum(F.col("fresh").cast("long")).over(so_far) - 1)
             .withColumn("last", F.max("window").over(one)))
    # where the next window begins: the nearest later turn that opens one
    later = one.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("next", F.last(F.when(F.col("fresh"), F.col("begin")), True).over(later))
    turns = (turns.withColumn("head", F.concat(F.lit("### "), escape(F.col("role"), ROLE_CODES), F.lit(": ")))
             .withColumn("body", escape(F.col("text"))))
    # with history of a stride at most, a turn can only lie in the history of the very next window
    reach = F.least(F.lit(history), F.col("stride"))
    repeats = (F.when(F.col("system"), F.when(F.col("last") > 0, F.sequence(F.lit(1).cast("long"), F.col("last"))))
               .when(F.col("begin") >= F.col("next") - reach, F.array(F.col("window") + 1)))
    own = F.col("role") == "assistant"
    rows = turns.select("conv_id", "n", "head", "body", "tokens", F.col("window").alias("of"), own.alias("target"),
                        F.explode(F.concat(F.array("window"), F.coalesce(repeats, F.array().cast("array<long>")))).alias("window"))
    rows = rows.withColumn("repeated", F.col("window") != F.col("of")).withColumn("size", F.length("head") + F.length("body") + len(END))
    place = Window.partitionBy("conv_id", "window").orderBy("n")
    rows = rows.withColumn("at", F.sum("size").over(place) - F.col("size") + F.length("head"))
    piece = F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece"),
                     F.when(F.col("target") & ~F.col("repeated"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))).alias("loss"))
    return (rows.groupBy("conv_id", "window")
            .agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sum(F.col("repeated").cast("int")).alias("n_repeated"), F.sum("tokens").alias("n_tokens"))
            .select("conv_id", "window", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"), "n_repeated", "n_tokens",
                    F.filter(F.transform("pieces", lambda p: p["loss"]), lambda x: x.isNotNull()).alias("loss")))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, targets) parsed from the formatted text: the window's own turns as
    (role, text) and the texts under the loss mask, all unescaped."""
    lines = F.filter(F.split("text", END), lambda x: x != "")
    own = F.expr("slice(lines, n_repeated + 1, greatest(size(lines) - n_repeated, 0))")

    def parsed(x: Column) -> Column:
        mark = F.instr(x, ": ")
        return F.struct(unescape(F.substring(x, F.lit(5), mark - 5), ROLE_CODES).alias("role"),
                        unescape(F.substring(x, mark + 2, F.length(x))).alias("text"))

    masked = F.transform("loss", lambda r: unescape(F.substring(F.col("text"), (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int"))))
    return (windows.withColumn("lines", lines).withColumn("own", own)
            .select("conv_id", "window", "text", F.transform("own", parsed).alias("turns"), masked.alias("targets")))
