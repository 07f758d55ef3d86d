"""Reply-ordered conversations from quotations, with DataFrame functions only.

Lines carry nested quote levels (`>` marks). Quoted passages and their lines are normalised and hashed, joined to the
earliest message of the conversation that says the same, and so give every message the message it answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, ready, staged

MARK = r"^(?:[ \t]{0,3}>)+[ \t]?"
INTRO = r"(?i)(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"


def quoted_lines(messages: DataFrame) -> DataFrame:
    """(msg, conv_id, turn, text) -> one row a line: pos, level, line without marks, its normal form, intro, passage.

    `passage` numbers runs of lines of one level that no blank line parts; `intro` marks "X wrote:" before a quote.
    """
    lines = messages.select("msg", "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("pos", "raw"))
    mark = F.regexp_extract("raw", MARK, 0)
    lines = lines.withColumn("level", F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))).withColumn("line", F.substring("raw", F.length(mark) + 1, F.length("raw")))
    lines = lines.withColumn("norm", F.lower(F.trim(F.regexp_replace("line", r"\s+", " "))))
    w = Window.partitionBy("msg").orderBy("pos")
    lines = lines.withColumn("intro", (F.col("level") == 0) & (F.lead("level", 1, 0).over(w) > 0) & F.col("line").rlike(INTRO))
    new = (F.col("level") != F.lag("level", 1, -1).over(w)) | (F.lag("norm", 1, "").over(w) == "")
    return lines.withColumn("passage", F.sum(new.cast("int")).over(w)).drop("raw")


def _own():
    """The conversation as a key: a null conv_id is one of its own, apart from every number."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))


def _joined(rows: DataFrame, *keys: str) -> DataFrame:
    """Normal forms of each group's lines joined in order."""
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]), " ")
    return rows.groupBy(*keys).agg(own.alias("said"))


def link_quotations(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row a message: conv_id, turn, role, body, n_quotes, n_linked, n_elsewhere,
    max_level, parent_turn, thread_turn, position.

    body is the message without quotes and their introductions. A quote links to the earliest earlier turn of its
    conversation that says the passage, or else its lines; quotes only found in other conversations are counted in
    n_elsewhere. parent_turn is the turn with most quoted characters at the outermost linked level (ties: the later
    one); thread_turn is the first message its parents lead to; position (from 0) orders a conversation by thread and
    turn, so that a parent always comes before its replies.

    Defined cases: null texts are empty messages; blank quotes link with nothing; null conv_id is a conversation of
    its own, null turns come first and are nobody's parent; repeated rows are messages of their own; very common
    lines are one row a conversation before they are joined; other columns are ignored; empty tables stay empty.
    """
    ready(conversations.sparkSession)
    messages = staged(conversations.select(F.monotonically_increasing_id().alias("msg"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "text"), "messages")
    lines = staged(quoted_lines(messages), "lines")
    said = lines.filter("level = 0 and not intro and norm <> ''")
    quoted = lines.filter("level > 0 and norm <> ''")
    passages = _joined(quoted, "msg", "conv_id", "turn", "level", "passage")
    units = said.select("conv_id", "turn", F.col("norm").alias("said")).unionByName(_joined(said, "msg", "conv_id", "turn", "passage").select("conv_id", "turn", "said")).unionByName(_joined(said, "msg", "conv_id", "turn").select("conv_id", "turn", "said"))
    units = units.filter("turn is not null").select(F.md5("said").alias("key"), "conv_id", "turn")
    here = units.groupBy("key", _own().alias("conv")).agg(F.min("turn").alias("origin"))
    anywhere = units.groupBy("key").agg(F.lit(True).alias("somewhere"))
    asked = passages.select("msg", _own().alias("conv"), "turn", "level", "passage", F.lit(0).alias("fine"), "said")
    asked = asked.unionByName(quoted.select("msg", _own().alias("conv"), "turn", "level", "passage", F.lit(1).alias("fine"), F.col("norm").alias("said")))
    asked = asked.select("msg", "conv", "turn", "level", "passage", "fine", F.length("said").alias("size"), F.md5("said").alias("key"))
    met = staged(asked.join(here, ["key", "conv"], "left").join(anywhere, "key", "left").withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin"))), "met")
    per = met.groupBy("msg", "level", "passage").agg(F.max((F.col("origin").isNotNull()).cast("int")).alias("linked"), F.max((F.col("somewhere").isNotNull()).cast("int")).alias("seen"))
    counts = per.groupBy("msg").agg(F.count("*").alias("n_quotes"), F.sum("linked").alias("n_linked"), F.sum(F.col("seen") * (1 - F.col("linked"))).alias("n_elsewhere"), F.max("level").alias("max_level"), F.min(F.when(F.col("linked") == 1, F.col("level"))).alias("outer"))
    votes = met.filter("origin is not null").join(counts.select("msg", "outer"), "msg").filter("level = outer").groupBy("msg", "origin").agg(F.sum("size").alias("size"))
    parents = votes.groupBy("msg").agg(F.max(F.struct("size", "origin")).getField("origin").alias("parent_turn"))
    # threads: follow parents to the first message, doubling the step each round
    at = staged(messages.select("msg", _own().alias("conv"), "turn").join(parents, "msg").groupBy("conv", "turn").agg(F.min("parent_turn").alias("up")), "parents")
    while not at.isEmpty():
        onward = at.select("conv", F.col("turn").alias("up"), F.col("up").alias("further"))
        nxt = staged(at.join(onward, ["conv", "up"], "left").select("conv", "turn", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "parents")
        more = not nxt.filter("moved").isEmpty()
        drop(at)
        at = nxt.drop("moved")
        at.staged_path = nxt.staged_path
        if not more:
            break
    body = lines.filter("level = 0 and not intro").groupBy("msg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    whole = messages.select("msg", "conv_id", _own().alias("conv"), "turn", "role")
    whole = whole.join(parents, "msg", "left").join(at.select("conv", "turn", "up"), ["conv", "turn"], "left").join(counts.drop("outer"), "msg", "left").join(body, "msg", "left")
    whole = whole.withColumn("thread_turn", F.coalesce("up", "turn"))
    ordered = whole.repartitionByRange("conv_id", "thread_turn", "turn", "msg").sortWithinPartitions("conv_id", "thread_turn", "turn", "msg").withColumn("_id", F.monotonically_increasing_id())
    ordered = staged(ordered.drop("up", "conv"), "ordered").withColumn("_p", F.shiftright("_id", 33)).withColumn("_c", _own())
    starts = ordered.groupBy("_c", "_p").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    starts = starts.select("_c", "_p", "_first", (F.sum("_n").over(Window.partitionBy("_c").orderBy("_p")) - F.col("_n")).alias("_before"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return ordered.join(starts, ["_c", "_p"]).select(
        "conv_id", "turn", "role", F.regexp_replace(F.coalesce("body", F.lit("")), r"^\n+|\n+$", "").alias("body"), none("n_quotes"), none("n_linked"), none("n_elsewhere"), none("max_level"),
        "parent_turn", "thread_turn", (F.col("_id") - F.col("_first") + F.col("_before")).alias("position"),
    )
