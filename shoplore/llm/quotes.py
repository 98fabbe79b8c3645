"""Conversations from messages that quote each other: native columns, joins and windows throughout.

Quoted lines carry one ``>`` per level. Runs of lines of one level are passages; passages and their lines
are normalised, hashed and joined to the messages that wrote them. A message replies to the message it
quotes, and conversations are put in reply order, without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplore.llm.common import fresh
from shoplore.operators.ordered import with_row_number
from shoplore.session import checkpointed

# The marks of a quoted line, and lines that announce a quote.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
ANNOUNCES = r"(?i)^.*\b(?:wrote|writes|schrieb|a écrit|escribió)\b[^:]*:[ \t\r]*$"
#: Tables of up to so many narrow rows are broadcast, which spares the texts a shuffle; larger ones are joined by one.
BROADCAST_ROWS = 100_000
#: Turns are looked through in spans of so many, so that no window holds a whole conversation.
SPAN = 4096


def _lines(text: Column) -> Column:
    """Array of ``(level, body)``, one for each line."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(x, MARKS, "").alias("body")))


def own_text(text: Column) -> Column:
    """A text without quoted lines and without the lines that announce them; null stays null."""
    lines = _lines(text)
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(
        x["body"].rlike(ANNOUNCES) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    joined = F.array_join(F.transform(kept, lambda x: x["body"]), "\n")
    whole = F.when(text.rlike(r"(?m)" + MARKS), F.regexp_replace(joined, r"^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$", "")).otherwise(text)
    return whole


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))


def _digest(text: Column) -> Column:
    return F.md5(normalised(text))


def link_replies(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """``(conv, turn, reply_to, level)``: the earlier message of the conversation that a message quotes.

    Of the quoted passages that are found, those of the lowest level count, then the longest, then the
    latest source. A passage written several times belongs to the latest message before the quote.
    """
    base = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(text).alias("text")).dropna()
    quoting = checkpointed(base.filter(F.col("text").rlike(r"(?m)" + MARKS)).distinct())
    key = ["conv", "turn", "text"]
    lines = quoting.select(*key, F.posexplode(_lines(F.col("text"))).alias("at", "line")).select(
        "conv", "turn", F.xxhash64("text").alias("body_of"), "at", F.col("line.level").alias("level"), F.col("line.body").alias("body"))
    message = Window.partitionBy("conv", "turn", "body_of").orderBy("at")
    changed = (F.col("level") != F.coalesce(F.lag("level").over(message), F.lit(-1))).cast("int")
    runs = (lines.withColumn("changed", changed).withColumn("run", F.sum("changed").over(message)).filter("level > 0"))
    passages = runs.groupBy("conv", "turn", "body_of", "run", "level").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), "\n").alias("unit"))
    units = passages.select("conv", "turn", "level", "unit").unionByName(
        runs.select("conv", "turn", "level", F.col("body").alias("unit")))
    units = (units.filter(normalised(F.col("unit")) != "")
             .select("conv", "turn", "level", _digest(F.col("unit")).alias("h"),
                     F.size(F.split(normalised(F.col("unit")), " ")).alias("words")).distinct())
    units = checkpointed(units)

    # who wrote what: whole texts, paragraphs and lines of the conversations that quote
    own = own_text(F.col("text"))
    written = (base.join(units.select("conv").distinct(), "conv", "left_semi").select("conv", "turn", own.alias("own"))
               .select("conv", "turn", F.explode(F.array_distinct(F.concat(
                   F.array("own"), F.split("own", r"\n[ \t\r]*\n"), F.split("own", "\n")))).alias("unit"))
               .select("conv", "turn", _digest(F.col("unit")).alias("h"))
               .join(units.select("conv", "h").distinct(), ["conv", "h"], "left_semi").distinct())
    marked = units.select("conv", "h", "turn").distinct().withColumn("wrote", F.lit(None).cast("long")).unionByName(
        written.withColumn("wrote", F.col("turn"))).withColumn("span", F.floor(F.col("turn") / SPAN))
    inside = Window.partitionBy("conv", "h", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = marked.withColumn("near", F.max("wrote").over(inside)).filter("wrote IS NULL").select("conv", "h", "turn", "span", "near")
    spans = marked.groupBy("conv", "h", "span").agg(F.max("wrote").alias("last"))
    before = Window.partitionBy("conv", "h").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("earlier", F.max("last").over(before)).select("conv", "h", "span", "earlier")
    sources = (near.join(spans, ["conv", "h", "span"], "left")
               .select("conv", "h", "turn", F.coalesce("near", "earlier").alias("source")).filter("source IS NOT NULL"))
    best = (units.join(sources, ["conv", "h", "turn"]).groupBy("conv", "turn")
            .agg(F.max(F.struct((-F.col("level")).alias("rank"), "words", "source")).alias("best")))
    return checkpointed(best.select("conv", "turn", F.col("best.source").alias("reply_to"), (-F.col("best.rank")).alias("level")))


def reply_threads(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(conv, turn, reply_to, root, depth)``: the message a chain of replies begins with and how far away
    it is. Pointers double in each round, so a chain of n replies takes log2(n) joins."""
    ahead = links.select("conv", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth"))
    for _ in range(most_rounds):
        further = ahead.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        joined = checkpointed(ahead.join(further, (F.col("conv") == F.col("c")) & (F.col("root") == F.col("t")), "left"))
        ahead = joined.select("conv", "turn", "reply_to", F.coalesce("r", "root").alias("root"),
                              (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"))
        if joined.filter("r IS NOT NULL").isEmpty():
            return ahead
    raise RuntimeError(f"reply chains did not end in {most_rounds} rounds")


def _sent_if_small(df: DataFrame) -> DataFrame:
    stored = checkpointed(df)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def reply_ordered(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, ``position`` in its conversation (from 0), ``reply_to``,
    ``thread`` (turn its chain of replies begins with), ``depth`` in it, ``quote_levels``, ``quoted_lines`` and
    the text without quotes.

    Conversations are ordered by thread, then depth, then turn. A message is known by conversation and turn; rows
    that repeat both get a place each, in the order of role and the MD5 of the text (nulls first), and share their links. Quotes of nothing
    earlier in the conversation link to nothing, nor do messages without conversation or turn; a null text stays
    null. Rows without a conversation form one. Other columns are not read.

    No step needs a whole conversation, or all copies of a line, in one task: positions come from a range
    partitioning of all messages, sources from windows over bounded spans of turns.
    """
    links = link_replies(messages, conv, turn, text)
    threads = _sent_if_small(reply_threads(links).withColumnsRenamed({"turn": "of"}))
    lines = _lines(F.col("x"))
    base = messages.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("x")).select(
        "c", "t", "role", own_text(F.col("x")).alias("own"),
        F.when(F.col("x").isNull(), 0).otherwise(F.array_max(F.transform(lines, lambda x: x["level"]))).cast("int").alias("quote_levels"),
        F.when(F.col("x").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: x["level"] > 0))).cast("int").alias("quoted_lines"))
    placed = base.join(threads, (F.col("c") == F.col("conv")) & (F.col("t").cast("long") == F.col("of")), "left").select(
        "c", "t", "role", "own", "quote_levels", "quoted_lines", "reply_to", F.coalesce("root", F.col("t").cast("long")).alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    order = ["c", "thread", "depth", "t", "role", F.md5("own")]
    numbered = with_row_number(placed, order, out="number")
    first = _sent_if_small(numbered.groupBy("c").agg(F.min("number").alias("first")).withColumnRenamed("c", "of"))
    out = numbered.join(first, F.col("c").eqNullSafe(F.col("of")))
    names = fresh([], conv, turn, role, "position", "reply_to", "thread", "depth", "quote_levels", "quoted_lines", text)
    columns = ["c", "t", "role", F.col("number") - F.col("first"), "reply_to", "thread", "depth", "quote_levels", "quoted_lines", "own"]
    return out.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(columns, names)])


def chat_line(role: str | Column, text: str | Column, begin: str = "<|", middle: str = "|>\n", end: str = "\n<|end|>\n") -> Column:
    """A message as a line of chat training text; a null text is empty."""
    role, text = (F.col(c) if isinstance(c, str) else c for c in (role, text))
    return F.concat(F.lit(begin), F.coalesce(role, F.lit("unknown")), F.lit(middle), F.coalesce(text, F.lit("")), F.lit(end))
