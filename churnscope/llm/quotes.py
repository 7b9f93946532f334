"""Quotation linking (DataFrame functions only).

A line's quote level is the number of leading ``>`` marks.  Words of one level
that follow each other are a passage, normalised (lower case, white space
collapsed) over its line breaks.  Every window of ``WINDOW`` words of a quoted
passage, without punctuation around the words, and every quoted line is hashed;
within its conversation the hash is joined to the earliest message that has the
window, or the line as a whole line or sentence of a line, as text of its own.
A line comes from the message that most of the windows touching it come from, or
else the whole line (ties: the latest).  So parts of a line and re-wrapped
passages are linked; a part of fewer than ``WINDOW`` words that is neither a line
nor a sentence of a line is not.

A message replies to the message that most of its first-level quotes come from
(ties: the latest).  A thread is everything that leads to the same first message
by replies; sorting by ``conv_id, thread_turn, turn`` gives the conversation in
reply order: a thread's messages together, each after the message that it
answers.  ``text`` is what is left without the quoted lines, linked or not.
Messages that share conv_id and turn but not the text are linked each by itself;
where another message answers that turn, the thread goes on from the turn's
message with the most lines linked (ties: to the latest).

Only conversations with a quoted line are looked into.  Originals are
pre-aggregated per (conversation, hash), so a passage that is repeated or quoted
thousands of times gives one row per quote, never pairs.

Defined cases: null texts are empty; rows without conv_id or turn keep their
text and are linked to nothing; a quote without an earlier original is
``unlinked``; repeated rows are linked alike, and count once; texts of any
length are handled whole; an empty table gives an empty result; other columns
are ignored.  Passages are told apart by 96 bits of hash within a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import stage

_MARKS = r"^[ \t]*(>[> \t]*)"
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
WINDOW = 4
HASH = "hash", "check"


def _units(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole lines, and windows of ``WINDOW`` words, of all texts; ``level`` 0 is the message's own text.

    Words of one level that follow each other are one passage, whatever its line
    breaks; a window is inside one passage and lists the lines that it touches.
    """

    def line(x, i):
        marks = F.regexp_extract(x, _MARKS, 1)
        content = F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, _MARKS, ""), r"\s+", " ")))
        return F.struct(i.alias("line"), F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), content.alias("content"))

    def words(x):
        bare = F.transform(F.split(x["content"], " "), lambda w: F.regexp_replace(w, _EDGES, ""))
        kept = F.filter(bare, lambda w: w != "")
        return F.transform(kept, lambda w: F.struct(w.alias("word"), x["line"].alias("line"), x["level"].alias("level")))

    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), line), lambda x: x["content"] != "")
    of = ("conv_id", "turn", "copy")
    texts = messages.select(*of, lines.alias("lines"))
    whole = texts.select(*of, F.explode("lines").alias("x")).select(*of, "x.level", F.array("x.line").alias("lines"), F.col("x.content").alias("unit"))
    at = [f"w{i}" for i in range(WINDOW)]
    runs = texts.select(*of, F.flatten(F.transform("lines", words)).alias(at[0]))
    for i in range(1, WINDOW):
        runs = runs.withColumn(at[i], F.slice(at[0], i + 1, F.size(at[0])))
    windows = runs.select(*of, F.explode(F.arrays_zip(*at)).alias("x")).filter(" AND ".join(f"x.{w}.level = x.w0.level" for w in at[1:]))
    each = lambda field: [F.col(f"x.{w}.{field}") for w in at]
    return whole, windows.select(
        *of, F.col("x.w0.level").alias("level"), F.array_distinct(F.array(*each("line"))).alias("lines"), F.concat_ws(" ", *each("word")).alias("unit")
    )


def quote_links(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, copy, level, original_turn, lines`` per message, level and original (null: unlinked).

    ``copy`` tells messages with different texts of one turn apart; equal rows are one message.
    """
    known = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = known.filter(F.col("text").rlike("(?m)" + _MARKS)).select("conv_id").distinct()
    whole, windows = _units(
        stage(known.join(quoting, "conv_id", "left_semi").select("conv_id", "turn", _copy(), "text").dropDuplicates(["conv_id", "turn", "copy"]), "quoting")
    )
    own = whole.filter("level = 0").select("conv_id", "turn", F.explode(F.array_union(F.array("unit"), F.split("unit", r"(?<=[.!?]) "))).alias("unit"))
    own = own.unionByName(windows.filter("level = 0").select("conv_id", "turn", "unit"))
    originals = own.groupBy("conv_id", *_hash()).agg(F.min("turn").alias("original_turn"))
    quoted = whole.withColumn("window", F.lit(0)).unionByName(windows.withColumn("window", F.lit(1))).filter("level > 0")
    line = ["conv_id", "turn", "copy", "level", "line"]
    quotes = quoted.select(*line[:4], F.explode("lines").alias("line"), "window", *_hash()).groupBy(*line, "window", *HASH).agg(
        F.count(F.lit(1)).alias("n")
    )
    earlier = F.when(F.col("original_turn") < F.col("turn"), F.col("original_turn"))
    # a line's original: that of most windows that touch it, else of the whole line
    votes = quotes.join(originals, ["conv_id", *HASH], "left").withColumn("original_turn", earlier)
    votes = votes.groupBy(*line, "window", "original_turn").agg(F.sum("n").alias("n"))
    best = F.max(F.when(F.col("original_turn").isNotNull(), F.struct("window", "n", "original_turn")))
    return (
        votes.groupBy(*line)
        .agg(best["original_turn"].alias("original_turn"), F.sum(F.when(F.col("window") == 0, F.col("n"))).alias("lines"))
        .groupBy("conv_id", "turn", "copy", "level", "original_turn")
        .agg(F.sum("lines").alias("lines"))
    )


def _copy():
    return F.sha2(F.coalesce("text", F.lit("")), 256).alias("copy")


def _hash():
    return F.xxhash64("unit").alias("hash"), F.hash("unit").alias("check")


def _threads(parents: DataFrame, max_rounds: int = 40) -> DataFrame:
    """First message and depth of every replying message, by pointer doubling."""
    at = parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth"))
    for _ in range(max_rounds):
        above = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        at = stage(
            at.join(above, ["conv_id", "up"], "left").select(
                "conv_id", "turn", F.coalesce("up2", "up").alias("up"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved"),
            ),
            "threads",
        )
        if at.filter("moved").limit(1).count() == 0:
            return at.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth")
        at = at.drop("moved")
    raise RuntimeError("reply chains did not settle")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, parent_turn, thread_turn, depth, quoted_lines, unlinked_lines``; one row per message."""
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", _copy())
    links = stage(quote_links(messages), "quotes")
    of = ["conv_id", "turn", "copy"]
    first = F.when((F.col("level") == 1) & F.col("original_turn").isNotNull(), F.struct("lines", "original_turn"))
    found = stage(
        links.groupBy(*of).agg(
            F.sum("lines").alias("quoted_lines"),
            F.coalesce(F.sum(F.when(F.col("original_turn").isNull(), F.col("lines"))), F.lit(0)).alias("unlinked_lines"),
            F.max(first).alias("best"),
        ),
        "replies",
    )
    turns = found.filter("best IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("best").alias("best"))
    above = _threads(turns.select("conv_id", "turn", F.col("best.original_turn").alias("parent_turn")))
    above = above.select("conv_id", F.col("turn").alias("parent_turn"), "thread_turn", "depth")
    found = found.select(*of, "quoted_lines", "unlinked_lines", F.col("best.original_turn").alias("parent_turn"))
    found = found.join(above, ["conv_id", "parent_turn"], "left")
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x: ~x.rlike(_MARKS))
    zero = F.lit(0).cast("long")
    return messages.join(found, of, "left").select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("quoted_lines").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.trim(F.array_join(kept, "\n"))).alias("text"),
        "parent_turn",
        F.coalesce("thread_turn", "parent_turn", "turn").alias("thread_turn"),
        F.when(F.col("parent_turn").isNotNull(), F.coalesce("depth", zero) + 1).otherwise(zero).alias("depth"),
        *[F.coalesce(c, zero).alias(c) for c in ("quoted_lines", "unlinked_lines")],
    )
