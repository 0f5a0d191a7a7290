"""Conversations without quotes, in the order of replies; DataFrame functions only.

Every line of a message has a quote level: the number of leading ``>`` marks, one more below a forwarding rule
("Original Message"). Lines that introduce a quote ("... wrote:") go with it. Quoted passages (runs of one level, their
paragraphs and their lines) are normalised to lower-case letters and digits, hashed, and joined to the latest earlier
message of the conversation that says the same in its own lines. The message quoted at the lowest level, with the most
passages of ``LINE_WORDS`` words or more, is what is replied to; shorter passages decide where those do not. A message
that quotes nothing known replies to the one before it.

Messages come out in the order of the reply tree: a message, then what answers it, each answer with all that follows
from it. Chains of plain answers share one branch, so sort keys grow with the nesting of branches, not with turns.
Nothing is gathered per conversation: what comes before a turn is found in two steps, by blocks of turns.

Nulls: a null text is an empty one. Rows with a null conversation or turn are messages without links, in front.
Repeated rows, and rows of one turn, stay as they are and share their links. An empty table gives no rows. Further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adinsight.llm.common import table, whole, written

#: Words of a passage that counts before all shorter ones.
LINE_WORDS = 4
#: Turns of one block.
BLOCK_TURNS = 1024
_LAST = 2**62

# How mail programs introduce a quote, and the rule above a forwarded message.
INTRODUCTION = r"(?i)^[ \t]*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió|[^:]{1,80}\b(?:wrote|schrieb|a écrit|escribió))[ \t]*:[ \t]*$"
FORWARDED = r"(?i)^[ \t]*-{2,}[ \t]*(?:original message|forwarded message|ursprüngliche nachricht|message d'origine|mensaje original)[ \t]*-{2,}[ \t]*$"


def parsed(text: Column) -> Column:
    """The lines of a text as an array of (level, body, rule)."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, r"^((?:[ \t]*>)*)", 1)
        body = F.regexp_replace(x, r"^(?:[ \t]*>)+[ \t]?", "")
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), body.alias("body"), body.rlike(FORWARDED).alias("rule"))

    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), line)


def _leveled(messages: DataFrame) -> DataFrame:
    """Adds __lines (level, body), where introductions and forwarding rules count as part of their quote."""
    rows = messages.withColumn("__raw", parsed(whole("text")))
    first_rule = F.array_position(F.transform("__raw", lambda x: x["rule"]), True)
    rows = rows.withColumn("__rule", F.when(first_rule > 0, first_rule - 1).cast("int"))
    deeper = F.transform("__raw", lambda x, i: F.struct(
        (x["level"] + F.when(i >= F.col("__rule"), 1).otherwise(0)).alias("level"), x["body"].alias("body")))
    rows = rows.withColumn("__deep", deeper)

    def settled(x: Column, i: Column) -> Column:
        following = F.get("__deep", i + 1)["level"]
        introduces = x["body"].rlike(INTRODUCTION) & (following == x["level"] + 1)
        return F.struct(F.when(introduces, following).otherwise(x["level"]).alias("level"), x["body"].alias("body"), introduces.alias("skip"))

    return rows.withColumn("__lines", F.transform("__deep", settled)).drop("__raw", "__rule", "__deep")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(rows: DataFrame) -> DataFrame:
    """(conv, turn, level, hash, short): runs of one level as a whole, their paragraphs and their lines, of all messages."""
    lines = rows.select("conv", "turn", F.filter("__lines", lambda x: ~F.coalesce(x["skip"], F.lit(False))).alias("l"))
    # runs: neighbouring lines of one level, joined by a space, told apart by two control characters

    def runs(paragraphs: bool) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.get("l", i - 1)
            same = F.coalesce(before["level"] == x["level"], F.lit(False))
            if paragraphs:
                same = same & (normal(x["body"]) != "") & F.coalesce(normal(before["body"]) != "", F.lit(False))
            mark = F.when(same, " ").otherwise(F.concat(F.lit("\x02"), x["level"].cast("string"), F.lit("\x01")))
            return F.concat(mark, F.translate(x["body"], "\x01\x02", "  "))

        marked = F.filter(F.split(F.array_join(F.transform("l", piece), ""), "\x02"), lambda x: x != "")
        return F.transform(marked, lambda x: F.struct(F.substring_index(x, "\x01", 1).cast("int").alias("level"), F.substring_index(x, "\x01", -1).alias("body")))

    singles = F.transform("l", lambda x: F.struct(x["level"].alias("level"), x["body"].alias("body")))
    every = F.array_union(F.array_union(runs(False), runs(True)), singles)
    both = lines.select("conv", "turn", F.explode(every).alias("p")).select("conv", "turn", "p.level", normal(F.col("p.body")).alias("t"))
    short = F.size(F.split("t", " ")) < LINE_WORDS
    return both.filter("t != ''").select("conv", "turn", "level", F.xxhash64("t", F.length("t")).alias("hash"), short.alias("short"))


def latest(rows: DataFrame, keys: list[str], flag: Column, out: str, strict: bool) -> DataFrame:
    """Adds the largest turn with the flag before each row's turn (or up to it), within the keys.

    Two steps keep large groups apart: windows over blocks of turns, and one over the blocks' maxima.
    """
    rows = rows.withColumn("__block", F.floor(F.col("turn") / BLOCK_TURNS)).withColumn("__flagged", F.when(flag, F.col("turn")))
    inside = Window.partitionBy(*keys, "__block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    blocks = rows.groupBy(*keys, "__block").agg(F.max("__flagged").alias("m"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("__carried", F.max("m").over(earlier)).drop("m")
    found = rows.withColumn("__inside", F.max("__flagged").over(inside)).join(carried, [*keys, "__block"], "left")
    return found.withColumn(out, F.coalesce("__inside", "__carried")).drop("__block", "__flagged", "__inside", "__carried")


def linked(found: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, n_linked) of messages with a quote that an earlier message says itself."""
    quoted = found.filter("level > 0").groupBy("conv", "turn", "hash").agg(F.min("level").alias("level"), F.min("short").alias("short"))
    asked = quoted.select("conv", "hash").distinct()
    own = found.filter("level = 0").join(asked, ["conv", "hash"], "left_semi").select("conv", "turn", "hash").distinct()
    both = quoted.withColumn("own", F.lit(False)).unionByName(own.withColumn("level", F.lit(0)).withColumn("short", F.lit(False)).withColumn("own", F.lit(True)))
    placed = latest(both, ["conv", "hash"], F.col("own"), "source", strict=True).filter("not own and source is not null")
    votes = placed.groupBy("conv", "turn", "level", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("short")).alias("long"))
    return votes.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), F.col("long"), F.col("n"), F.col("source").alias("source")))["source"].alias("reply_to"),
                                             F.sum("n").alias("n_linked"))


def _prefixes(starts: DataFrame) -> DataFrame:
    """(conv, start, prefix) of branches, from (conv, start, parent, up): path doubling over the branches above."""
    step = F.array(F.lit(_LAST), -F.col("parent"), F.col("start"))
    now = written(starts.select("conv", "start", "up", step.alias("prefix")), "reply-branches")
    while now.filter("up is not null").limit(1).count():
        above = now.select("conv", F.col("start").alias("up"), F.col("up").alias("next"), F.col("prefix").alias("before"))
        now = written(now.join(above, ["conv", "up"], "left").select(
            "conv", "start", F.col("next").alias("up"), F.concat(F.coalesce("before", F.array().cast("array<bigint>")), "prefix").alias("prefix")), "reply-branches")
    return now.select("conv", "start", "prefix")


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages without quotes, sorted by conversation and reply order (``order_key``)."""
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = _leveled(rows)
    quoted = F.size(F.filter("__lines", lambda x: (x["level"] > 0) & ~F.coalesce(x["skip"], F.lit(False)))).cast("long")
    own = F.trim(F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n"))
    own = F.when(F.exists("__lines", lambda x: x["level"] > 0), own).otherwise(whole("text"))
    bare = rows.select("conv", "turn", "role", own.alias("bare"), quoted.alias("n_quoted"))
    known = written(linked(passages(rows.filter("conv is not null and turn is not null"))), "reply-links")

    turns = bare.filter("conv is not null and turn is not null").select("conv", "turn").distinct()
    turns = latest(turns.withColumn("any", F.lit(True)), ["conv"], F.col("any"), "previous", strict=True).drop("any")
    turns = turns.join(known, ["conv", "turn"], "left")
    starts_here = F.coalesce(F.col("reply_to") != F.col("previous"), F.lit(False))  # an answer to something else than the last message
    turns = written(latest(turns.withColumn("starts", starts_here), ["conv"], F.col("starts"), "branch", strict=False), "reply-turns")
    starts = turns.filter("starts").select("conv", F.col("turn").alias("start"), F.col("reply_to").alias("parent"))
    above = turns.select("conv", F.col("turn").alias("parent"), F.col("branch").alias("up"))
    prefixes = _prefixes(starts.join(above, ["conv", "parent"], "left"))
    placed = turns.join(prefixes.withColumnRenamed("start", "branch"), ["conv", "branch"], "left").select(
        "conv", "turn", F.coalesce("reply_to", "previous").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.concat(F.coalesce("prefix", F.array().cast("array<bigint>")), F.array("turn")).alias("order_key"))
    out = bare.join(placed, ["conv", "turn"], "left").select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("bare").alias(text_col),
        "reply_to", "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "order_key")
    return out.orderBy(conv_col, "order_key", role_col, text_col)


def op7_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations without quotes, in reply order."""
    found = reply_ordered(table(spark, sf_dir, "conversations"))
    return found.withColumn("order_key", F.array_join("order_key", "."))
