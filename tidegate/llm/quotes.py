"""Operator 6: quotation linking, DataFrame functions only.

Messages quote earlier ones with nested ``>`` prefixes. Runs of lines at one level are
passages; their normalised digests are joined to those of what earlier messages of the same
conversation say themselves. A message replies to the one it quotes least deeply, and the
conversation is rebuilt in reply order without the quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.ordered import ranked
from tidegate.session import cut_lineage

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Turns of one ordering step of a conversation, so that a large one is ordered in many tasks.
TURNS_TOGETHER = 4_096


def normalised(text: Column) -> Column:
    """A-Z lowered, white space (record and unit separators included) as one space, ends stripped."""
    spaced = F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D\x1E\x1F]+", " ")
    return F.btrim(spaced, F.lit(" "))


def prefix(line: Column) -> Column:
    """What stands before a quoted line: blanks and quote marks up to the last mark."""
    return F.rtrim(F.regexp_extract(line, r"^[ \t>]*+", 0), F.lit(" \t"))


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(prefix(line), "[^>]", ""))


def body(line: Column) -> Column:
    """The line after its prefix and one space; a line without marks is its own body."""
    rest = F.substring(line, F.length(prefix(line)) + 1, F.length(line))
    return F.when(level(line) == 0, line).otherwise(F.regexp_replace(rest, "^ ", ""))


def parse(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, turn, role, own, runs)``: own text, and ``level US passage`` strings of all runs.

    Arrays are zipped rather than indexed, so a text costs its length once.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    levels = F.transform(lines, level)
    zipped = F.arrays_zip(
        levels.alias("d"), F.concat(F.array(F.lit(-1)), levels).alias("p"), F.transform(lines, body).alias("b")
    )
    # the list of previous levels is one longer than the others
    rows = F.filter(zipped, lambda z: z["d"].isNotNull())
    own = F.array_join(F.transform(F.filter(rows, lambda z: z["d"] == 0), lambda z: z["b"]), "\n")
    marked = F.transform(rows, lambda z: F.concat(
        F.when(z["d"] == z["p"], F.lit("\n")).otherwise(F.concat(F.lit("\x1e"), z["d"].cast("string"), F.lit("\x1f"))),
        F.translate(z["b"], "\x1e\x1f", "  "),
    ))
    return messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.btrim(own, F.lit(BLANK)).alias("own"), F.split(F.array_join(marked, ""), "\x1e").alias("runs"),
    )


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def originals(parsed: DataFrame) -> DataFrame:
    """``(conv, digest, source_turn)``: the first message that says a text, paragraph or line itself."""
    units = F.concat(F.array(F.col("own")), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"))
    said = parsed.select("conv", "turn", F.explode(F.array_distinct(F.transform(units, normalised))).alias("unit"))
    return said.where("unit <> ''").groupBy("conv", digest(F.col("unit")).alias("digest")).agg(F.min("turn").alias("source_turn"))


def passages(parsed: DataFrame) -> DataFrame:
    """``(conv, turn, level, digest)`` of every quoted passage that is not blank."""
    run = parsed.select("conv", "turn", F.explode("runs").alias("run")).select(
        "conv", "turn", F.substring_index("run", "\x1f", 1).try_cast("int").alias("level"),
        normalised(F.substring_index("run", "\x1f", -1)).alias("passage"),
    )
    return run.where("level > 0 and passage <> ''").select("conv", "turn", "level", digest(F.col("passage")).alias("digest"))


def roots(links: DataFrame) -> DataFrame:
    """``(conv, turn, root_turn, depth)`` from ``(conv, turn, parent_turn)`` by pointer doubling.

    Parents are earlier turns, so there are no cycles; the number of rounds is the logarithm of
    the longest chain of replies, and a message takes part until it has reached its root.
    """
    ended = F.col("parent_turn").isNull()
    start = cut_lineage(links.select(
        "conv", "turn", F.coalesce("parent_turn", "turn").alias("up"), (~ended).cast("long").alias("depth"), ended.alias("done"),
    ))
    done, active = start.where("done"), start.where("not done")
    while not active.isEmpty():
        above = done.unionByName(active).select(
            "conv", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), "done"
        )
        moved = cut_lineage(active.drop("done").join(above, ["conv", "up"]).select(
            "conv", "turn", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), "done"
        ))
        done, active = done.unionByName(moved.where("done")), moved.where("not done")
    return done.select("conv", "turn", F.col("up").alias("root_turn"), "depth")


def reply_order(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row for each message, in its place among the replies, without what it quotes.

    ``(conv_id, turn, role, own_text, n_passages, n_linked, max_level, parent_turn, root_turn,
    depth, reply_order)``. A passage is linked to the first message of its conversation that
    says it, if that is an earlier turn. The parent is the source of the least nested linked
    passage, the latest turn among equals; a message without one starts a thread. Order is by
    thread, then turn, from 1. Rows with the same conversation and turn share their links and
    are ordered by their texts. A null text is empty; rows with a null conversation or turn have
    no links and no place. Other columns are not read.
    """
    parsed = cut_lineage(parse(messages, conv_col, turn_col, role_col, text_col))
    named = parsed.where("conv is not null and turn is not null")
    quoted = cut_lineage(passages(named))
    sources = cut_lineage(originals(named))
    # both sides are plain shuffles: a passage that a third of all messages quote is split
    linked = quoted.join(sources, ["conv", "digest"], "left").select(
        "conv", "turn", "level", F.when(F.col("source_turn") < F.col("turn"), F.col("source_turn")).alias("source_turn")
    )
    best = F.max(F.when(F.col("source_turn").isNotNull(), F.struct((-F.col("level")).alias("l"), "source_turn")))
    facts = linked.groupBy("conv", "turn").agg(
        F.count(F.lit(1)).alias("n_passages"), F.count("source_turn").alias("n_linked"),
        F.max("level").alias("max_level"), best["source_turn"].alias("parent_turn"),
    )
    keys = named.select("conv", "turn").distinct()
    facts = cut_lineage(keys.join(facts, ["conv", "turn"], "left"))
    placed = cut_lineage(facts.join(roots(facts), ["conv", "turn"]))
    rows = named.select("conv", "turn", "role", "own").join(placed, ["conv", "turn"]).withColumn(
        "stretch", F.struct("root_turn", F.floor(F.col("turn") / TURNS_TOGETHER).alias("part"))
    )
    order = [F.col("root_turn"), F.col("turn"), F.col("own"), F.col("role")]
    found = ranked(cut_lineage(rows), ["conv"], "stretch", order, "reply_order").select(
        "conv", "turn", "role", "own", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_passages", "n_linked", "max_level")],
        "parent_turn", "root_turn", "depth", "reply_order",
    )
    rest = parsed.where("conv is null or turn is null").select("conv", "turn", "role", "own")
    out = found.unionByName(rest, allowMissingColumns=True)
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("own").alias("own_text"),
        "n_passages", "n_linked", "max_level", "parent_turn", "root_turn", "depth", "reply_order",
    )


def as_mail(conversations: DataFrame) -> DataFrame:
    """Conversations as mail: each message quotes the turn before it, and that one the turn before.

    ``conversations`` hold no quotes; this derives the input of the operator from all of them.
    """
    said = cut_lineage(conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("said")))
    before = lambda k: said.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias(f"said_{k}"))
    quote = lambda c, mark: F.concat(F.lit(mark), F.replace(F.col(c), F.lit("\n"), F.lit("\n" + mark)))
    return (
        conversations.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
        .withColumn("text", F.concat_ws("\n", quote("said_2", "> > "), quote("said_1", "> "), F.coalesce("text", F.lit(""))))
        .select(*conversations.columns)
    )
