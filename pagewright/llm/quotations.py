"""Chat formatting by quotation linking: quoted passages lead back to the messages that they come from.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

# The marks before a quoted line, and the line that announces a quotation.
MARKS = r"^((?:\x20{0,3}>)+)\x20?"
ANNOUNCED = r"(?i)^\x20*(?:(?:on|am|le|el)\b.{3,200}|.{1,100})\b(?:wrote|schrieb|escribió|a écrit)\x20?:\x20*$"


def _plain(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def parsed(text: Column) -> Column:
    """The lines of a text as an array of (level, line, announces): level counts the marks, which the line has lost."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n", -1)
    marks = lambda x: F.regexp_extract(x, MARKS, 1)
    level = lambda x: F.length(F.regexp_replace(marks(x), "[^>]", ""))
    told = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line"), x.rlike(ANNOUNCED).alias("announces")))
    return F.transform(F.array(told), lambda a: F.transform(a, lambda x, i: F.struct(x["level"].alias("level"), x["line"].alias("line"), (x["announces"] & (x["level"] == 0) & (F.coalesce(F.get(a, i + 1)["level"], F.lit(0)) > 0)).alias("announces"))))[0]


def body(lines: Column) -> Column:
    """What is not quoted and announces no quotation, without blank lines around it."""
    own = F.filter(lines, lambda x: (x["level"] == 0) & ~x["announces"])
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")


#: The least length of a sentence that links on its own.
SENTENCE = 20


def _units(text: Column) -> Column:
    """A passage, its paragraphs, its lines and its longer sentences, normalised, each once, without empty ones."""
    whole, paragraphs, lines = F.array(text), F.split(text, r"\n[\x20\t]*\n"), F.split(text, "\n")
    sentences = F.filter(F.split(_plain(text), r"(?<=[.!?])\x20"), lambda x: F.length(x) >= SENTENCE)
    return F.filter(F.array_distinct(F.concat(F.transform(F.concat(whole, paragraphs, lines), _plain), sentences)), lambda x: x != "")


def passages(lines: Column) -> Column:
    """Maximal runs of lines of one quote level, as (level, text)."""

    def runs(a: Column) -> Column:
        level = lambda i: F.get(a, i)["level"]
        places = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (level(i) != level(i - 1)))
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(level(i).alias("level"), F.array_join(F.transform(F.slice(a, i + 1, F.coalesce(F.get(s, k + 1), F.size(a)) - i), lambda x: x["line"]), "\n").alias("text"))))[0]

    return F.filter(F.transform(F.array(lines), runs)[0], lambda r: r["level"] > 0)


def link(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """messages, without their text, with body, n_quoted, depth, parent and root, one row per input row.

    body is the text without quotations and the lines that announce them. Quoted passages, their paragraphs, lines
    and longer sentences are hashed, normalised, and joined to what messages of the same thread say themselves; of
    equal sayings the earliest message is the original. A message answers the earlier message that the most of its
    quoted characters come from, those of the lowest quote level that any message is found for; ties go to the
    later message. A message that quotes nothing known has no parent and begins a conversation of its own: root is
    the turn that began it, depth how many answers led here. Since answers come after what they answer, ordering a
    conversation by turn is the order of replies.

    Null and empty texts are empty messages, whole texts count, however long; null threads or turns are linked with
    nothing; repeated rows of one thread and turn are one message to which each row belongs, with the links of all.
    Columns of messages with the names above are replaced, others kept whatever their names. An empty table gives
    an empty result.
    """
    new = ("body", "n_quoted", "depth", "parent", "root")
    own = [c for c in messages.columns if c != text and c.lower() not in new]
    rows = messages.select(*(F.col(c).alias(f"in_{i}") for i, c in enumerate(own)), F.col(thread).cast("string").alias("thread"), F.col(turn).cast("long").alias("turn"), parsed(F.col(text).cast("string")).alias("lines"))
    rows = rows.select(*(f"in_{i}" for i in range(len(own))), "thread", "turn", body(F.col("lines")).alias("body"), F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("n_quoted"), passages(F.col("lines")).alias("quoted"))
    rows = written(rows, "messages")
    known = rows.where("thread is not null and turn is not null")
    quotes = (
        known.where(F.size("quoted") > 0).select("thread", "turn", F.explode("quoted").alias("q")).select("thread", "turn", F.col("q.level").alias("level"), F.explode(_units(F.col("q.text"))).alias("unit"))
        .select("thread", "turn", "level", F.sha2("unit", 256).alias("sha"), F.length("unit").alias("size"))
    )
    quotes = written(quotes, "quotes")
    threads = quotes.select("thread").distinct()
    said = known.join(threads, "thread", "left_semi").select("thread", "turn", F.explode(_units(F.col("body"))).alias("unit")).groupBy("thread", F.sha2("unit", 256).alias("sha")).agg(F.min("turn").alias("first"))
    found = quotes.join(said, ["thread", "sha"]).where("first < turn").groupBy("thread", "turn", "level", "first").agg(F.sum("size").alias("size"))
    parents = found.groupBy("thread", "turn").agg(F.max_by("first", F.struct((-F.col("level")).alias("l"), "size", "first")).alias("parent"))
    at = rows.join(_roots(written(parents, "parents")), ["thread", "turn"], "left")
    return at.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(own)), "body", "n_quoted", F.coalesce("depth", F.lit(0)).alias("depth"), "parent", F.coalesce("root", "turn").alias("root"))


def _roots(parents: DataFrame) -> DataFrame:
    """(thread, turn, parent, depth, root) of each message that has a parent; each round looks twice as far up."""
    now = parents.select("thread", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth"), F.lit(True).alias("open"))
    while now.where("open").limit(1).count():
        above = now.select("thread", F.col("turn").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"), F.col("open").alias("still"))
        stepped = now.where("open").join(above, ["thread", "root"], "left").select(
            "thread", "turn", "parent", F.coalesce("far", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("still", F.lit(False)).alias("open")
        )
        now = written(stepped.unionByName(now.where("not open")), "roots")
    return now.drop("open")


def conversations(messages: DataFrame, thread: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(thread, root, messages): a row for each conversation with its messages, (turn, role, depth, text) without quotations, in the order of replies.

    Messages without a thread or a turn are left out, and those that say nothing besides what they quote; equal
    repeated rows are one message. A conversation is one row, as large as what its answers hold together.
    """
    linked = link(messages.select(F.col(thread).alias("thread"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text")), "thread", "turn", "text")
    said = linked.where("thread is not null and turn is not null and body <> ''").select("thread", "root", F.struct("turn", "role", "depth", F.col("body").alias("text")).alias("m"))
    return said.groupBy("thread", "root").agg(F.array_sort(F.collect_set("m")).alias("messages"))


def query(spark, sf_dir: str) -> DataFrame:
    linked = link(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return linked.select("conv_id", "turn", "role", "body", F.col("n_quoted").cast("long").alias("n_quoted"), "depth", "parent", "root")
