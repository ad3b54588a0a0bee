"""Chat formatting (op 3): quotation linking, in DataFrame operations only.

Lines that begin with ``>`` marks are quotes; the number of marks is their level. Neighbouring lines
of one level are a run. The passages of a message are its lines and, as quotes are wrapped anew and
taken out of longer lines, the sentences of its runs; all are normalised (white space to one space,
trimmed, ASCII lower case) and hashed. The original of a quoted passage is the earliest turn of the
conversation that has it as a passage of its own. One row per (conversation, passage) is left before
the join, so a passage that half a conversation repeats joins once for each message that quotes it.

A message replies to the turn that holds most of its level-1 passages, the later one on a tie;
deeper quotes only count as found. Reply order is the preorder of a thread's tree, siblings by turn:
the tour through the tree is a linked list, ranked by pointer doubling, so a message has a number
and not the path to it, and no thread is gathered in one task.

Nulls: a null text has no lines; a null conv_id is a conversation; a message with a null turn is
neither original nor reply, and has no thread. Rows that repeat (conv_id, turn) are returned each,
with one link. An empty table gives no rows; extra columns are ignored, whatever their names. Texts
of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, written

MARKS = r"^(?:[ \t]*>)+"
#: What lies between two sentences.
SENTENCE_GAP = r"(?<=[.!?…。！？])[ ]+"
#: Separate runs, and a run's level from its text; normalised lines hold no such characters.
RUN, LEVEL = "\x02", "\x03"


def normalised(line: Column) -> Column:
    return ascii_lower(F.trim(F.regexp_replace(line, r"[\x00-\x20]+", " ")))


def lines(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role; per line its level, the line as it stands, and its normalised form."""
    c = conversations
    text = F.coalesce(c["text"].cast("string"), F.lit(""))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
    own = F.transform(F.split(text, "\n"), lambda x: F.struct(level(x).cast("long").alias("level"), x.alias("line"), normalised(F.regexp_replace(x, MARKS, "")).alias("norm")))
    return c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), c["role"].cast("string").alias("role"), own.alias("lines"))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage (a digest): each passage of a message once for each level."""
    levels = F.transform("lines", lambda x: x["level"])
    # A line goes on with the run of the line before, or opens one with its level.
    joined = F.array_join(F.transform("lines", lambda x, i: F.when(F.get(F.col("levels"), i - 1) == x["level"], F.concat(F.lit(" "), x["norm"])).otherwise(F.concat(F.lit(RUN), x["level"].cast("string"), F.lit(LEVEL), x["norm"]))), "")
    runs = F.slice(F.split(joined, RUN), 2, 1 << 30)
    sentences = F.flatten(F.transform(runs, lambda r: F.transform(F.split(normalised(F.substring_index(r, LEVEL, -1)), SENTENCE_GAP), lambda s: F.struct(F.substring_index(r, LEVEL, 1).cast("long").alias("level"), F.trim(s).alias("norm")))))
    whole = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), x["norm"].alias("norm")))
    m = messages.where("turn is not null").withColumn("levels", levels)
    flat = m.select("conv_id", "turn", F.explode(F.concat(whole, sentences)).alias("p")).where("p.norm <> ''")
    return flat.select("conv_id", "turn", F.col("p.level").alias("level"), F.sha2("p.norm", 256).alias("passage"))


def links(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, reply_to) and, for every quoting turn, (conv_id, turn, n_found)."""
    flat = passages(messages)
    quoted, _ = written(flat.where("level > 0").distinct(), "op3-quotes")
    # Only passages that somebody quotes need an original; without quotes nothing is shuffled but an empty side.
    wanted = quoted.select("conv_id", "passage").distinct()
    own = flat.where("level = 0").select("conv_id", "passage", "turn")
    own = own.join(wanted, own["conv_id"].eqNullSafe(wanted["conv_id"]) & (own["passage"] == wanted["passage"]), "left_semi")
    original = own.groupBy("conv_id", "passage").agg(F.min("turn").alias("origin"))
    found = quoted.join(original, quoted["conv_id"].eqNullSafe(original["conv_id"]) & (quoted["passage"] == original["passage"])).where("origin < turn").select(quoted["conv_id"], "turn", "level", "origin")
    found, _ = written(found, "op3-found")
    votes = found.where("level = 1").groupBy("conv_id", "turn", "origin").agg(F.count(F.lit(1)).alias("n"))
    parent = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "origin"))["origin"].alias("reply_to"))
    return parent, found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_found"))


def with_next_sibling(parent: DataFrame) -> DataFrame:
    """``parent`` with the next reply to the same message.

    Replies are dealt by ranges, so a message that half a conversation answers is spread over tasks;
    only the first row of each task is brought together with those of the others.
    """
    order = ["conv_id", "reply_to", "turn"]
    placed, _ = written(parent.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("p", F.spark_partition_id()), "op3-replies")
    here = F.struct("conv_id", "reply_to", "turn")
    after = F.lead(here).over(W.partitionBy("p").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    first = placed.groupBy("p").agg(F.min(here).alias("first"))
    following = first.select("p", F.lead("first").over(W.orderBy("p")).alias("beyond"))
    out = placed.withColumn("after", after).join(following, "p").withColumn("after", F.coalesce("after", "beyond"))
    same = F.col("after.conv_id").eqNullSafe(F.col("conv_id")) & (F.col("after.reply_to") == F.col("reply_to"))
    return out.select(*order, F.when(same, F.col("after.turn")).alias("sibling"))


def joined_on(a: DataFrame, b: DataFrame, left: list[str], how: str = "left") -> DataFrame:
    """``a`` with the columns of ``b`` (whose key is conv and the rest of the first columns), null conversations matching."""
    on = a["conv_id"].eqNullSafe(b[b.columns[0]])
    for x, y in zip(left, b.columns[1:], strict=False):
        on = on & (a[x] == b[y])
    return a.join(b, on, how)


def preorder(parent: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, position) of every message that replies or is replied to.

    The tour enters a message, goes through its replies, and leaves it. Each of these steps points
    to the next; pointers double until all reach the end, which takes a logarithmic number of rounds.
    """
    replies, _ = written(with_next_sibling(parent), "op3-siblings")
    heads = replies.select("conv_id", F.col("reply_to").alias("turn")).distinct()
    own = replies.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    roots = joined_on(heads, own, ["turn"], "left_anti").select("conv_id", "turn", F.lit(None).cast("long").alias("reply_to"), F.lit(None).cast("long").alias("sibling"))
    first = replies.groupBy("conv_id", "reply_to").agg(F.min("turn").alias("child")).toDF("c", "r", "child")
    nodes, _ = written(joined_on(replies.select("conv_id", "turn", "reply_to", "sibling").union(roots), first, ["turn"]).select("conv_id", "turn", "reply_to", "sibling", "child"), "op3-nodes")
    enter = nodes.select("conv_id", F.lit(True).alias("enters"), "turn", F.col("child").isNotNull().alias("to_enters"), F.coalesce("child", "turn").alias("to"), F.lit(1).cast("long").alias("ahead"), F.lit(None).cast("long").alias("thread"))
    leave = nodes.select("conv_id", F.lit(False).alias("enters"), "turn", F.col("sibling").isNotNull().alias("to_enters"), F.coalesce("sibling", "reply_to").alias("to"), F.lit(0).cast("long").alias("ahead"), F.when(F.col("reply_to").isNull(), F.col("turn")).alias("thread"))
    steps, _ = written(enter.union(leave), "op3-steps")
    while steps.where("to is not null").limit(1).count():
        nxt = steps.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("enters").alias("e"), F.col("to_enters").alias("e2"), F.col("to").alias("to2"), F.col("ahead").alias("ahead2"), F.col("thread").alias("thread2"))
        went = joined_on(steps, nxt, ["to", "to_enters"])
        steps, _ = written(went.select("conv_id", "enters", "turn", F.col("e2").alias("to_enters"), F.col("to2").alias("to"), (F.col("ahead") + F.coalesce("ahead2", F.lit(0))).alias("ahead"), F.coalesce("thread", "thread2").alias("thread")), "op3-steps")
    entered = steps.where("enters").select("conv_id", "turn", "thread", "ahead")
    length = entered.where("turn = thread").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("ahead").alias("length"))
    placed = joined_on(entered, length, ["thread"], "inner").select("conv_id", "turn", "thread", (F.col("length") - F.col("ahead")).alias("position"))
    back = nodes.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "reply_to")
    return joined_on(placed, back, ["turn"], "inner").select("conv_id", "turn", "reply_to", "thread", "position")


def threaded(conversations: DataFrame) -> DataFrame:
    """Every message without its quotes, with what it replies to, its thread (the first turn of it) and its place in reply order there."""
    messages = lines(conversations)
    parent, found = links(messages)
    placed = preorder(parent)
    body = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    n_quoted = F.size(F.filter("lines", lambda x: (x["level"] > 0) & (x["norm"] != ""))).cast("long")
    depth = F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("long")
    m = messages.select("conv_id", "turn", "role", F.trim(body).alias("body"), n_quoted.alias("n_quoted"), depth.alias("quote_depth"))
    same = lambda x: m["conv_id"].eqNullSafe(x["conv_id"]) & (m["turn"] == x["turn"])
    out = m.join(placed, same(placed), "left").join(found, same(found), "left")
    position = F.when(m["turn"].isNotNull(), F.coalesce("position", F.lit(0).cast("long")))
    return out.select(m["conv_id"], m["turn"], "role", "body", "n_quoted", "quote_depth", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"), "reply_to", F.coalesce("thread", m["turn"]).alias("thread"), position.alias("position"))


def conversation_text(conversations: DataFrame, template: str = "<|{role}|>\n{body}\n") -> DataFrame:
    """One formatted turn per message, sorted by conversation and reply order; no conversation is gathered in one row."""
    before, _, rest = template.partition("{role}")
    between, _, after = rest.partition("{body}")
    out = threaded(conversations)
    return out.select("conv_id", "turn", "thread", "position", F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(between), "body", F.lit(after)).alias("formatted")).orderBy("conv_id", "thread", "position")
