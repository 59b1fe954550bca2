"""Chat formatting by quotation linking.

Quoted passages (lines that start with one or more ">") are parsed by level, normalised and hashed, and joined to the message
of the conversation that first said the same in its own words. The links order the conversation by replies; the quotes go.

A message's place in the order is its rank in a walk through the tree of replies, parents before children and siblings by turn.
The walk enters and leaves every message; ranks along it come from doubling steps, so that no task holds a thread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

# The mark that closes a turn, and the roles that are kept.
CLOSE = "\n<|end|>"
ROLES = ("assistant", "system", "tool", "user")

_QUOTE = re.compile(r"(?:[ \t]{0,3}>)+[ \t]?")
_WROTE = re.compile(r"[^\n]*\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*", re.I)


def quote_level(line: str) -> tuple[int, str]:
    m = _QUOTE.match(line)
    return (m[0].count(">"), line[m.end() :]) if m else (0, line)


def passage_hash(text: str) -> int | None:
    """A hash of a passage's words, without case, marks at the ends and blanks; None for one without words."""
    words = [w for w in (x.strip(".,;:!?\"'()[]*_-").casefold() for x in text.split()) if w]
    return int.from_bytes(blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True) if words else None


def passages(lines: list[tuple[int, str]]) -> Iterator[tuple[int, str]]:
    """(level, text): runs of lines of one level, parted by blank lines; and the single lines of longer runs."""
    run: list[str] = []
    last = None
    for level, line in [*lines, (-1, "")]:
        if run and (level != last or not line.strip()):
            yield last, " ".join(run)
            if len(run) > 1:
                for x in run:
                    yield last, x
            run = []
        if line.strip():
            run.append(line)
        last = level


def parse_message(text: str) -> tuple[str, list[tuple[int, int, int]], list[int]]:
    """(own text, quoted passages as (level, hash, words), hashes of own passages). A line that announces a quote goes with it."""
    lines = [quote_level(x) for x in text.split("\n")]
    own = [(lv, x) for k, (lv, x) in enumerate(lines) if lv == 0 and not (k + 1 < len(lines) and lines[k + 1][0] and _WROTE.fullmatch(x))]
    quotes = {(lv, h): len(x.split()) for lv, x in passages([p if p[0] else (0, p[1]) for p in lines]) if lv > 0 and (h := passage_hash(x)) is not None}
    said = {h for _, x in passages(own) if (h := passage_hash(x)) is not None}
    content = re.sub(r"\n{3,}", "\n\n", "\n".join(x for _, x in own)).strip() if len(own) < len(lines) else text
    return content, [(lv, h, n) for (lv, h), n in sorted(quotes.items())], sorted(said)


PARSED = "conv_id long, turn long, role string, content string, quotes array<struct<level:int,h:long,words:int>>, said array<long>"


def parse(conversations: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = [parse_message(t or "") for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([g[0] for g in got], pa.string()), pa.array([[{"level": a, "h": b, "words": c} for a, b, c in g[1]] for g in got], kind), pa.array([g[2] for g in got], pa.list_(pa.int64()))],
                    names=["conv_id", "turn", "role", "content", "quotes", "said"],
                )

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PARSED)


def next_of(work: Workspace, rows: DataFrame, group: list[str], by: str) -> DataFrame:
    """rows (group and by, all long, each once) with next: the by of the row that follows in its group, or null. Rows are dealt by
    ranges, so a large group is no single task; only the first row of each range meets the others in one place."""
    order = [*group, by]
    rows = rows.select(*order)
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names, k = [*order, "next", "head"], len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, None
        kind = pa.schema([*[(c, pa.int64()) for c in names[:-1]], ("head", pa.list_(pa.int64()))])
        for batch in batches:
            got = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            if not got:
                continue
            head = head or got[0]
            out = [(*a, b[k] if a[:k] == b[:k] else None, None) for a, b in zip([held, *got] if held else got, got if held else got[1:], strict=False)]
            held = got[-1]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kind.types)], schema=kind)
        if held:  # its next one stands in another range
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*held, None, head), kind.types, strict=True)], schema=kind)

    done = work.save(dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", head array<long>"), "nexts")
    ends = done.where("head is not null")
    after = ends.withColumn("_after", F.lead("head").over(Window.orderBy("head")))  # one row a range
    same = F.lit(True)
    for c in range(k):
        same = same & (F.col("_after")[c] == F.col(group[c]))
    ends = after.select(*order, F.when(same, F.col("_after")[k]).alias("next"))
    return done.where("head is null").select(*order, "next").unionByName(ends)


def reply_order(work: Workspace, best: DataFrame) -> DataFrame:
    """best (conv_id, turn, reply_to, earlier turns) to (conv_id, turn, thread, depth, place) for every message in it and those
    replied to: place counts from 0 within the thread."""
    edges = best.select("conv_id", "turn", F.col("reply_to").alias("up"))
    kids = next_of(work, edges, ["conv_id", "up"], "turn")
    first = edges.groupBy("conv_id", F.col("up").alias("turn")).agg(F.min("turn").alias("kid"))
    nodes = edges.select("conv_id", "turn", "up").unionByName(first.join(edges, ["conv_id", "turn"], "left_anti").select("conv_id", "turn", F.lit(None).cast("long").alias("up")))
    nodes = nodes.join(first, ["conv_id", "turn"], "left").join(kids.select("conv_id", "turn", F.col("next").alias("sibling")), ["conv_id", "turn"], "left")
    # A step of the walk is a turn, entered or left; it leads to the next one. up and deep: the end of the way so far, and what was
    # met on it: messages entered, and levels gone down less those gone up.
    nodes = work.save(nodes, "nodes")
    step = lambda turn, leave: F.struct(turn.alias("turn"), F.lit(leave).alias("leave"))
    none = F.lit(None).cast("struct<turn:bigint,leave:boolean>")
    turn, kid, sibling, up = (F.col(c) for c in ("turn", "kid", "sibling", "up"))
    enter = nodes.select("conv_id", step(turn, False).alias("at"), F.when(kid.isNotNull(), step(kid, False)).otherwise(step(turn, True)).alias("to"), F.lit(1).cast("long").alias("met"))
    leave = nodes.select("conv_id", step(turn, True).alias("at"), F.when(sibling.isNotNull(), step(sibling, False)).when(up.isNotNull(), step(up, True)).otherwise(none).alias("to"), F.lit(0).cast("long").alias("met"))
    walk = work.save(enter.unionByName(leave), "walk")
    chain = work.save(nodes.select("conv_id", "turn", F.coalesce("up", "turn").alias("up"), F.when(up.isNotNull(), 1).otherwise(0).alias("depth")), "chain")

    def doubled(walk: DataFrame) -> DataFrame:  # met counts the messages from here on
        on = walk.select("conv_id", F.col("at").alias("to"), F.col("to").alias("far"), F.col("met").alias("more"))
        return walk.join(on, ["conv_id", "to"], "left").select("conv_id", "at", F.col("far").alias("to"), (F.col("met") + F.coalesce("more", F.lit(0))).alias("met"))

    def climbed(chain: DataFrame) -> DataFrame:
        on = chain.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        return chain.join(on, ["conv_id", "up"]).select("conv_id", "turn", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))

    while walk.where("to is not null").limit(1).count():  # each round doubles the length of the steps
        new = work.save(doubled(walk), "walk"), work.save(climbed(chain), "chain")
        work.drop(walk, chain)
        walk, chain = new
    left = walk.where("not at.leave").select("conv_id", F.col("at.turn").alias("turn"), F.col("met").alias("left"))
    ranked = chain.join(left, ["conv_id", "turn"])
    whole = ranked.where("turn = up").select("conv_id", "up", F.col("left").alias("whole"))
    return ranked.join(whole, ["conv_id", "up"]).select("conv_id", "turn", F.col("up").alias("thread"), "depth", (F.col("whole") - F.col("left")).alias("place"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, reply_to, thread, depth, place, n_quotes, n_linked, content, chat.

    reply_to is the earlier turn that said the most words of the outermost linked quotes (ties: the latest); thread is the turn at
    the start of the chain of replies, depth the number of links to it, and place the rank in reply order within the thread:
    a message, then each reply to it by turn with all that answers it. A conversation in reply order is its rows by thread, then
    place; no row holds a whole conversation, however long it is. Messages without a linked quote start a thread, so a
    conversation without quotes keeps the order of turns. A passage that several messages said belongs to the earliest.
    Null ids or turns are never linked; null texts are empty; unknown and null roles are formatted as user. Messages that share
    a turn are one place in the order and share its links. Other columns aren't looked at; an empty table gives no rows.
    """
    work = Workspace(conversations.sparkSession, "chat")
    rows = work.save(parse(conversations), "parsed")
    said = rows.where("turn is not null").select("conv_id", "turn", F.explode("said").alias("h")).groupBy("conv_id", "h").agg(F.min("turn").alias("first"))
    quoted = rows.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").groupBy("conv_id", "turn", "h").agg(F.min("level").alias("level"), F.max("words").alias("words"))
    linked = work.save(quoted.join(said, ["conv_id", "h"]).where("first < turn"), "linked", narrow=True)
    best = linked.groupBy("conv_id", "turn", "level", "first").agg(F.sum("words").alias("w"))
    best = best.groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("w"), -F.col("first"), "first")).alias("b")).select("conv_id", "turn", F.col("b.first").alias("reply_to"))
    best = work.save(best, "best", narrow=True)
    counts = linked.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
    order = reply_order(work, best)
    links = work.save(order.join(best, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left"), "links", narrow=True)
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(F.lit("user"))
    out = rows.join(links, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("place", F.lit(0)).cast("long").alias("place"),
        F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "content",
        F.concat(F.lit("<|"), role, F.lit("|>\n"), "content", F.lit(CLOSE)).alias("chat"),
    )
