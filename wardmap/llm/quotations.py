"""Chat formatting by quotation linking.

Messages quote earlier ones with ``>`` before their lines, several times for quotes of quotes. Quote levels are
parsed into passages; passages, their lines and their sentences are normalised and hashed, and joined to the messages
of the same conversation that said them before. A passage that shares none of them with a message is looked for by its
windows of a few words, so that a part of a line, or one wrapped anew, is found too. A message answers the message that
its first-level quotes come from, or the one before it if it quotes nothing that is found.

Conversations are returned without quotes, in reply order: every message is followed by its answers, each with all that
follows from it, in order of turns. The places come from the tour around the tree of answers, whose steps are ranked by
pointer jumping, so a conversation of any length and depth takes a number of joins that grows with its logarithm.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardmap.llm.keys import type_of
from wardmap.llm.mixing import running
from wardmap.session import stored

QUOTED = r"(?m)^[ \t]*>"
MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
# How mail programs introduce a quote in four languages.
INTRODUCTION = re.compile(
    r"(?i)^\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|a écrit|escribió)\b.*:\s*$|^\s*-+ ?(?:original message|"
    r"ursprüngliche nachricht|message d'origine|mensaje original) ?-+\s*$")
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?…。！？])[\s\"'”’»)]+")
#: Words of a window: the first for quotes that have so many, else the second. Shorter ones are found as lines or sentences.
WINDOWS = (8, 4)


def quote_level(line: str) -> tuple[int, str]:
    """Number of marks before a line, and the line without them."""
    found = MARKS.match(line)
    return (found[1].count(">"), line[found.end():]) if found else (0, line)


def passages(text: str) -> list[tuple[int, str]]:
    """(level, text) of runs of lines of one level; level 0 is the message's own text.

    Blank lines do not end a passage. A line that introduces a quote, right before a deeper level, is left out.
    """
    lines = [quote_level(line) for line in text.split("\n")]
    runs: list[tuple[int, list[str]]] = []
    for level, line in lines:
        if runs and (runs[-1][0] == level or not line.strip() and not level):
            runs[-1][1].append(line)
        else:
            runs.append((level, [line]))
    out = []
    for i, (level, run) in enumerate(runs):
        while run and not run[-1].strip():
            run.pop()
        if run and i + 1 < len(runs) and runs[i + 1][0] > level and INTRODUCTION.match(run[-1]):
            run.pop()
        joined = "\n".join(run).strip("\n")
        if joined.strip():
            out.append((level, joined))
    return out


def normalised(text: str) -> str:
    """Lower-case words, whatever stands between them."""
    return " ".join(WORD.findall(text.lower()))


def units(text: str) -> dict[str, int]:
    """What a passage is found by: the whole of it, its lines and its sentences, with their number of words."""
    out = {}
    for part in [text, *text.split("\n"), *SENTENCE_END.split(text)]:
        plain = normalised(part)
        if plain:
            out[plain] = plain.count(" ") + 1
    return out


def parsed(messages: DataFrame) -> DataFrame:
    """Add ``own``, the text without quotes, and ``units``: level, number of the passage, unit and words."""

    kind = "array<struct<level: int, passage: int, unit: string, words: int>>"
    fields = pa.struct([("level", pa.int32()), ("passage", pa.int32()), ("unit", pa.string()), ("words", pa.int32())])

    def run(batches):
        for batch in batches:
            own, found = [], []
            for text in batch.column("text").to_pylist():
                parts = passages(text or "")
                mine = [p for level, p in parts if not level]
                own.append("\n".join(mine))
                if len(mine) > 1:
                    parts = [*parts, (0, "\n".join(mine))]
                found.append([{"level": level, "passage": i, "unit": u, "words": n}
                              for i, (level, p) in enumerate(parts) for u, n in units(p).items()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.string()), pa.array(found, pa.list_(fields))],
                [*batch.schema.names, "own", "units"])

    kinds = f"conv {type_of(messages, 'conv')}, turn {type_of(messages, 'turn')}"
    return messages.select("conv", "turn", "row", "text").mapInArrow(
        run, f"{kinds}, row bigint, text string, own string, units {kind}")


def window_rows(messages: DataFrame) -> DataFrame:
    """(conv, turn, row, level, passage, words, hash, check) of each window of quotes and own text."""
    names = ["conv", "turn", "row", "level", "passage", "words", "hash", "check"]
    kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 2]

    def rows_of(conv, turn, row, text):
        parts = list(enumerate(passages(text)))
        own = "\n".join(p for _, (level, p) in parts if not level)
        for i, level, part in [(0, 0, own), *((i, level, p) for i, (level, p) in parts if level)]:
            words = WORD.findall(part.lower())
            for n in WINDOWS if not level else [n for n in WINDOWS if n <= len(words)][:1]:
                for at in range(len(words) - n + 1):
                    digest = hashlib.blake2b(" ".join(words[at:at + n]).encode(), digest_size=16).digest()
                    yield conv, turn, row, level, i, 1, *struct.unpack("<qq", digest)

    def run(batches):
        for batch in batches:
            schema = pa.schema(list(zip(names, [batch.schema.field(0).type, batch.schema.field(1).type, *kinds], strict=True)))
            every = chain.from_iterable(rows_of(c.as_py(), t.as_py(), r.as_py(), x.as_py() or "")
                                        for c, t, r, x in zip(*batch.columns, strict=True))
            while some := list(islice(every, 10_000)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    given = f"conv {type_of(messages, 'conv')}, turn {type_of(messages, 'turn')}"
    return messages.select("conv", "turn", "row", "text").mapInArrow(
        run, f"{given}, row bigint, level int, passage int, words int, hash bigint, check bigint")


def linked(messages: DataFrame) -> DataFrame:
    """(conv, turn, row, level, passage, source): quoted passages and the latest earlier turn that said them.

    ``messages`` has conv, turn, row and units. Quotes and own text with the same hash in one conversation are put
    in order of turns, and each quote takes the last own text before it; no pairs are made. Of a passage's units the
    turn with most words in common wins, and then the latest. Where a passage of a conversation finds nothing, the
    windows of its quotes are looked for in the same way; the turn with most of them counts if it has half of the
    passage's. ``source`` is null if nothing is found.
    """
    rows = messages.select("conv", "turn", "row", F.explode("units").alias("u")).select(
        "conv", "turn", "row", "u.level", "u.passage", "u.words", F.xxhash64("u.unit").alias("hash"),
        F.xxhash64(F.reverse("u.unit")).alias("check"))
    exact = stored(voted(rows).drop("share"), "unit-links")
    left = stored(exact.where("source is null").select("conv").distinct(), "unlinked").withColumnRenamed("conv", "__conv")
    again = messages.join(left, messages["conv"].eqNullSafe(F.col("__conv")), "left_semi")
    near = voted(window_rows(again)).where("share >= 0.5").drop("share")
    both = exact.withColumn("exact", F.lit(True)).unionByName(near.withColumn("exact", F.lit(False)))
    best = F.max(F.struct(F.col("source").isNotNull().alias("found"), "exact", "source")).alias("best")
    return both.groupBy("conv", "turn", "row", "level", "passage").agg(best).select(
        "conv", "turn", "row", "level", "passage", F.col("best.source").alias("source"))


def with_last_before(rows: DataFrame) -> DataFrame:
    """Add ``source``: the last earlier turn whose own text has the row's hash, in the conversation.

    Rows are dealt out by ranges of (conversation, hash, turn), so a unit that is said any number of times spreads over
    the tasks; what a range begins with comes from one row for each earlier range of the unit.
    """
    unit = ["conv", "hash", "check"]
    # Quotes come before own text of the same turn, so that they never find their own message.
    order = [F.col("turn").asc_nulls_first(), F.col("level").desc()]
    ranges = stored(rows.repartitionByRange(*unit, *order).withColumn("part", F.spark_partition_id()), "units")
    own = F.when(F.col("level") == 0, F.col("turn"))
    before = Window.partitionBy(*unit, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranges.withColumn("source", F.last(own, ignorenulls=True).over(before))
    earlier = Window.partitionBy(*unit).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each unit and range; only units of several ranges carry something over.
    ends = ranges.groupBy(*unit, "part").agg(F.max(own).alias("end")).withColumn("carried", F.max("end").over(earlier))
    ends = stored(ends.where("carried is not null").select(
        F.struct(*unit).alias("of"), F.col("part").alias("at"), "carried"), "carried")
    same = (F.struct(*unit) == F.col("of")) & (F.col("part") == F.col("at"))
    return inside.join(ends, same, "left").withColumn("source", F.coalesce("source", "carried")).drop("of", "at", "carried")


def voted(rows: DataFrame) -> DataFrame:
    """(conv, turn, row, level, passage, source, share): the turn with most words of a passage's units, and their share."""
    said = rows.where("level = 0").groupBy("conv", "hash", "check", "turn").agg(F.lit(0).alias("level")).select(
        "conv", "hash", "check", "turn", F.lit(None).cast("long").alias("row"), "level",
        F.lit(None).cast("int").alias("passage"), F.lit(None).cast("int").alias("words"))
    found = with_last_before(said.unionByName(rows.where("level > 0").select(said.columns)))
    votes = found.where("level > 0").groupBy("conv", "turn", "row", "level", "passage", "source").agg(
        F.sum("words").alias("words"))
    best = F.max(F.struct(F.col("source").isNotNull().alias("found"), "words", "source")).alias("best")
    return votes.groupBy("conv", "turn", "row", "level", "passage").agg(best, F.sum("words").alias("all")).select(
        "conv", "turn", "row", "level", "passage", F.col("best.source").alias("source"),
        (F.col("best.words") / F.col("all")).alias("share"))


def reply_places(rows: DataFrame) -> DataFrame:
    """(row, place) in depth-first order of trees; ``rows`` has key, row, rank (from 1) and parent, an earlier rank.

    Every row goes into the tour around its tree twice: down to it and up from it again. What follows a step is told by
    a row's first answer, its next sibling and its parent; the steps' distances from the end are summed up by doubling.
    """
    siblings = stored(running(rows.select("key", "row", "rank", "parent"), ["key", "parent"], [F.col("rank").asc()], {},
                              "siblings").withColumnRenamed("__rank", "sibling"), "siblings")
    look = lambda name, *columns: siblings.select(*columns, F.col("row").alias(name))
    first = look("child", F.col("key").alias("k"), F.col("parent").alias("p")).join(
        siblings.where("sibling = 1").select("row"), F.col("child") == F.col("row"), "left_semi")
    following = look("next", F.col("key").alias("k2"), F.col("parent").alias("p2"), (F.col("sibling") - 1).alias("s2"))
    above = look("above", F.col("key").alias("k3"), F.col("rank").alias("r3"))
    steps = siblings.join(first, (F.col("key") == F.col("k")) & (F.col("rank") == F.col("p")), "left").join(
        following, (F.col("key") == F.col("k2")) & (F.col("parent") == F.col("p2")) & (F.col("sibling") == F.col("s2")), "left"
    ).join(above, (F.col("key") == F.col("k3")) & (F.col("parent") == F.col("r3")), "left")
    # Steps down to a row have its number doubled, steps up from it one more.
    down = F.coalesce(F.col("child") * 2, F.col("row") * 2 + 1)
    up = F.coalesce(F.col("next") * 2, F.col("above") * 2 + 1)
    tour = steps.select(F.inline(F.array(
        F.struct((F.col("row") * 2).alias("step"), down.alias("to"), F.lit(1).cast("long").alias("left")),
        F.struct((F.col("row") * 2 + 1).alias("step"), up.alias("to"), F.lit(0).cast("long").alias("left")))))
    tour = stored(tour, "tour")
    while not tour.where("to is not null").isEmpty():
        ahead = tour.select(F.col("step").alias("s"), F.col("to").alias("further"), F.col("left").alias("more"))
        tour = stored(tour.join(ahead, F.col("to") == F.col("s"), "left").select(
            "step", F.col("further").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "tour")
    # A row's place is the number of rows less those from it to the end.
    ends = tour.where("step % 2 = 0").select(F.shiftright("step", 1).alias("row"), "left")
    sizes = rows.groupBy("key").agg(F.max("rank").alias("size"))
    return rows.select("key", "row").join(ends, "row").join(sizes, "key").select(
        "row", (F.col("size") - F.col("left") + 1).alias("place"))


def conversations(
    messages: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per message: conv_id, position, turn, role, text, reply_to, n_quoted and n_linked.

    ``text`` is the message without quotes; it is empty if there is nothing else, and null texts are empty.
    ``reply_to`` is the turn that the message answers, null for the first: the turn that its first-level quotes come from,
    or else that of the message before it. ``position`` counts the messages of a conversation from 1 in reply order: a
    message, then its answers by turn, each followed by all that answers it in turn. Rows with one turn count
    as several messages said at once, in order of role and a hash of the text; an answer to their turn answers the first
    of them. Null conversations and turns form a conversation and a first turn of their own. ``n_quoted`` and ``n_linked``
    count quoted passages and those whose source is found. Conversations without a quote skip the join; a conversation
    of any length is spread over all tasks. Texts are numbered and written once and joined to the result. Ids and turns
    may be of any type that has an order.
    """
    rows = messages.select(
        messages[id_column].alias("conv"), messages[turn_column].alias("turn"),
        messages[role_column].cast("string").alias("role"),
        F.coalesce(messages[text_column].cast("string"), F.lit("")).alias("text"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "messages")
    quoting = rows.where(F.col("text").rlike(QUOTED)).select("conv").distinct()
    quoting = stored(quoting, "quoting").withColumnRenamed("conv", "__conv")
    theirs = rows.join(quoting, rows["conv"].eqNullSafe(F.col("__conv")), "left_semi")
    theirs = stored(parsed(theirs), "passages")
    links = stored(linked(theirs), "quotations")
    answers = links.groupBy("row").agg(
        F.count("*").alias("n_quoted"), F.count("source").alias("n_linked"),
        F.max(F.when(F.col("level") == 1, F.struct(F.col("source").isNotNull().alias("found"), "source")))["source"]
        .alias("answers"))
    narrow = rows.select(F.struct("conv").alias("key"), "conv", "turn", "role", "row", F.xxhash64("text").alias("said"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("said").asc()]
    numbered = stored(running(narrow, ["key"], order, {}, "order"), "order").withColumnRenamed("__rank", "rank")
    told = numbered.join(stored(answers, "answers"), "row", "left")
    # The turn before is that of the message one place earlier; a turn that is answered, its first message.
    earlier = numbered.select(F.col("key").alias("k"), (F.col("rank") + 1).alias("r"), F.col("turn").alias("before"))
    firsts = numbered.groupBy("key", "turn").agg(F.min("rank").alias("at")).withColumnsRenamed({"key": "k2", "turn": "t2"})
    told = told.join(earlier, (F.col("key") == F.col("k")) & (F.col("rank") == F.col("r")), "left").join(
        firsts, (F.col("key") == F.col("k2")) & (F.col("answers") == F.col("t2")), "left")
    parent = F.coalesce("at", F.nullif(F.col("rank") - 1, F.lit(0)))
    told = stored(told.select("key", "conv", "turn", "role", "row", "rank", parent.cast("long").alias("parent"),
                              F.coalesce("answers", "before").alias("reply_to"), "n_quoted", "n_linked"), "answers")
    # Where every message answers the one before, the order is that of turns.
    branched = stored(told.where("parent < rank - 1").select("key").distinct(), "branched")
    places = reply_places(stored(told.join(branched, "key", "left_semi"), "trees"))
    texts = rows.select("row", "text").join(theirs.select("row", "own"), "row", "left").select(
        "row", F.coalesce("own", "text").alias("text"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return told.join(stored(places, "places"), "row", "left").join(texts, "row").select(
        F.col("conv").alias("conv_id"), F.coalesce("place", "rank").cast("long").alias("position"), "turn", "role",
        "text", "reply_to", count("n_quoted"), count("n_linked"))
