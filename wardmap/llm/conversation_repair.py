r"""Repair of conversation structure: rank-convergence parallel Viterbi over the messages of each conversation.

Messages are dealt out by ranges of (conversation, turn, role, text) and cut into chunks of ``CHUNK`` rows, so a
conversation of any length spreads over all tasks. Every chunk computes its costs to the end of the conversation from a
speculative vector, that of a conversation which ends there. Fix-up passes hand each chunk the vector its successor
found; a chunk runs again only if that differs from the one it used by more than a constant, and only until its vectors
differ from the earlier ones by a constant. The stitched costs drive the trace of the cheapest, ASCII-least edits; the
state in which a chunk is entered comes from doubling compositions of the maps from entry to exit states.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from wardmap.llm.arrays import small_batches
from wardmap.llm.repair_costs import END, LAWFUL, Steps, exits, tail, traced, unlawful
from wardmap.session import stored

#: Rows of a chunk, as a power of two.
CHUNK_BITS = 10
#: White space, and the signs that end a message.
WORD_CHARACTER, LAST_SIGN = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Characters of a text that order rows of one turn and role before its MD5 value does.
TIE = 64

KINDS = {"long": LongType(), "longs": ArrayType(LongType()), "texts": ArrayType(StringType())}


def damaged(
    messages: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """Messages with planted faults: conv_id, turn, role and text of the rows that are left.

    By ``crc32("conv_id:turn") % 20`` a row is dropped (0), loses its text (1) or its signs ``.!?`` (2), stands twice
    (3) or gets the role user (4). Null roles and texts, and null ids and turns in the checksum, are one space.
    """
    blank = lambda c: F.coalesce(messages[c].cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(blank(id_column), F.lit(":"), blank(turn_column)).cast("binary")) % 20
    rows = messages.select(
        messages[id_column].alias("conv_id"), messages[turn_column].alias("turn"), blank(role_column).alias("role"),
        blank(text_column).alias("text"), lot.alias("lot")).where("lot <> 0")
    copies = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), copies.alias("copy")).drop("copy")


def ordered(
    messages: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str, bits: int,
) -> DataFrame:
    """The messages with ``pos``, a number that grows along each conversation, and ``chunk``; written.

    The conversation is kept as a struct, ``conv``, in which null is a value like any other.
    """
    space = lambda c: F.coalesce(messages[c].cast("string"), F.lit(" "))
    rows = messages.select(
        F.struct(messages[id_column].alias("id")).alias("conv"), messages[turn_column].alias("turn"),
        space(role_column).alias("role"), space(text_column).alias("text"))
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", "tie", "said", "copy"]
    rows = rows.select(
        "*", F.substring("text", 1, TIE).alias("tie"), F.md5(F.col("text").cast("binary")).alias("said"),
        F.monotonically_increasing_id().alias("copy")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(rows.drop("tie", "copy").withColumn("at", F.monotonically_increasing_id()), "messages")

    # Chunks are numbered without gaps from one range to the next: a row for each range tells where it begins.
    sizes = rows.groupBy(F.shiftright("at", 33).alias("range")).agg(F.max(F.col("at").bitwiseAND((1 << 33) - 1)))
    first, starts = 0, []
    for part, last in sorted(sizes.collect()):
        starts.append((part, first))
        first += (last >> bits) + 1
    starts = rows.sparkSession.createDataFrame(starts, "range long, first long")
    chunk = F.col("first") + F.shiftright(F.col("at").bitwiseAND((1 << 33) - 1), bits)
    numbered = rows.join(starts, F.shiftright("at", 33) == F.col("range"))
    return numbered.select("conv", "turn", "role", "text", "said", F.col("at").alias("pos"), chunk.alias("chunk"))


def coded(rows: DataFrame) -> DataFrame:
    """(conv, chunk, pos, code, blank, duplicate, truncated) of each message; its first fault counts."""
    kind = F.col("role").substr(1, 1)
    kind = F.when(kind == "s", 1).when(kind == "u", 2).when(kind == "a", 3).otherwise(0)
    narrow = rows.select("conv", "chunk", "pos", "role", "said", kind.alias("kind"),
                         (~F.col("text").rlike(WORD_CHARACTER)).alias("blank"),
                         (~F.col("text").rlike(LAST_SIGN)).alias("open"))
    narrow = stored(narrow, "roles")
    # Repeated lines only; a line said any number of times is a skewed key of an equality join.
    said = narrow.where("not blank").groupBy("conv", "role", "said").agg(
        F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    said = stored(said, "repeated").withColumnsRenamed({"conv": "c", "role": "r", "said": "s"})
    same = (F.col("conv") == F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s"))
    marked = narrow.join(said, same, "left").withColumn(
        "duplicate", ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
    marked = marked.withColumn("truncated", F.col("open") & ~F.col("blank") & ~F.col("duplicate"))
    fault = F.when(F.col("blank") | F.col("duplicate"), 2).when(F.col("truncated"), 1).otherwise(0)
    return marked.select("conv", "chunk", "pos", (3 * F.col("kind") + fault).cast("int").alias("code"), "blank",
                         "duplicate", "truncated")


def chunks_of(codes: DataFrame) -> DataFrame:
    """One row per conversation and chunk: first position, codes, fault counts, whether chunks come before and after."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "code")))
    chunks = codes.groupBy("conv", "chunk").agg(
        F.min("pos").alias("pos"), F.transform(listed, lambda x: x["code"]).alias("codes"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    chunks = stored(chunks, "chunks")
    spans = stored(chunks.groupBy("conv").agg(F.min("chunk").alias("from"), F.max("chunk").alias("to")), "spans")
    return stored(chunks.join(spans, "conv"), "chunks")


def in_batches(df: DataFrame, function, added: str) -> DataFrame:
    """Add columns, computed from the values of a row by ``function``, which takes a dict and returns a tuple."""
    fields = [StructField(name, KINDS[kind]) for name, kind in (field.split(":") for field in added.split(","))]
    arrow = to_arrow_schema(StructType(fields))

    def run(batches):
        steps = Steps()
        for batch in batches:
            for some in small_batches(batch):
                rows = some.select([n for n in some.schema.names if n != "conv"]).to_pylist()
                found = [function(steps, row) for row in rows]
                columns = [pa.array([f[i] for f in found], field.type) for i, field in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*some.columns, *columns], [*some.schema.names, *arrow.names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *fields]))


def converged(chunks: DataFrame) -> DataFrame:
    """Add ``end``, the vector after each chunk, ``start``, that before it, and ``cost``, the minima taken off between."""

    def first_pass(steps: Steps, row: dict) -> tuple:
        start, cost = steps.start(row["codes"], END)
        return list(END), list(start), cost

    def again(steps: Steps, row: dict) -> tuple:
        end = tuple(row["wanted"])
        start, cost = steps.mended(row["codes"], tuple(row["end"]), (tuple(row["start"]), row["cost"]), end)
        return list(end), list(start), cost

    added = "end:longs,start:longs,cost:long"
    shape = [*chunks.columns, "end", "start", "cost"]
    costs = stored(in_batches(chunks, first_pass, added), "costs")
    alone = costs.where("from = to")
    joined = stored(costs.where("from < to"), "costs")
    while True:
        after = joined.select(F.col("conv").alias("c"), (F.col("chunk") - 1).alias("k"), F.col("start").alias("wanted"))
        pairs = stored(joined.join(after, (F.col("conv") == F.col("c")) & (F.col("chunk") == F.col("k")), "left")
                       .drop("c", "k"), "costs")
        stale = "wanted is not null and wanted <> end"
        if pairs.where(stale).isEmpty():
            return alone.unionByName(joined)
        renamed = pairs.where(stale).withColumnsRenamed({"end": "e", "start": "s", "cost": "o"})
        mended = in_batches(renamed, lambda steps, row: again(
            steps, {**row, "end": row["e"], "start": row["s"], "cost": row["o"]}), added)
        joined = stored(pairs.where(f"not coalesce({stale}, false)").select(shape).unionByName(mended.select(shape)),
                        "costs")


def entered(costs: DataFrame) -> DataFrame:
    """Add ``entry``, the state in which each chunk is entered."""

    def maps(steps: Steps, row: dict) -> tuple:
        return (exits(steps.decisions(row["codes"], tuple(row["end"]))),)

    alone = costs.where("from = to").withColumn("entry", F.lit(0).cast("long"))
    many = costs.where("from < to")
    if many.isEmpty():
        return alone
    windows = stored(in_batches(many.select("conv", "chunk", "from", "codes", "end"), maps, "map:longs").select(
        "conv", "chunk", "from", "map", F.col("chunk").alias("reach")), "maps")
    settled = (F.col("reach") == F.col("from")) | (F.size(F.array_distinct("map")) == 1)
    while not windows.where(~settled).isEmpty():
        earlier = windows.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), F.col("map").alias("before"),
                                 F.col("reach").alias("further"))
        joined = windows.join(
            earlier, (F.col("conv") == F.col("c")) & (F.col("reach") - 1 == F.col("k")) & ~settled, "left")
        through = F.transform("before", lambda s: F.element_at("map", (s + 1).cast("int")))
        windows = stored(joined.select("conv", "chunk", "from", F.coalesce(through, "map").alias("map"),
                                       F.coalesce("further", "reach").alias("reach")), "maps")
    # From the first chunk on the state is START; a map with one value does not care.
    states = windows.select(F.col("conv").alias("c"), (F.col("chunk") + 1).alias("k"), F.col("map")[0].alias("entry"))
    many = many.join(states, (F.col("conv") == F.col("c")) & (F.col("chunk") == F.col("k")), "left").drop("c", "k")
    return alone.unionByName(many.withColumn("entry", F.coalesce("entry", F.lit(0)).cast("long")))


def repaired_chunks(rows: DataFrame) -> DataFrame:
    """One row per conversation and chunk with the actions at each of its messages, the costs and the faults; written.

    Actions: ``D`` deletes, ``K`` keeps, ``u`` and ``a`` give another role, ``U`` and ``A`` insert.
    """

    def actions(steps: Steps, row: dict) -> tuple:
        found, state = traced(steps.decisions(row["codes"], tuple(row["end"])), row["entry"])
        if row["chunk"] == row["to"]:
            found[-1] += tail(state)
        return found, unlawful(row["codes"])

    chunks = entered(converged(chunks_of(coded(rows))))
    return stored(in_batches(chunks, actions, "actions:texts,illegal:long"), "repairs")


def line(action: Column) -> Column:
    """(role, text) that an action leaves of a message."""
    role = F.when(F.lower(action) == "u", "user").when(F.lower(action) == "a", "assistant").otherwise(F.col("role"))
    return F.struct(role.alias("role"), F.when(action.isin("U", "A"), "").otherwise(F.col("text")).alias("text"))


def with_actions(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """Messages with their actions, a list of one-letter texts."""
    each = repairs.select(F.posexplode("actions").alias("i", "actions"), "pos", (F.col("from") < F.col("to")).alias("long"))
    letters = F.filter(F.split("actions", ""), lambda a: a != "")
    each = each.select((F.col("pos") + F.col("i")).alias("p"), letters.alias("actions"), "long")
    return rows.join(each, F.col("pos") == F.col("p")).drop("p")


def repaired(
    messages: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text", chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """The messages of the repaired conversations: conv_id, place, turn, role, text and edit.

    Rows of a conversation are in order of ``place``, a number that grows along it with gaps; inserted rows have a null
    turn. ``edit`` is ``K`` (kept), ``R`` (other role) or ``I`` (inserted). Every conversation reads ``(s?(ua)+)?`` in
    the initials of its roles, at the least cost; see ``repair_report`` for the rules.
    """
    rows = ordered(messages, id_column, turn_column, role_column, text_column, chunk_bits)
    each = with_actions(rows, repaired_chunks(rows)).select(
        "conv", "turn", "role", "text", "pos", F.posexplode("actions").alias("i", "action")).where("action <> 'D'")
    action, left = F.col("action"), line(F.col("action"))
    return each.select(
        F.col("conv.id").alias("conv_id"), (F.col("pos") * 8 + F.col("i")).alias("place"),
        F.when(~action.isin("U", "A"), F.col("turn")).alias("turn"), left["role"].alias("role"), left["text"].alias("text"),
        F.translate(action, "UAua", "IIRR").alias("edit"))


def text_digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv, digest): SHA-256 of the repaired ``role:text`` lines of each conversation that keeps any.

    A conversation of one chunk is put together and hashed by Spark. SHA-256 has to see a longer one in order, so its
    lines are sorted and pass the hash as a stream, a batch in memory at a time.
    """
    left = F.filter("actions", lambda a: a != "D")
    text = F.array_join(F.transform(left, lambda a: F.concat_ws(":", line(a)["role"], line(a)["text"])), "\n")
    lines = stored(with_actions(rows, repairs).where(F.size(left) > 0).select("conv", "pos", "long", text.alias("line")),
                   "lines")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    short = lines.where("not long").groupBy("conv").agg(
        F.sha2(F.array_join(listed, "\n").cast("binary"), 256).alias("digest"))

    def run(batches):
        conv, state = None, None
        schema = None
        for batch in batches:
            schema = batch.schema
            for one, text in zip(batch.column("conv"), batch.column("line"), strict=True):
                if state is None or one != conv:
                    if state is not None:
                        yield digest_row(conv, state, schema)
                    conv, state = one, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text.as_buffer())
        if state is not None:
            yield digest_row(conv, state, schema)

    def digest_row(conv, state, schema):
        return pa.RecordBatch.from_arrays(
            [pa.array([conv.as_py()], schema.field("conv").type), pa.array([state.hexdigest()])], ["conv", "digest"])

    kind = rows.schema["conv"].dataType.simpleString()
    long = lines.where("long").select("conv", "pos", "line").repartition("conv").sortWithinPartitions("conv", "pos")
    return short.unionByName(long.mapInArrow(run, f"conv {kind}, digest string"))


def repair_report(
    messages: DataFrame, ids: DataFrame | None = None, id_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text", chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """One row per conversation: its faults, the cost and the audit of its cheapest repair, a digest of what is left.

    The rows of a conversation stand in order of turn (null first), role, the first 64 characters and the MD5 value of
    the text. The first fault of a row counts: ``blank``, ``duplicate`` (role and text of an earlier row of the
    conversation), ``truncated`` (no ``.!?`` at its end). Keeping a row costs nothing, another role 2, deleting 3, which
    blank and duplicate rows need, inserting a user or assistant row without text 2; a truncated row that stays costs 1.
    The roles that are left read ``(s?(ua)+)?`` in their initials; an empty role fits nowhere. ``audit`` holds the edits
    in order, ASCII-least among the cheapest. ``gaps`` counts the turns missing between the first and the last,
    ``illegal`` the neighbours that are not ``su``, ``ua`` or ``au``. Null roles and texts are one space, null ids are a
    conversation. ``ids`` (a column of conversations) adds conversations without rows: zeros and empty texts. An empty
    table gives an empty result; other columns are not read.
    """
    rows = ordered(messages, id_column, turn_column, role_column, text_column, chunk_bits)
    repairs = repaired_chunks(rows)
    # Neighbours across chunks; a chunk's code tells the class of the role's initial.
    ahead = repairs.where("chunk > from").select(F.col("conv").alias("c"), (F.col("chunk") - 1).alias("k"),
                                                 F.floor(F.col("codes")[0] / 3).alias("next"))
    pair = 10 * F.floor(F.element_at("codes", -1) / 3) + F.col("next")
    pieces = repairs.join(ahead, (F.col("conv") == F.col("c")) & (F.col("chunk") == F.col("k")), "left")
    pieces = pieces.withColumn("illegal", F.col("illegal") + F.when(
        F.col("next").isNotNull() & ~pair.isin(*[10 * a + b for a, b in LAWFUL]), 1).otherwise(0))
    audit = F.translate(F.array_join("actions", ""), "UAua", "IIRR")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("chunk", audit.alias("piece")))), lambda x: x["piece"])
    first = F.when(F.col("chunk") == F.col("from"), F.col("start")[0]).otherwise(0)
    faults = ["blank", "duplicate", "truncated", "illegal"]
    found = pieces.groupBy("conv").agg(*[F.sum(c).alias(c) for c in faults], F.sum(F.col("cost") + first).alias("cost"),
                                       F.array_join(listed, "").alias("audit"))
    turns = rows.select("conv", "turn").distinct().groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    report = found.join(turns, "conv").join(text_digests(rows, repairs), "conv", "left")
    if ids is not None:
        every = ids.select(F.struct(F.col(ids.columns[0]).alias("id")).alias("conv")).distinct()
        report = every.join(report, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *faults, "cost")]
    return report.select(F.col("conv.id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damage_report(messages: DataFrame, **options) -> DataFrame:
    """``repair_report`` of the conversations after planted damage, for every conversation."""
    return repair_report(damaged(messages), messages.select("conv_id"), **options)
