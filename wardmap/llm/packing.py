"""Token ids of documents, packed into rows of a fixed length.

Texts are encoded with a byte-level BPE vocabulary, ended by an end-of-text id and cut into pieces of at most
one row. Best-fit decreasing: pieces by falling length, each into the open row with the least room that holds
it; a segment tree over the possible rooms finds that row. Packing is done block by block where the texts are
read, so nothing is shuffled and a lost task repeats its own blocks only.

A row is a line of the packed id matrix (little-endian, padded with the end-of-text id), with the cumulative
lengths of its segments, the places at which positions begin again, and where each segment comes from.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardmap.llm.arrays import small_batches
from wardmap.llm.keys import ROW_HASH, ROW_ID, keyed, type_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 2048
#: Tokens that a block gathers before it is packed.
BLOCK_TOKENS = 4_000_000
# Fixed value: how texts are cut before encoding; belongs to the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SEGMENT = "struct<doc_id: {id}, row_hash: bigint, piece: int, pieces: int, start: int, length: int>"
#: Columns of the packed rows, for ids of a type.
PACKED = ("n_tokens int, doc_ids array<{id}>, cu_seqlens array<int>, position_resets array<int>, "
          f"segments array<{SEGMENT}>, input_ids binary")


class Rooms:
    """Open rows by the room they have left; finds the least room of at least a size by a segment tree."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _count(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.open[node] += change
            node //= 2

    def add(self, row: int, room: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._count(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (row, room), the row opened last among equal rooms; None if nothing is large enough."""
        node = size + self.leaves
        if not self.open[node]:
            while node > 1 and (node % 2 or not self.open[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: np.ndarray, most: int) -> np.ndarray:
    """The row of each piece; rows hold at most ``most`` in all."""
    row_of = np.zeros(len(lengths), np.int64)
    rooms, rows = Rooms(most), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        found = rooms.take(size) if size < most else None
        if found is None:
            found = (rows, most)
            rows += 1
        row_of[i] = found[0]
        if found[1] > size:
            rooms.add(found[0], found[1] - size)
    return row_of


def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def decoded(ids: np.ndarray, vocabulary: bytes) -> str:
    """The text of a document's ids without the end-of-text id."""
    return encoder(vocabulary)[0].decode([int(i) for i in ids])


def packed_block(
    docs: list[tuple[object, int, np.ndarray]], length: int, end: int, kind, id_type: pa.DataType,
) -> pa.RecordBatch:
    """Pack the (id, hash, token ids) of a block."""
    sizes = np.array([len(ids) for _, _, ids in docs])
    pieces = -(-sizes // length)
    doc = np.repeat(np.arange(len(docs)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lengths = np.minimum(length, sizes[doc] - piece * length)
    row_of = best_fit(lengths, length)
    order = np.argsort(row_of, kind="stable")
    matrix = np.full((row_of.max() + 1, length), end, kind)
    used = np.zeros(len(matrix), np.int64)
    starts = np.zeros(len(doc), np.int64)
    for i in order:
        row, size, at = row_of[i], lengths[i], used[row_of[i]]
        first = piece[i] * length
        matrix[row, at:at + size] = docs[doc[i]][2][first:first + size]
        starts[i] = at
        used[row] = at + size
    counts = np.bincount(row_of)
    ends_with_zero = np.insert((starts + lengths)[order], np.cumsum(counts) - counts, 0).astype(np.int32)
    ids = pa.array([docs[doc[i]][0] for i in order], id_type)
    int32 = lambda x: pa.array(x[order].astype(np.int32))
    lists = lambda values, n: pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values)
    segments = pa.StructArray.from_arrays(
        [ids, pa.array([docs[doc[i]][1] for i in order], pa.int64()), int32(piece), int32(pieces[doc]),
         int32(starts), int32(lengths)], ["doc_id", "row_hash", "piece", "pieces", "start", "length"])
    return pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), lists(ids, counts), lists(pa.array(ends_with_zero), counts + 1),
         lists(int32(starts), counts), lists(segments, counts), pa.array([r.tobytes() for r in matrix], pa.binary())],
        ["n_tokens", "doc_ids", "cu_seqlens", "position_resets", "segments", "input_ids"])


def packed(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY,
    length: int = LENGTH, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Packed rows of all documents: ``pack_id`` and the columns of ``PACKED``.

    Every document is in full in the rows, followed by an end-of-text id: the segments with its id and hash, by
    piece number, give its ids back. A null or empty text gives no segment. Repeated rows are packed each.
    ``vocabulary`` is read by the driver and sent to the tasks (it has a fixed size). Ids take two bytes where
    the vocabulary allows. An empty table gives no rows. Other columns are not read.
    """
    with open(vocabulary, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        encoding, end = encoder(sent.value)
        kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
        block, tokens, id_type = [], 0, None
        for batch in (small for whole in batches for small in small_batches(whole)):
            id_type = batch.schema.field(0).type
            for own, row_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text:
                    continue
                ids = np.append(encoding.encode_to_numpy(text, disallowed_special=()), end).astype(kind)
                block.append((own, row_hash, ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield from small_batches(packed_block(block, length, end, kind, id_type))
                    block, tokens = [], 0
        if block:
            yield from small_batches(packed_block(block, length, end, kind, id_type))

    texts = keyed(docs, id_column, text_column).select(ROW_ID, ROW_HASH, "__text")
    return texts.mapInArrow(run, PACKED.format(id=type_of(docs, id_column))).withColumn("pack_id", F.monotonically_increasing_id())


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed rows as Parquet: the id matrix as a fixed-width binary column, and its bookkeeping."""
    packed(docs, **options).write.parquet(path)
