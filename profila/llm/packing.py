"""Pack tokenised documents into sequences of fixed length with a bounded number of open windows.

Each partition is read once, in order. A document is cut into full sequences; its remainder goes to
the open window that it fits best. When none fits and ``windows`` are open, the fullest is emitted:
if its gap is at most ``gap`` tokens it is padded, else the head of the remainder fills it. What is
open at the end of the partitions is merged, ``merge`` partitions at a time, in the same way.

Ids are those of the byte-level BPE file ``byte_bpe_50k.json``; the same vocabulary is read from its
rank file because that library encodes several times faster with equal ids (tests compare both).

Defined cases: null text is empty and gives the end id alone; repeated rows are packed each; the string of
the special token of that file is that token, as the file's own library reads it; ids stay as they are, also
beside null ones; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from profila.llm.common import settled

# Fixed value: the special token of the vocabulary.
SPECIAL = {"<|endoftext|>": 50256}
LENGTH = 2048
END_ID = 1
OPEN_WINDOWS = 64
GAP = 8
MERGE = 32
# Merged sequences are numbered from here on, above those of any partition.
MERGED = 1 << 30


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(text: str | None, path: str | None = None) -> np.ndarray:
    return encoder(path).encode_to_numpy(text or "", allowed_special=set(SPECIAL), disallowed_special=())


class Windows:
    """Open windows ordered by room; ``done`` collects (sequence number, pieces) that are complete."""

    def __init__(self, length: int, most: int, gap: int):
        self.length, self.most, self.gap = length, most, gap
        self.order: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}
        self.next, self.done = 0, []

    def _emit(self, number: int) -> None:
        self.done.append((number, self.pieces.pop(number)))

    def _put(self, room: int, number: int, piece: tuple) -> None:
        self.pieces[number].append((*piece, self.length - room))
        if room == len(piece[2]):
            self._emit(number)
        else:
            insort(self.order, (room - len(piece[2]), number))

    def _open(self, piece: tuple) -> None:
        self.pieces[self.next] = []
        self.next += 1
        self._put(self.length, self.next - 1, piece)

    def add(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self._open((doc_id, start, ids[: self.length], total))
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            at = bisect_left(self.order, (len(ids), -1))
            if at < len(self.order):
                room, number = self.order.pop(at)
                self._put(room, number, (doc_id, start, ids, total))
                return
            if len(self.order) < self.most:
                self._open((doc_id, start, ids, total))
                return
            room, number = self.order.pop(0)
            if room <= self.gap:
                self._emit(number)
            else:
                self._put(room, number, (doc_id, start, ids[:room], total))
                start, ids = start + room, ids[room:]

    def take(self) -> list:
        out, self.done = self.done, []
        return out

    def rest(self) -> list:
        out = [(number, self.pieces[number]) for _, number in self.order]
        self.order, self.pieces = [], {}
        return out


def _rows(found: list, base: int) -> list[tuple]:
    return [(doc, start, ids.tobytes(), total, base + number, offset)
            for number, pieces in found for doc, start, ids, total, offset in pieces]


def pack(
    docs: DataFrame, length: int = LENGTH, windows: int = OPEN_WINDOWS, gap: int = GAP, merge: int = MERGE,
    end_id: int = END_ID, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per piece: doc_id, start, ids (binary, little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.

    A task holds ``windows`` open sequences and the document at hand; no step sees more.
    """
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "open"]
    schema = docs.select(F.col(id_col).alias("doc_id")).schema
    for name, t in zip(names[1:], ("long", "binary", "long", "long", "long", "boolean")):
        schema = schema.add(name, t)

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        kept, ids_type = Windows(length, windows, gap), None

        def batch(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [ids_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([is_open] * len(rows), pa.bool_())], names)

        for b in batches:
            ids_type = b.schema.field(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text, vocabulary), np.uint32(end_id)).astype("<u4")
                kept.add(doc_id, 0, ids, len(ids))
                if len(kept.done) >= 512:
                    yield batch(_rows(kept.take(), base), False)
        if ids_type is not None:
            yield batch(_rows(kept.take(), base), False)
            yield batch(_rows(kept.rest(), base), True)

    def merged(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        base = (MERGED + (rows[0]["sequence_id"] >> 32) // merge) << 32
        kept = Windows(length, windows, -1)
        for r in sorted(rows, key=lambda r: (-len(r["ids"]), r["sequence_id"], r["offset"])):
            kept.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
        columns = zip(*_rows(kept.take() + _close(kept.rest(), length, kept.next), base))
        types = [group.schema.field("doc_id").type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names[:6])

    placed = settled(docs.select(id_col, text_col).mapInArrow(online, schema), "packing", by="open")
    left = (
        placed.where("open").groupBy(F.floor(F.shiftright("sequence_id", 32) / merge))
        .applyInArrow(merged, StructType(schema.fields[:6])))
    return placed.where("not open").drop("open").unionByName(left)


def _close(rest: list, length: int, number: int) -> list:
    """Windows left open, poured together: all but the last are full."""
    pieces = [p[:4] for _, window in rest for p in window]
    out, at, room = [], [], length
    for doc, start, ids, total in pieces:
        while len(ids):
            n = min(room, len(ids))
            at.append((doc, start, ids[:n], total, length - room))
            start, ids, room = start + n, ids[n:], room - n
            if not room:
                out.append((number, at))
                number, at, room = number + 1, [], length
    return [*out, (number, at)] if at else out
