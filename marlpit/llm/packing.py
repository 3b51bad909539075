"""Packing of examples into training sequences by vector bin packing.

Each example has three demands: tokens, one segment, and loss-bearing tokens; a sequence has a capacity for each.
A bin is filled from a window of waiting examples: of those that fit, the one with the largest dot product of its
demands and the bin's rest goes in, dimensions weighed by their mean demand in the window. With `cut`, what still is
free gets a part of the largest example. Each task packs what it reads, so nothing is shuffled; one sequence in a task may stay short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, slices, table
from .tokens import default_vocabulary, encoder

TOKENS, SEGMENTS = 1024, 256
END_ID = 0


@dataclass(slots=True)
class Piece:
    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None  # one flag for each id; None: all bear loss
    total: int

    def bearing(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def prefix(self, tokens: int, loss: int) -> int:
        """Length of the longest prefix within both limits."""
        n = min(tokens, len(self.ids))
        return min(n, loss) if self.loss is None else min(n, int(np.searchsorted(np.cumsum(self.loss), loss, "right")))

    def split(self, n: int) -> tuple[Piece, Piece]:
        cut = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.key, self.start, self.ids[:n], cut[0], self.total), Piece(self.key, self.start + n, self.ids[n:], cut[1], self.total)


class Packer:
    """Bins of pieces, from a window of `window` waiting pieces, or of as many more as it takes to reach a limit. Pieces that fit no bin and can't be cut come alone, marked False."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool, window: int = 512):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be at least 1")
        self.capacity = np.array([tokens, segments, loss], np.float64)
        self.cut, self.window = cut, window
        self.waiting: list[Piece] = []
        self.demands = np.zeros((2 * window + min(tokens, segments) + 2, 3))
        self.held = np.zeros(3)

    def _put(self, piece: Piece) -> None:
        self.demands[len(self.waiting)] = len(piece.ids), 1, piece.bearing()
        self.held += self.demands[len(self.waiting)]
        self.waiting.append(piece)

    def _take(self, i: int) -> Piece:
        self.held -= self.demands[i]
        piece, last = self.waiting[i], self.waiting.pop()
        if last is not piece:
            self.waiting[i] = last
            self.demands[i] = self.demands[len(self.waiting)]
        return piece

    def add(self, piece: Piece) -> Iterator[tuple[list[Piece], bool]]:
        tokens, _, loss = (int(x) for x in self.capacity)
        while len(piece.ids) > tokens or piece.bearing() > loss:
            if not self.cut:
                yield [piece], False
                return
            head, piece = piece.split(piece.prefix(tokens, loss))
            if len(head.ids) == tokens:
                yield [head], True
            else:
                self._put(head)
        if len(piece.ids) == tokens:
            yield [piece], True
        elif len(piece.ids):
            self._put(piece)
        while len(self.waiting) >= self.window and (self.held >= self.capacity).any():
            yield self.fill(), True

    def fill(self) -> list[Piece]:
        rest, chosen = self.capacity.copy(), []
        weights = self.demands[: len(self.waiting)].mean(axis=0) / self.capacity**3
        while self.waiting and rest[0] >= 1 and rest[1] >= 1:
            demands = self.demands[: len(self.waiting)]
            score = np.where((demands <= rest).all(axis=1), demands @ (rest * weights), -1.0)
            best = int(score.argmax())
            if score[best] < 0:
                if not self.cut or (n := self.waiting[i := int(demands[:, 0].argmax())].prefix(int(rest[0]), int(rest[2]))) < 1:
                    break
                head, tail = self._take(i).split(n)
                chosen.append(head)
                if len(tail.ids):
                    self._put(tail)
                rest -= (n, 1, head.bearing())
            else:
                rest -= demands[best]
                chosen.append(self._take(best))
        return chosen

    def drain(self) -> Iterator[tuple[list[Piece], bool]]:
        while self.waiting:
            yield self.fill(), True


FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def pack(
    rows: DataFrame, key: str = "doc_id", text: str = "text", loss: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss_tokens: int | None = None,
    cut: bool = True, with_ids: bool = False, window: int = 512, vocabulary: str | None = None, parts: str | None = None,
) -> DataFrame:
    """Packs the rows' texts, each with an end id after it; one row out for each piece.

    key, start (ids of its row before it), length, ids_crc32 (of its ids as little-endian unsigned 32-bit), doc_tokens
    (ids of its row), loss_tokens, sequence_id, offset, and with `with_ids` the ids as input_ids.
    `loss` names a boolean column: rows where it is false or null bear no loss; without it all ids do.
    `parts` names an array of (text, loss) in place of text: an example of several parts, such as the turns of a
    conversation, of which those with loss bear it; the end id bears loss if the last part does.
    With `cut` off, rows are never cut, and a row beyond the limits comes alone with a null sequence_id.
    Null and empty texts are an end id alone; repeated keys are packed as rows of their own; the same input
    partitions give the same sequences. An empty table gives none. Other columns aren't read; a key named like a result is refused.
    """
    own_name(key, [*(f.split()[0] for f in FIELDS.split(", ")), "input_ids"])
    path, limit = vocabulary or default_vocabulary(), loss_tokens or tokens
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(path), Packer(tokens, segments, limit, cut, window)
        first, n, out = TaskContext.get().partitionId() << 32, 0, []
        names = ["key", *(x.split()[0] for x in FIELDS.split(", ")), *(["input_ids"] if with_ids else [])]
        key_type = None

        def keep(bins: Iterator[tuple[list[Piece], bool]]) -> None:
            nonlocal n
            for pieces, fits in bins:
                offset = 0
                for p in pieces:
                    data = p.ids.astype("<u4", copy=False)
                    out.append((p.key, p.start, len(data), zlib.crc32(data.tobytes()), p.total, p.bearing(), first + n if fits else None, offset, *([data.tolist()] if with_ids else [])))
                    offset += len(data)
                n += fits

        def flush() -> pa.RecordBatch:
            types = [key_type, *[pa.int64()] * 7, *([pa.list_(pa.int64())] if with_ids else [])]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return batch

        for batch in slices(batches):
            key_type = batch.schema.field(0).type
            for k, t, bears in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if parts is None:
                    ids = np.append(coder.ids(t or ""), np.uint32(END_ID))
                    mask = None if bears else np.zeros(len(ids), bool)
                else:
                    pieces = [(coder.ids(x["text"] or ""), bool(x["loss"])) for x in t or [] if x]
                    last = (np.array([END_ID], np.uint32), bool(pieces) and pieces[-1][1])
                    ids = np.concatenate([i for i, _ in (*pieces, last)])
                    mask = np.concatenate([np.full(len(i), b) for i, b in (*pieces, last)])
                keep(packer.add(Piece(k, 0, ids, mask, len(ids))))
            if out:
                yield flush()
        keep(packer.drain())
        if out:
            yield flush()

    bears = F.coalesce(F.col(loss), F.lit(False)) if loss else F.lit(True)
    schema = f"key {kind}, {FIELDS}" + (", input_ids array<long>" if with_ids else "")
    return rows.select(F.col(key).alias("key"), F.col(parts or text).alias("text"), bears.alias("bears")).mapInArrow(run, schema).withColumnRenamed("key", key)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # tokens alone limit a sequence: each has at least one
    return pack(table(spark, sf_dir, "documents"), segments=TOKENS).drop("loss_tokens")
