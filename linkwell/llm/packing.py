"""Packing of tokenised examples into sequences: vector bin packing with the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. Each task packs the examples
it reads. From a bounded pool of waiting examples the open sequence takes the one whose demand, as
shares of the limits, has the largest dot product with what the sequence has left; when none fits, an
example is cut to fill the sequence and its rest waits on. An example longer than a sequence gives
whole sequences first. What remains in a task's last sequence, or in one that ran out of segments
or loss-bearing tokens, is cut along the binary digits of its length, so that it needs no padding:
a sequence is padded to the capacity except at a power of two.

The pool's size bounds the memory, not the result: every id lies in exactly one piece. Sequence ids
come from the task's number and a counter, so a task that is run again gives the same rows.

Cases: a null or empty text is the end id alone; a text of any length is cut into pieces, and only
its unplaced rest waits; of examples with equal dot products the one in the lowest slot goes first; repeated rows are packed each; a null id stays
null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, filled

POOL = 512  # waiting examples of a task
SCHEMA = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint"


class Packer:
    """Fills sequences; an example is (key, ids, loss), loss being a 0/1 array as long as ids."""

    def __init__(self, tokens: int = 2048, segments: int = 256, loss: int = 2048, pool: int = POOL, first_sequence: int = 0):
        self.limits = np.array([tokens, segments, loss], float)
        self.most, self.pool, self.next = pool, pool, first_sequence
        self.examples: list = [None] * pool  # (key, ids that wait, their cumulated loss, ids before them, ids of the example)
        self.at = np.zeros(pool, np.int64)  # waiting ids of each example that are placed already
        self.need = np.zeros((pool, 3))
        self.free = list(range(pool))
        self.closed: list = []
        self._open()

    def _open(self) -> None:
        self.left, self.pieces = self.limits.copy(), []

    def add(self, key, ids: np.ndarray, loss: np.ndarray) -> None:
        cum = np.concatenate(([0], np.cumsum(loss)))
        example, begin = (key, ids, cum, 0, len(ids)), 0
        size, loss_size = int(self.limits[0]), self.limits[2]
        while len(ids) - begin >= size and cum[begin + size] - cum[begin] <= loss_size:  # whole sequences
            self._close([(example, begin, size, cum[begin + size] - cum[begin])])
            begin += size
        if begin == len(ids):
            return
        while not self.free:
            self._step()
        slot = self.free.pop()
        self.examples[slot], self.at[slot] = (key, ids[begin:].copy(), cum[begin:] - cum[begin], begin, len(ids)), 0
        self.need[slot] = (len(ids) - begin, 1, cum[-1] - cum[begin])

    def _step(self) -> None:
        """Places one example, cuts one, or closes the open sequence."""
        live = self.need[:, 1] > 0
        fits = live & (self.need <= self.left).all(axis=1)
        if fits.any():
            value = (self.need / self.limits) @ (self.left / self.limits)
            slot = int(np.where(fits, value, -1.0).argmax())
            self._place(slot, int(self.need[slot, 0]))
        elif live.any() and self.left[0] >= 1 and self.left[1] >= 1:
            slot = int(np.where(live, self.need[:, 0], -1.0).argmax())
            ids, cum = self.examples[slot][1:3]
            begin = int(self.at[slot])
            room = min(int(self.left[0]), int(np.searchsorted(cum, cum[begin] + self.left[2], side="right")) - 1 - begin)
            if room > 0:
                self._place(slot, min(room, len(ids) - begin))
            else:
                self._finish()
        else:
            self._finish()

    def _place(self, slot: int, length: int) -> None:
        example, begin = self.examples[slot], int(self.at[slot])
        cum = example[2]
        loss = cum[begin + length] - cum[begin]
        self.pieces.append((example, begin, length, loss))
        self.left -= (length, 1, loss)
        self.at[slot] += length
        self.need[slot] -= (length, 0, loss)
        if self.at[slot] == len(example[1]):
            self.need[slot], self.examples[slot] = 0, None
            self.free.append(slot)
        if self.left[0] < 1:
            self._finish()

    def _finish(self) -> None:
        """Closes the open sequence; a partial one in parts whose lengths are powers of two."""
        if not self.pieces:
            raise ValueError("an example does not fit an empty sequence")
        pieces, total = self.pieces, sum(p[2] for p in self.pieces)
        self._open()
        if total == self.limits[0]:
            self._close(pieces)
            return
        while total:
            part, room = [], 1 << (total.bit_length() - 1)
            total -= room
            while room:
                example, begin, length, loss = pieces.pop(0)
                take = min(length, room)
                if take < length:
                    pieces.insert(0, (example, begin + take, length - take, example[2][begin + length] - example[2][begin + take]))
                    loss = example[2][begin + take] - example[2][begin]
                part.append((example, begin, take, loss))
                room -= take
            self._close(part)

    def _close(self, pieces: list) -> None:
        offset = 0
        for (key, ids, _, before, total), begin, length, loss in pieces:
            self.closed.append((key, before + begin, length, ids[begin : begin + length].tobytes(), total, int(loss), self.next, offset))
            offset += length
        self.next += 1

    def end(self) -> None:
        while (self.need[:, 1] > 0).any() or self.pieces:
            self._step()

    def taken(self) -> list:
        rows, self.closed = self.closed, []
        return rows


_ARROW = pa.schema(
    [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def _batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", loss_from: str | None = None, end_id: int = 1, tokens: int = 2048, segments: int = 256, loss: int = 2048) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, loss_tokens, sequence_id, offset.

    loss_from names a column with the number of leading ids of a row that bear no loss (a prompt);
    without it every id bears loss. The tokenizer's path must exist on the executors.
    """
    skip = F.coalesce(F.col(loss_from).cast("bigint"), F.lit(0)) if loss_from else F.lit(0).cast("bigint")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), skip.alias("skip"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import Encoder

        encode = Encoder(tokenizer_path)
        packer = Packer(tokens, segments, loss, first_sequence=TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for at, n in byte_slices(batch.column(1)):
                part = batch.slice(at, n)
                for key, text, prompt in zip(part.column(0).to_pylist(), filled(part.column(1)).to_pylist(), part.column(2).to_pylist(), strict=True):
                    ids = np.concatenate((encode(text), end))
                    bears = np.ones(len(ids), np.int64)
                    bears[: max(0, prompt)] = 0
                    packer.add(key, ids, bears)
                if done := packer.taken():
                    yield _batch(done)
        packer.end()
        if done := packer.taken():
            yield _batch(done)

    return rows.mapInArrow(run, SCHEMA)
