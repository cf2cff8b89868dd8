"""Hierarchical multi-length packing of token sequences.

A document's ids (with an end id) are cut into full windows; what is left over, and every shorter
document, is routed to the smallest of several context-size tiers that holds it. Each tier, from the longest down, is packed into
sequences of its own length: opened with its longest piece, their gaps filled with the longest pieces of this and
the shorter tiers that fit, and closed with a cut piece, so no sequence has padding. What a task has left when its
input ends makes sequences of power-of-two lengths. Finished sequences are dealt to step groups whose
attention cost (the sum of squared piece lengths) is alike.

Everything happens while a partition streams by: ids are never shuffled, and a worker holds a
bounded number of them. Sequence ids carry the partition's number.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gavel.llm.batches import text_pieces
from gavel.llm.bpe import tokenizer

#: Low bits of a sequence id; the partition's number is above them.
LOCAL_BITS = 40


class TierPacker:
    """Packs the pieces of one task. A piece is (length, serial, document, start)."""

    def __init__(self, window: int, tiers: tuple[int, ...], step_windows: int):
        self.window, self.step = window, step_windows
        self.tiers = sorted({t for t in tiers if t < window} | {window})
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers must be powers of two")
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}  # each sorted by length
        self.held = dict.fromkeys(self.tiers, 0)  # ids waiting in each
        self.serial = 0
        self.ready: list[tuple[int, list]] = []  # (length of the sequence, its pieces)

    def add(self, doc: object, start: int, length: int) -> None:
        while length >= self.window:
            self.serial += 1
            self.ready.append((self.window, [(self.window, self.serial, doc, start)]))
            start, length = start + self.window, length - self.window
        if length:
            self._wait(doc, start, length)

    def _wait(self, doc: object, start: int, length: int) -> None:
        self.serial += 1
        tier = next(t for t in self.tiers if t >= length)
        self.held[tier] += length
        insort(self.waiting[tier], (length, self.serial, doc, start))

    def _pop(self, tier: int, at: int) -> tuple:
        piece = self.waiting[tier].pop(at)
        self.held[tier] -= piece[0]
        return piece

    def _take(self, gap: int, top: int) -> tuple:
        """The longest piece of the tiers up to ``top`` that fits; else a piece cut to fit."""
        cut = None
        for tier in reversed(self.tiers):
            pieces = self.waiting[tier]
            if tier > top or not pieces:
                continue
            at = bisect_right(pieces, (gap, float("inf")))
            if at:
                return self._pop(tier, at - 1)
            cut = tier
        length, serial, doc, start = self._pop(cut, 0)
        self._wait(doc, start + gap, length - gap)
        return gap, serial, doc, start

    def _fill(self, size: int, top: int) -> None:
        """A sequence of ``size`` ids from the tiers up to ``top``, which hold as many."""
        gap, pieces, own = size, [], self.waiting[top]
        if own and own[-1][0] <= size:
            pieces.append(self._pop(top, len(own) - 1))
            gap -= pieces[0][0]
        while gap:
            pieces.append(self._take(gap, top))
            gap -= pieces[-1][0]
        self.ready.append((size, pieces))

    def _upto(self, top: int) -> int:
        return sum(n for tier, n in self.held.items() if tier <= top)

    def pack(self, end: bool) -> list[tuple[int, int, list]]:
        """(step group, length, pieces) of the sequences that can be closed now."""
        for tier in reversed(self.tiers):
            while self.waiting[tier] and self._upto(tier) >= tier:
                self._fill(tier, tier)
        size = self.window
        while end and (left := self._upto(self.window)):
            if left >= size:
                self._fill(size, self.window)
            else:
                size //= 2
        done, self.ready = self.ready, []
        groups = -(-len(done) // self.step)
        dealt = []
        order = sorted(done, key=lambda s: -sum(p[0] ** 2 for p in s[1]))
        for i, (length, pieces) in enumerate(order):  # there and back again over the groups
            lap, spot = divmod(i, groups)
            dealt.append((spot if lap % 2 == 0 else groups - 1 - spot, length, pieces))
        return sorted(dealt, key=lambda s: s[0])


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    window: int = 2048,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048),
    pending_tokens: int = 1 << 19,
    step_windows: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``id_col``, ``start`` (the document's ids before it), ``length``, ``ids``
    (binary, little-endian unsigned 32-bit), ``doc_tokens`` (with the end id), ``sequence_id``,
    ``offset`` in the sequence, ``sequence_length``, ``step_group``.

    Every id of every row lies in exactly one piece. Sequences have ``window`` ids, the size of a smaller tier or, at the end of a
    task's input, another power of two. A null or empty text is its end id alone; null and repeated ids are packed row by row;
    no rows give no pieces; other columns are not read.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    names = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")
    kinds = {"ids": T.BinaryType(), "sequence_length": T.IntegerType()}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, kinds.get(c, T.LongType())) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << LOCAL_BITS
        packer = TierPacker(window, tiers, step_windows)
        sequences = steps = 0
        arrow = [(c, pa.binary() if c == "ids" else pa.int32() if c == "sequence_length" else pa.int64()) for c in names]

        def rows(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, steps
            closed = packer.pack(end)
            for first in range(0, len(closed), 512):
                docs_out, out = [], {c: [] for c in names}
                for group, size, pieces in closed[first : first + 512]:
                    offset = 0
                    for length, _, (doc, ids), start in pieces:
                        docs_out.append(doc)
                        for c, v in zip(names, (start, length, ids[start : start + length].tobytes(), len(ids), base + sequences, offset, size, base + steps + group)):
                            out[c].append(v)
                        offset += length
                    sequences += 1
                yield pa.RecordBatch.from_arrays([pa.array(docs_out, kind)] + [pa.array(out[c], k) for c, k in arrow], [id_col, *names])
            steps += 1 + max((s[0] for s in closed), default=-1)

        kind, held = pa.null(), 0
        for piece, data, at in text_pieces(batches, "__text"):
            kind = piece.schema.field(0).type
            ids, upto = bpe.encode(data, at)
            for i, doc in enumerate(piece.column(0).to_pylist()):
                own = np.append(ids[upto[i] : upto[i + 1]], np.array([end_id], "<u4")).astype("<u4")
                packer.add((doc, own), 0, len(own))
                held += len(own)
            if held >= pending_tokens:
                yield from rows(False)
                held = 0
        if kind != pa.null():
            yield from rows(True)

    return docs.select(docs[id_col].alias(id_col), docs[text_col].alias("__text")).mapInArrow(run, schema)
