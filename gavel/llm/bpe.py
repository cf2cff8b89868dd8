"""Byte-level BPE with the tokenizers library over Arrow batches.

Texts are cut into the pre-tokenizer's pieces for a whole batch at once; pieces repeat, so each
distinct piece goes through the library once and its ids are kept (a bounded memory). Special tokens'
strings inside a text are ordinary text.

Byte-level tokens are written in characters that stand for bytes. Decoding reverses that table and
joins bytes before it makes characters of them, so characters that were split over tokens come back whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gavel.llm.batches import RangeHash, text_pieces

#: Distinct pieces whose ids a worker remembers before it starts anew.
MEMORY_PIECES = 2_000_000

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

_PIECE = RangeHash(3)


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    """Class of every code point as the pre-tokenizer's pattern tells them apart."""
    global _classes
    if _classes is None:
        out = np.zeros(0x110000, np.uint8)
        valid = np.concatenate([np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)])
        every = valid.tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for run in regex.findall(pattern, every):
                out[np.frombuffer(run.encode("utf-32-le"), np.uint32)] = kind
        _classes = out
    return _classes


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of the pre-tokenizer's pattern begin. ``points``: code points of many texts;
    ``first``: where each (non-empty) text begins. Says for all texts at once what the pattern

        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    says for one: runs of one class are pieces; the last blank before a run belongs to that run if it
    is U+0020 and stands alone otherwise; an apostrophe that begins a piece may begin a contraction.
    """
    n = len(points)
    kind = character_classes()[points]
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    start = head.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:n] & ~head[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    mark = np.flatnonzero((points == 0x27) & start[:n])
    mark = mark[~head[mark + 1]]
    if len(mark):
        one = points[mark + 1]
        short = mark[np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))]
        start[short + 1] = False
        start[short + 2] = True
        pair = mark[(mark + 2 < n)]
        pair = pair[~head[pair + 2]]
        long = np.zeros(len(pair), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (points[pair + 1] == ord(a)) & (points[pair + 2] == ord(b))
        pair = pair[long]
        start[pair + 1] = False
        start[pair + 3] = True
    return np.flatnonzero(start[:n])


class ByteBpe:
    """One tokenizer in one worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all it has
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self._forget()
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        words = sorted((i, w) for w, i in self.library.get_vocab(with_added_tokens=False).items())
        spelled = {i: bytes(byte_of[c] for c in w) if all(c in byte_of for c in w) else w.encode() for i, w in words}
        self.length = np.zeros(max(spelled, default=0) + 1, np.int64)
        for i, b in spelled.items():
            self.length[i] = len(b)
        self.place = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(len(self.length))), np.uint8)

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # entries of pieces
        self.said, self.upto = np.zeros(0, "<u4"), np.zeros(1, np.int64)  # ids of entry e: said[upto[e]:upto[e + 1]]

    def _library(self, pieces: list[str]) -> list[list[int]]:
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [x.ids for at in range(0, len(pieces), 4096) for x in encode(pieces[at : at + 4096], add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Add pieces to what is remembered."""
        said = self._library([p.decode("utf-8") for p in pieces])
        sizes = np.fromiter(map(len, said), np.int64, len(said))
        self.known.update(zip(pieces, range(len(self.upto) - 1, len(self.upto) - 1 + len(pieces))))
        self.said = np.concatenate([self.said, np.fromiter((i for x in said for i in x), "<u4", int(sizes.sum()))])
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(sizes)])

    def _alike(self, data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The different pieces, and which of them each piece is. Hashes find them, bytes decide."""
        raw = bytes(data)
        _, shown, which = np.unique(_PIECE.ranges(_PIECE.prefixes(data), starts[:-1], starts[1:]), return_index=True, return_inverse=True)
        sizes, same = np.diff(starts), shown[which]
        alike = (sizes == sizes[same]).all()
        if alike:
            alike = (data[np.arange(len(data)) + np.repeat(starts[same] - starts[:-1], sizes)] == data).all()
        if not alike:  # unlike pieces under one hash
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts[:-1], starts[1:])])
            return list(number), which
        return [raw[starts[i] : starts[i + 1]] for i in shown.tolist()], which

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a piece one after another, and where each text's ids begin."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        points = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
        opens = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each code point begins
        before = np.searchsorted(opens, offsets)
        first = piece_starts(points, before[:-1][np.diff(before) > 0])
        starts = np.append(opens[first], len(data))
        pieces, which = self._alike(data, starts)
        missing = [p for p in pieces if p not in self.known]
        if missing:
            if len(self.known) + len(missing) > MEMORY_PIECES:
                self._forget()
                missing = pieces
            self._learn(missing)
        entries = np.array([self.known[p] for p in pieces], np.int64)[which]
        sizes = self.upto[entries + 1] - self.upto[entries]
        ends = np.cumsum(sizes)
        ids = self.said[np.arange(int(ends[-1])) + np.repeat(self.upto[entries] - (ends - sizes), sizes)]
        upto = np.concatenate([np.zeros(1, np.int64), ends])
        return ids, upto[np.searchsorted(starts[:-1], offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after another."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        inside = np.arange(total) - np.repeat(ends - lengths, lengths)
        return self.bytes[np.repeat(self.place[ids], lengths) + inside]


_tokenizers: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """The worker's tokenizer for a file; it lives as long as the worker."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteBpe(path)
    return _tokenizers[path]


def _binary(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte ranges of a flat array as an Arrow binary column."""
    width = flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets * width, np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``id_col`` and ``ids`` (binary: little-endian unsigned 32-bit ids) per row.

    With ``offsets`` also ``starts`` and ``ends`` (binary, same layout): the half-open range of
    characters that each token touches; tokens that share a split character all name it.
    A null or empty text has no ids; rows are neither dropped nor merged; other columns are left out.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField(c, T.BinaryType()) for c in ("starts", "ends")] if offsets else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for rows, data, at in text_pieces(batches, "__text"):
            ids, upto = bpe.encode(data, at)
            out = [rows.column(0), _binary(ids, upto)]
            if offsets:
                first, last = character_spans(bpe, ids, upto, data, at)
                out += [_binary(first, upto), _binary(last, upto)]
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    given = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("__text"))
    return given.mapInArrow(run, T.StructType(fields))


def character_spans(bpe: ByteBpe, ids: np.ndarray, upto: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character that each token touches, counted inside its text."""
    opens = (data & 0xC0) != 0x80
    seen = np.concatenate([np.zeros(1, np.int64), np.cumsum(opens)])
    ends = np.cumsum(bpe.length[ids])
    begins = ends - bpe.length[ids]
    base = np.repeat(seen[at[:-1]], np.diff(upto))
    # a token that begins inside a character touches the character that has begun before
    first = seen[begins] - np.where(opens[np.minimum(begins, max(len(opens) - 1, 0))], 0, 1) - base
    return first.astype("<u4"), (seen[ends] - base).astype("<u4")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids", errors: str = "replace") -> DataFrame:
    """``id_col``, ``ids_col``, ``decoded`` (bytes) and ``text`` (those bytes as UTF-8; bytes that
    are no character, as when ids were cut inside one, follow ``errors``). Null ids give empty results."""
    fields = [T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField(ids_col, T.BinaryType()), T.StructField("decoded", T.BinaryType()), T.StructField("text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                given = [v or b"" for v in batch.column(1).to_pylist()]
                upto = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(v) // 4 for v in given], dtype=np.int64)])
                ids = np.frombuffer(b"".join(given), "<u4")
                flat = bpe.decode(ids)
                places = np.concatenate([np.zeros(1, np.int64), np.cumsum(bpe.length[ids])])[upto]
                raw = _binary(flat, places)
                texts = pa.array([v.decode("utf-8", errors) for v in raw.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw, texts], [f.name for f in fields])

    return encoded.select(encoded[id_col].alias(id_col), encoded[ids_col].alias(ids_col)).mapInArrow(run, T.StructType(fields))
