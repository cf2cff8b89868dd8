"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Every window (a few
words) of a text is compressed with both; the surplus of a window is the number of bytes that the
toxic dictionary saves. How many windows of a document pass each of several surplus thresholds
is calibrated to a probability on the training rows.

Training of a dictionary: segments (word beginnings and whole words) are scored by the documents of
the own class that contain them against those of the other class, and taken greedily, halving a
document's weight each time it is covered, so copies of one document do not fill the dictionary.
Both dictionaries end alike in the frequent words of ordinary text, so they differ in nothing but what is
characteristic. A fixed run of bytes in front of every window, known to both, keeps zstandard from
storing short windows raw.

Learning happens on the driver from at most ``sample_rows`` labelled rows of each class (by hash of the
id, whole texts); scoring happens in Arrow batches and covers every text.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.llm.batches import Words, text_pieces

#: Bytes in front of every window; no UTF-8 text contains them.
CARRIER = bytes(range(128, 152))
#: Bytes after every window: zstandard looks for no match in the last eight.
TRAILER = bytes(8)
#: Words of a window, and the longest word in bytes (a longer one counts as several).
WINDOW_WORDS, WORD_BYTES = 5, 48
#: Window surpluses (bytes) that are counted per document.
THRESHOLDS = (2, 3, 4, 5, 6, 8)
LETTERS = (3, 9)  # shortest and longest word beginning that may be a segment


@dataclass(frozen=True)
class ToxicityModel:
    """Two dictionaries and the calibration of window surpluses."""

    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        rules = zstandard.ZstdCompressionParameters(window_log=12, chain_log=12, hash_log=10, search_log=4, min_match=4, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=rules) for d in (self.ordinary, self.toxic)]

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.centre)) / np.array(self.scale)
        x = np.clip(z @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)
        return 1 / (1 + np.exp(-x))


_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[[*range(0x09, 0x0E)]] = 0x20


def features(compressors: list[zstandard.ZstdCompressor], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: log counts of windows beyond each threshold, the largest surplus, log of the windows.
    A text without words has zeros."""
    words = Words(data, offsets)
    parts = -(-(words.end - words.start) // WORD_BYTES)
    doc = np.repeat(words.doc, parts)
    step = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(words.start, parts) + step * WORD_BYTES
    end = np.minimum(start + WORD_BYTES, np.repeat(words.end, parts))
    first = np.searchsorted(doc, np.arange(len(offsets)))
    inside = np.arange(len(doc)) - first[doc]
    opens = np.flatnonzero(inside % WINDOW_WORDS == 0)
    closes = np.append(opens[1:], len(doc)) - 1
    raw = _SPACES[data].tobytes()
    plain, toxic = (c.compress for c in compressors)
    surplus = np.zeros(len(opens), np.int64)
    for i, (a, b) in enumerate(zip(start[opens].tolist(), end[closes].tolist())):
        window = CARRIER + b" " + raw[a:b] + b" " + TRAILER
        surplus[i] = len(plain(window)) - len(toxic(window))
    n = len(offsets) - 1
    owner = doc[opens]
    windows = np.bincount(owner, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, owner, np.minimum(surplus, 12))
    counts = [np.log1p(np.bincount(owner[surplus >= t], minlength=n)) for t in THRESHOLDS]
    return np.stack([*counts, most, np.log1p(windows)], axis=1)


def held_out(id_col: Column) -> Column:
    """Whether a row may not be learnt from: crc32 of the id as text divides by 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _segments(text: str) -> set[str]:
    out = set()
    for word in set(text.split()):
        spaced = " " + word[:WORD_BYTES]
        out.update(spaced[: k + 1] for k in range(LETTERS[0], min(len(word), LETTERS[1]) + 1))
        if len(word) >= LETTERS[0] and len(word) <= WORD_BYTES:
            out.add(spaced + " ")
    return out


def frequent_segments(texts: list[str], least: float, slots: int = 1 << 22) -> dict[str, int]:
    """Segments in at least ``least`` texts with their number of texts.

    Rare segments, nearly all of them, are sifted out by counts per hash slot before any is kept.
    """
    rough = np.zeros(slots, np.int32)
    for text in texts:
        rough[np.unique(np.fromiter((hash(s) % slots for s in _segments(text)), np.int64))] += 1
    counts: Counter = Counter()
    for text in texts:
        counts.update(s for s in _segments(text) if rough[hash(s) % slots] >= least)
    return {s: k for s, k in counts.items() if k >= least}


def choose_segments(own: list[str], other: list[str], least_share: float = 0.008, least_ratio: float = 6.0) -> list[str]:
    """Characteristic segments of the texts ``own`` against ``other``; see the module's text. The texts are gone
    through again for every step, so nothing but what is frequent is held."""
    least = max(3.0, least_share * len(own))
    common = frequent_segments(own, least)
    against = Counter(s for text in other for s in _segments(text) if s in common)
    worth = {}
    for s, k in common.items():
        ratio = (k + 0.5) / (len(own) + 1) / ((against[s] + 0.5) / (len(other) + 1))
        if ratio >= least_ratio:
            worth[s] = np.log(min(ratio, 200.0)) * (1 + 0.02 * len(s))
    where = defaultdict(list)
    for i, text in enumerate(own):
        for s in _segments(text):
            if s in worth:
                where[s].append(i)
    places = {s: np.array(i) for s, i in where.items()}
    weight, chosen = np.ones(len(own)), []
    while places:
        covered = {s: float(weight[i].sum()) for s, i in places.items()}
        best = max(covered, key=lambda s: (covered[s] * worth[s], s))
        if covered[best] < least:
            del places[best]
            places = {s: i for s, i in places.items() if covered[s] >= least}
            continue
        chosen.append(best)
        weight[places[best]] /= 2
        places = {s: i for s, i in places.items() if not best.startswith(s) and not s.startswith(best.rstrip(" "))}
    return chosen


def train_dictionaries(toxic: list[str], ordinary: list[str], common_bytes: int = 2000) -> tuple[bytes, bytes]:
    """(ordinary, toxic) raw dictionaries from lower-case texts."""
    both = [sorted(set(texts)) for texts in (ordinary, toxic)]
    own = [("".join(reversed(choose_segments(both[c], both[1 - c])))).encode() for c in (0, 1)]
    frequent = Counter(w for t in set(ordinary) for w in set(t.split()))
    shared, size = [], 0
    for word, _ in sorted(frequent.items(), key=lambda x: (-x[1], x[0])):
        size += len(word.encode()) + 1
        if size > common_bytes:
            break
        shared.append(word)
    longest = max(map(len, own))
    tail = (" " + " ".join(reversed(shared)) + " ").encode() + CARRIER
    return tuple(b"\x01" * (longest - len(o)) + o + tail for o in own)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton steps: (centre, scale, weights with intercept)."""
    centre, scale = np.average(x, axis=0, weights=weight), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    beta = np.zeros(z.shape[1])
    weight = weight / weight.sum()
    penalty = ridge * np.append(np.ones(x.shape[1]), 0) / 10
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * beta
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        beta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return centre, scale, beta


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1500) -> ToxicityModel:
    """Learn from the labelled rows outside the held-out fold, at most ``sample_rows`` of each class.

    An id with several labels takes the largest; null labels, ids and texts are not learnt from.
    Without rows of both classes the model scores everything 0.
    """
    marked = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
        .filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out(F.col("__id")))
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
    )
    sizes = {r["__y"]: r["n"] for r in marked.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [marked.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows) for y in (0, 1)]
    picked = F.broadcast(few[0].unionByName(few[1]))  # at most 2 * sample_rows rows of two numbers
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(picked, "__id").filter(F.col("__text").isNotNull())
    got = [(r["__id"], r["__text"].lower(), r["__y"]) for r in rows.collect()]
    got.sort()
    texts = {y: [t for _, t, c in got if c == y] for y in (0, 1)}
    zero = (0.0,) * (len(THRESHOLDS) + 2)
    if not texts[0] or not texts[1]:
        return ToxicityModel(CARRIER, CARRIER, zero, tuple(1.0 for _ in zero), (*zero, -30.0))
    ordinary, toxic = train_dictionaries(texts[1], texts[0])
    draft = ToxicityModel(ordinary, toxic, zero, zero, zero)
    x = np.concatenate([features(draft.compressors(), data, at) for _, data, at in text_pieces(iter([pa.record_batch([pa.array([t for _, t, _ in got], pa.large_string())], ["t"])]), "t")])
    y = np.array([c for _, _, c in got])
    centre, scale, beta = calibrate(x, y, np.where(y == 1, sizes[1] / len(texts[1]), sizes[0] / len(texts[0])))
    return ToxicityModel(ordinary, toxic, *(tuple(map(float, v)) for v in (centre, scale, beta)))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``toxic_score`` (0 to 1). Null and empty texts, like texts without
    words, score as a text without any surplus. Rows are neither dropped nor merged."""
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            lowered = batch.set_column(at, pa.field(text_col, pa.large_string()), pc.utf8_lower(batch.column(at).cast(pa.large_string())))
            parts = [model.scores(features(tools, data, offsets)) for _, data, offsets in text_pieces(iter([lowered]), text_col)]
            values = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)
