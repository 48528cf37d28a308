"""Percentiles of very large numeric columns by dyadic count-sketches.

A value is encoded as the leading ``BITS`` bits of its order-preserving 64-bit form (sign, exponent, 12 bits of the fraction). Each prefix length, that is
each binary resolution, has a sketch of ``DEPTH`` rows of ``WIDTH`` signed counters; only the first ``EXACT`` prefix lengths, which have no more nodes
than such a sketch has counters, are kept as plain counts (at ``EXACT`` bits, of which shorter ones are sums). A rank is inverted by descending from the
exact prefix, going left or right by the estimated count of the left child. Sketches are linear: they merge by addition, and a value is deleted by adding
it with weight -1.

A sketch that has seen few different codes travels as its updates (codes and weights) and is laid out in counters when it is asked: a smaller packing of
the same counters. Estimates always come from the counters, whatever the size of the group, unless the caller chooses ``exact_small``.

Error: the value returned is the middle of its code's interval, off by at most 2**-13 of itself. The rank is off by the noise of the estimates met on
the way down; ``rank_error`` states twice its standard deviation as a share of n, from the sketch's own second moments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.session import ship

BITS = 24
EXACT = 12
DEPTH = 5
WIDTH = 1024
LEVELS = BITS - EXACT
TOP = 1 << EXACT
CELLS = TOP + LEVELS * DEPTH * WIDTH
#: Different codes up to which a sketch is packed as its updates, which are then smaller than the counters.
SPARSE = 16_384
#: Different codes up to which the packed updates are plain, so that many small groups need no work by group: a zero byte and ``PAIR`` by code.
PLAIN = 32
PAIR = np.dtype([("code", "<i4"), ("weight", "<i8")])
#: Different (key, code) pairs that a task holds at once (16 bytes each); beyond it the task sends what it has and goes on.
HELD = 1 << 21
#: Sketches laid out in counters at once (half a megabyte each).
LAID_OUT = 64
#: Sketches of one key that one task adds up; more are added by a tree.
FAN_IN = 256
#: Largest error of a value as a share of it.
VALUE_ERROR = 2.0 ** -(BITS - 11)
_rng = np.random.default_rng(20240506)
_A = _rng.integers(1, 2**63, (LEVELS, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, (LEVELS, DEPTH), dtype=np.uint64)


def encode(values: np.ndarray) -> np.ndarray:
    """Codes of doubles, in their order; -0.0 counts as 0.0."""
    bits = (values + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return (np.where(bits & top, ~bits, bits | top) >> np.uint64(64 - BITS)).astype(np.int64)


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of each code's interval."""
    at = (codes.astype(np.uint64) << np.uint64(64 - BITS)) | np.uint64(1 << (63 - BITS))
    top = np.uint64(1 << 63)
    out = np.where(at & top, at ^ top, ~at).view(np.float64)
    zero, low, high = encode(np.array([0.0, -np.inf, np.inf]))
    out = np.where(codes == zero, 0.0, out)
    return np.where(codes >= high, np.inf, np.where(codes <= low, -np.inf, out))


def _places(prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter (within its row) and sign of prefixes."""
    h = (prefix.astype(np.uint64) * _A[level, row] + _B[level, row]) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return (h & np.uint64(WIDTH - 1)).astype(np.int64), np.where(h & np.uint64(1 << 20), 1, -1).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order with their counts added up, without those that cancel out."""
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, counts)
    return distinct[total != 0], total[total != 0]


def _none() -> np.ndarray:
    return np.empty(0, np.int64)


def _pairs(codes: np.ndarray, weights: np.ndarray) -> bytes:
    out = np.empty(len(codes), PAIR)
    out["code"], out["weight"] = codes, weights
    return out.tobytes()


def lay_out(cells: np.ndarray, group: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> None:
    """Add updates to the counters ``cells`` (groups x CELLS)."""
    flat = cells.reshape(-1)
    base = group * CELLS
    np.add.at(flat, base + (codes >> LEVELS), weights)
    for level in range(LEVELS):
        prefix = codes >> (LEVELS - 1 - level)
        for row in range(DEPTH):
            place, sign = _places(prefix, level, row)
            np.add.at(flat, base + (TOP + (level * DEPTH + row) * WIDTH) + place, sign * weights)


def invert(cells: np.ndarray, probs: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Values at the ranks of ``probs`` (groups x probs) and the stated rank error of each group, from counters whose groups are not empty."""
    groups = np.arange(len(cells))[:, None]
    top = np.maximum(cells[:, :TOP], 0)
    ends = np.cumsum(top, axis=1)
    n = ends[:, -1]
    rank = np.array(probs)[None, :] * (n[:, None] - 1)
    node = np.stack([np.minimum((ends <= r[:, None]).sum(axis=1), TOP - 1) for r in rank.T], axis=1)
    here = top[groups, node].astype(float)
    rank = rank - (ends[groups, node] - here)
    for level in range(LEVELS):
        estimates = []
        for row in range(DEPTH):
            base = TOP + (level * DEPTH + row) * WIDTH
            for child, flip in (((node << 1), False), ((node << 1) + 1, True)):  # what isn't right is left
                at, sign = _places(child, level, row)
                x = (cells[groups, base + at] * sign).astype(float)
                estimates.append(here - x if flip else x)
        left = np.minimum(np.maximum(np.median(np.stack(estimates), axis=0), 0.0), here)
        right = (rank >= left) & (left < here)
        node = (node << 1) + right
        rank, here = np.where(right, rank - left, rank), np.where(right, here - left, left)
        rank = np.minimum(rank, here)
    moments = np.median((cells[:, TOP:].reshape(-1, LEVELS, DEPTH, WIDTH).astype(float) ** 2).sum(axis=3), axis=2)
    # the descent never leaves the exact prefix; the median of 2*DEPTH estimates has about 1.25/sqrt(2*DEPTH) of one estimate's deviation
    noise = 2 * np.sqrt((moments / WIDTH).sum(axis=1)) * 1.25 / np.sqrt(2 * DEPTH)
    return decode(node), np.minimum(top.max(axis=1), noise) / n


class Sketch:
    """A group's sketch: its counters, or while these are fewer the updates (codes and weights) that make them. Both merge with each other."""

    def __init__(self, codes: np.ndarray | None = None, weights: np.ndarray | None = None) -> None:
        self.codes, self.weights = (_none(), _none()) if codes is None else (codes, weights)
        self.n = int(self.weights.sum())
        self.cells: np.ndarray | None = None
        if len(self.codes) > SPARSE:
            self._settle()

    def _settle(self) -> None:
        """Updates enter the counters."""
        if self.cells is None:
            self.cells = np.zeros(CELLS, np.int64)
        lay_out(self.cells[None], np.zeros(len(self.codes), np.int64), self.codes, self.weights)
        self.codes, self.weights = _none(), _none()

    def add(self, other: Sketch, sign: int = 1) -> None:
        self.n += sign * other.n
        if len(other.codes):
            self.codes, self.weights = _summed(np.concatenate([self.codes, other.codes]), np.concatenate([self.weights, sign * other.weights]))
        if other.cells is not None:
            if self.cells is None:
                self.cells = np.zeros(CELLS, np.int64)
            self.cells += sign * other.cells
        if len(self.codes) > SPARSE or self.cells is not None and len(self.codes):
            self._settle()

    def pack(self) -> bytes:
        if self.cells is None and 0 < len(self.codes) <= PLAIN and (self.weights > 0).all():
            return b"\0" + _pairs(self.codes, self.weights)
        counts = self.weights if self.cells is None else self.cells
        wide = np.dtype(np.int64 if np.abs(counts).max(initial=0) > 2**31 - 1 else np.int32)
        head = np.array([self.n, len(self.codes), wide.itemsize, self.cells is not None], np.int64).tobytes()
        return zlib.compress(head + np.diff(self.codes, prepend=0).astype(np.int32).tobytes() + counts.astype(wide).tobytes(), 1)

    @staticmethod
    def unpack(packed: bytes) -> Sketch:
        s = Sketch()
        if packed[:1] == b"\0":
            pairs = np.frombuffer(packed, PAIR, offset=1)
            s.codes, s.weights = pairs["code"].astype(np.int64), pairs["weight"].astype(np.int64)
            s.n = int(s.weights.sum())
            return s
        data = zlib.decompress(packed)
        s.n, size, width, dense = np.frombuffer(data, np.int64, 4).tolist()
        wide = np.int32 if width == 4 else np.int64
        s.codes = np.cumsum(np.frombuffer(data, np.int32, size, 32).astype(np.int64))
        counts = np.frombuffer(data, wide, CELLS if dense else size, 32 + 4 * size).astype(np.int64)
        if dense:
            s.cells = counts
        else:
            s.weights = counts
        return s

    def quantiles(self, probs: list[float], exact_small: bool = False) -> tuple[list[float | None], float]:
        """Values at the ranks of ``probs`` and the stated rank error; nulls for an empty sketch."""
        return quantiles_of([self], probs, exact_small)[0]


def quantiles_of(sketches: list[Sketch], probs: list[float], exact_small: bool = False) -> list[tuple[list[float | None], float]]:
    """Values at the ranks of ``probs`` and the stated rank error of each sketch, by descent through the counters.

    ``exact_small``: sketches that still are updates are read off directly, without error but for the code's.
    """
    out: list[tuple[list[float | None], float]] = [([None] * len(probs), 0.0)] * len(sketches)
    asked = []
    for i, s in enumerate(sketches):
        if s.n <= 0:
            continue
        if exact_small and s.cells is None:
            ends = np.cumsum(s.weights)
            at = [min(int(np.searchsorted(ends, p * (s.n - 1), side="right")), len(ends) - 1) for p in probs]
            out[i] = decode(s.codes[at]).tolist(), 0.0
        else:
            asked.append(i)
    for a in range(0, len(asked), LAID_OUT):
        part = asked[a : a + LAID_OUT]
        cells = np.zeros((len(part), CELLS), np.int64)
        for g, i in enumerate(part):
            if sketches[i].cells is not None:
                cells[g] = sketches[i].cells
        sizes = [len(sketches[i].codes) for i in part]
        if any(sizes):
            lay_out(cells, np.repeat(np.arange(len(part)), sizes), np.concatenate([sketches[i].codes for i in part]), np.concatenate([sketches[i].weights for i in part]))
        values, errors = invert(cells, probs)
        for i, v, e in zip(part, values.tolist(), errors.tolist()):
            out[i] = v, e
    return out


def _plain_quantiles(packed: list[bytes], probs: list[float]) -> list[list[float]]:
    """The quantiles of plain packed sketches, all at once."""
    pairs = np.frombuffer(b"".join([x[1:] for x in packed]), PAIR)
    last = np.cumsum([len(x) // PAIR.itemsize for x in packed]) - 1
    ends = np.cumsum(pairs["weight"])
    base = np.r_[0, ends[last[:-1]]]
    n = ends[last] - base
    at = [np.minimum(np.searchsorted(ends, base + np.floor(p * (n - 1)).astype(np.int64), side="right"), last) for p in probs]
    return decode(pairs["code"].astype(np.int64)[np.stack(at, axis=1)]).tolist()


def build_sketches(df: DataFrame, keys: list[str], value: str, weight: str | None = None, facets: list[str] = ()) -> DataFrame:
    """Partial sketches: ``keys``, n, sketch; usually several rows per key (one per task), to be merged by ``merge_sketches``.

    ``facets``: columns by each of which there are sketches beside those of the keys alone; the result then has the columns facet and facet_value as well
    (both null for the keys alone). A task counts by all of them together first and adds up from there, so a value is looked at once.

    ``weight`` (bigint) counts a value that often, negative to delete it; null or 0 leaves it out. Null and NaN values are left out; infinities are
    values. Keys may be null. An empty table gives no rows. Nothing is shuffled, and a key's rows stay where they are, however many.
    """
    ship(df.sparkSession)
    finest = [*keys, *facets]
    names = [f"k{i}" for i in range(len(finest))]
    k0 = len(keys)
    v = F.col(f"`{value}`").cast("double")
    w = F.lit(1).cast("bigint") if weight is None else F.col(f"`{weight}`").cast("bigint")
    rows = df.select(*(F.col(f"`{k}`").cast("string").alias(n) for k, n in zip(finest, names)), v.alias("v"), w.alias("w")).where("v is not null and not isnan(v) and w != 0")
    columns = [*names[:k0], *(["facet", "facet_value"] if facets else [])]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_of: dict[tuple, int] = {}
        pairs, weights, waiting = _none(), _none(), []

        def settle() -> None:
            nonlocal pairs, weights
            pairs, weights = _summed(np.concatenate([pairs, *(p for p, _ in waiting)]), np.concatenate([weights, *(w for _, w in waiting)]))
            waiting.clear()

        def packed_by(number: np.ndarray, key_of: list[tuple]) -> Iterator[pa.RecordBatch]:
            """Sketches by coarser groups: the number of each group's coarser one, and the coarser ones' keys."""
            own, count = _summed(number[pairs >> BITS] << BITS | pairs & ((1 << BITS) - 1), weights)
            groups, start = np.unique(own >> BITS, return_index=True)
            ends = np.r_[start[1:], len(own)]
            codes = own & ((1 << BITS) - 1)
            totals = np.add.reduceat(count, start) if len(start) else _none()
            plain = (ends - start <= PLAIN) & (np.minimum.reduceat(count, start) > 0) if len(start) else np.empty(0, bool)
            for a in range(0, len(groups), 256):
                packed, upto = [], min(a + 256, len(groups))
                low, step = start[a], PAIR.itemsize
                raw = _pairs(codes[low : ends[upto - 1]], count[low : ends[upto - 1]]) if plain[a:upto].any() else b""
                for g, i, j, n, easy in zip(*(x[a:upto].tolist() for x in (groups, start, ends, totals, plain))):
                    packed.append((*key_of[g], n, b"\0" + raw[(i - low) * step : (j - low) * step] if easy else Sketch(codes[i:j], count[i:j]).pack()))
                c = list(zip(*packed))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in c[:-2]] + [pa.array(c[-2], pa.int64()), pa.array(c[-1], pa.binary())], [*columns, "n", "sketch"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pairs, weights
            for f in range(-1, len(facets)):
                coarse: dict[tuple, int] = {}
                extra = (lambda k: (facets[f], k[k0 + f])) if f >= 0 else (lambda k: (None, None)) if facets else (lambda k: ())
                number = np.array([coarse.setdefault((*k[:k0], *extra(k)), len(coarse)) for k in group_of], np.int64)
                yield from packed_by(number, list(coarse))
            group_of.clear()
            pairs, weights = _none(), _none()

        for b in batches:
            if not b.num_rows:
                continue
            # the batch's distinct keys, numbered
            number = np.zeros(b.num_rows, np.int64)
            words = []
            for k in range(len(names)):
                d = b.column(k).dictionary_encode()
                words.append([*d.dictionary.to_pylist(), None])
                number = number * len(words[-1]) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
            distinct, at = np.unique(number, return_inverse=True)
            own = []
            for code in distinct.tolist():
                key = []
                for w_ in reversed(words):
                    key.append(w_[code % len(w_)])
                    code //= len(w_)
                own.append(group_of.setdefault(tuple(reversed(key)), len(group_of)))
            codes = encode(b.column(len(names)).to_numpy().astype(float))
            waiting.append((np.array(own, np.int64)[at] << BITS | codes, b.column(len(names) + 1).to_numpy()))
            if sum(len(p) for p, _ in waiting) >= HELD // 4:
                settle()
                if len(pairs) >= HELD:
                    yield from flush()
        settle()
        yield from flush()

    ddl = ", ".join(f"{n} string" for n in columns) + (", " if columns else "") + "n bigint, sketch binary"
    return rows.mapInArrow(build, ddl).toDF(*keys, *columns[k0:], "n", "sketch")


def merge_sketches(sketches: DataFrame, keys: list[str], signs: str | None = None, tasks: int = 1) -> DataFrame:
    """One sketch per key, the sum of its sketches (times ``signs``, +1 or -1): e.g. days to a week, or a whole less one part.

    ``tasks``: how many partitions ``sketches`` has, if more than ``FAN_IN``. Their sketches are then added up by a tree, ``FAN_IN`` partitions to a node, so
    that no task gets more than that many of a key. Sketches of a key are streamed in key order through a task with one sketch in memory.
    """
    node = F.spark_partition_id()
    while tasks > FAN_IN:
        sketches = _merged(sketches.withColumn("__node", F.floor(node / FAN_IN).cast("string")), [*keys, "__node"], signs)
        node, signs, tasks = F.col("__node").cast("bigint"), None, -(-tasks // FAN_IN)
    return _merged(sketches, keys, signs)


def _merged(sketches: DataFrame, keys: list[str], signs: str | None) -> DataFrame:
    names = [f"k{i}" for i in range(len(keys))]
    sign = F.lit(1) if signs is None else F.col(f"`{signs}`")
    picked = sketches.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)), sign.cast("int").alias("s"), "sketch")
    ordered = picked.repartition(*names).sortWithinPartitions(*names) if names else picked.repartition(1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, None, []

        def row() -> tuple:
            # a plain sketch that is its key's only one stays as it is
            return (*key, sum(w for _, w in struct.iter_unpack("<iq", held[1:])), held) if isinstance(held, bytes) else (*key, held.n, held.pack())

        def batch() -> pa.RecordBatch:
            c = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in c[: len(names)]] + [pa.array(c[-2], pa.int64()), pa.array(c[-1], pa.binary())], [*names, "n", "sketch"])

        for b in batches:
            for *k, s, packed in zip(*(b.column(i).to_pylist() for i in range(len(names) + 2))):
                if held is None or k != key:
                    if held is not None:
                        out.append(row())
                    key, held = k, packed if s == 1 and packed[:1] == b"\0" else Sketch()
                    if held is packed:
                        continue
                if isinstance(held, bytes):
                    held = Sketch.unpack(held)
                held.add(Sketch.unpack(packed), s)
                if len(out) >= 256:
                    yield batch()
                    out = []
            if len(out) >= 256:
                yield batch()
                out = []
        if held is not None:
            out.append(row())
        if out:
            yield batch()

    ddl = "".join(f"{n} string, " for n in names) + "n bigint, sketch binary"
    return ordered.mapInArrow(merge, ddl).toDF(*keys, "n", "sketch")


def sketch_quantiles(sketches: DataFrame, keys: list[str], probs: list[float], exact_small: bool = False) -> DataFrame:
    """``keys``, n, quantiles (array aligned with ``probs``), rank_error (share of n), value_error (share of the value).

    Every group's ranks are inverted through its counters. ``exact_small`` is the caller's choice for tables of very many small groups: those of at most
    ``SPARSE`` different codes are then read off their updates, exactly up to the code.
    """
    names = [f"k{i}" for i in range(len(keys))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(len(names) + 1).to_pylist()
            easy = [exact_small and x[:1] == b"\0" for x in packed]
            plain = iter(_plain_quantiles([x for x, e in zip(packed, easy) if e], probs) if any(easy) else ())
            rest: list = []
            for a in range(0, len(packed), LAID_OUT):
                rest += quantiles_of([Sketch.unpack(x) for x, e in zip(packed[a : a + LAID_OUT], easy[a : a + LAID_OUT]) if not e], probs, exact_small)
            others = iter(rest)
            got = [(next(plain), 0.0) if e else next(others) for e in easy]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(names) + 1)), pa.array([q for q, _ in got], pa.list_(pa.float64())), pa.array([e for _, e in got], pa.float64()), pa.array([VALUE_ERROR] * b.num_rows, pa.float64())],
                [*names, "n", "quantiles", "rank_error", "value_error"],
            )

    ddl = "".join(f"{n} string, " for n in names) + "n bigint, quantiles array<double>, rank_error double, value_error double"
    picked = sketches.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)), "n", "sketch")
    return picked.mapInArrow(read, ddl).toDF(*keys, "n", "quantiles", "rank_error", "value_error")
