"""Test passages inside a training corpus: n-gram seeds, then local alignment of the words around them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.text_form import transducer, words
from tidewheel.session import ship

#: Words of test passages that are held at once; a larger set is searched in several blocks of passages.
BLOCK_WORDS = 2_000_000
#: Documents' words looked at in one go.
CHUNK = 1 << 18
MATCH, MISMATCH, GAP = 2, -1, -1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PassageIndex:
    """Distinct passages of a block of items as word numbers, and their seeds."""

    def __init__(self, items: list[tuple[int, str]], n: int) -> None:
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.passages: list[np.ndarray] = []
        self.items: list[list[int]] = []
        at: dict[tuple[int, ...], int] = {}
        for item, passage in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(transducer().form(passage)))
            if not ids:
                continue
            if ids not in at:
                at[ids] = len(self.passages)
                self.passages.append(np.array(ids, np.int32))
                self.items.append([])
            self.items[at[ids]].append(item)
        self.longest = max(map(len, self.passages), default=0)
        #: sizes of seeds: n words, and the whole of each passage that has fewer
        self.sizes = sorted({min(n, len(p)) for p in self.passages})
        self.seeds: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in self.sizes:
            mine = [i for i, p in enumerate(self.passages) if min(n, len(p)) == size]
            per = [np.unique(self.hashes(self.passages[i].astype(np.uint64), size)) for i in mine]
            grams, of = np.unique(np.concatenate(per), return_inverse=True)
            passages: list[list[int]] = [[] for _ in grams]
            for g, i in zip(of.tolist(), np.repeat(mine, list(map(len, per))).tolist()):
                passages[g].append(i)
            self.seeds[size] = grams, passages
        #: for each passage, the places of each of its words as bits
        self.bits: list[dict[int, int]] = []
        for p in self.passages:
            places: dict[int, int] = {}
            for i, w in enumerate(p.tolist()):
                places[w] = places.get(w, 0) | 1 << i
            self.bits.append(places)

    @staticmethod
    def hashes(ids: np.ndarray, size: int) -> np.ndarray:
        """Hash of the run of ``size`` words that starts at each place."""
        k = len(ids) - size + 1
        h = np.zeros(max(k, 0), np.uint64)
        for j in range(size):
            h = (h + ids[j : j + len(h)]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
        return h

    def hits(self, ids: np.ndarray, known_until: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Places in joined texts (``ends`` of each) where a seed stands, its size and the passages that have it, by place."""
        at, size, passages = [], [], []
        wide = ids.astype(np.uint64)
        for k, (grams, having) in self.seeds.items():
            start = np.flatnonzero(known_until[k:] - known_until[:-k] == k) if len(ids) >= k else np.empty(0, np.int64)
            start = start[start + k <= ends[np.searchsorted(ends, start, side="right")]] if len(start) else start
            h = np.zeros(len(start), np.uint64)
            for j in range(k):
                h = (h + wide[start + j]) * _MULTIPLIER
                h ^= h >> np.uint64(29)
            g = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
            found = grams[g] == h
            at.append(start[found])
            size.append(np.full(int(found.sum()), k))
            passages += [having[x] for x in g[found].tolist()]
        where, sizes = np.concatenate(at), np.concatenate(size)
        order = np.argsort(where, kind="stable")
        return where[order], sizes[order], [passages[i] for i in order.tolist()]

    def in_order(self, passage: int, other: list[int]) -> int:
        """Words that a passage and other text have in common in the same order, at most: their longest common subsequence, by bits."""
        bits, full = self.bits[passage], (1 << len(self.passages[passage])) - 1
        open_ = full
        for w in other:
            if w in bits:
                taken = open_ & bits[w]
                open_ = (open_ + taken | open_ - taken) & full
        return (~open_ & full).bit_count()


def align(passage: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score (linear gaps) and longest shared run of consecutive words of a passage with each row of ``windows`` (padded with 0)."""
    k, width = windows.shape
    score, run = np.zeros((k, width + 1), np.int32), np.zeros((k, width + 1), np.int32)
    best, longest = np.zeros(k, np.int32), np.zeros(k, np.int32)
    offset = np.arange(width + 1, dtype=np.int32) * -GAP
    for word in passage:
        equal = windows == word
        run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
        fresh = np.zeros_like(score)
        fresh[:, 1:] = np.maximum(np.maximum(score[:, :-1] + np.where(equal, MATCH, MISMATCH), score[:, 1:] + GAP), 0)
        score = np.maximum.accumulate(fresh + offset, axis=1) - offset
        np.maximum(best, score.max(axis=1), out=best)
        np.maximum(longest, run.max(axis=1), out=longest)
    return best, longest


def _blocks(items: DataFrame, ident: str, passage: str) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.select(F.col(f"`{ident}`").cast("bigint").alias("i"), F.col(f"`{passage}`").alias("p")).where("i is not null and p is not null").toLocalIterator():
        block.append((r["i"], r["p"]))
        size += len(r["p"]) // 4
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str, *, n: int = 4, run: int = 12, min_share: float = 0.5) -> DataFrame:
    """Documents with (parts of) test passages: doc, item, longest_run, score_share, n_seeds.

    ``longest_run`` is the number of consecutive words shared, ``score_share`` the local alignment's score as a share of a perfect copy's. A row comes
    out if the run is at least ``run`` or the share at least ``min_share``, which also finds edited and paraphrased copies that keep ``n`` words in a row.
    ``n_seeds`` is the number of places in the document's words around it with a seed of the passage. Of a passage with fewer than ``n`` words the whole is
    the seed, so it is found where it stands unchanged.

    Words are runs of letters and digits, in lower case, of the consistent form. Null texts, texts and passages without words and null ids give no rows;
    items with the same passage each get a row; a repeated document id counts once; empty tables give no rows.

    Scale: one pass over the corpus without any shuffle but that of the rows found. Every n-gram of a passage is a seed, as an edited copy may keep any of
    them. Around seeds, windows of words are cut out; of the pairs of window and passage that share a seed, those are aligned which can reach ``run`` (by
    the seeds in a row) or ``min_share`` (by the words they have in common in the same order); the bounds lose no row. The passages are broadcast in blocks of
    ``BLOCK_WORDS`` words, each block with a pass of its own.
    """
    ship(documents.sparkSession)
    sc = documents.sparkSession.sparkContext
    corpus = documents.select(F.col(f"`{doc}`").cast("bigint").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).where("doc is not null and text is not null")

    def search(block: list[tuple[int, str]]) -> DataFrame:
        index = sc.broadcast(PassageIndex(block, n))

        def windows(docs: list[int], sizes: list[int], ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[int], list[list[int]]]]:
            """Stretches of words around seeds, with the places and passages of the seeds."""
            x, ends = index.value, np.cumsum(sizes)
            at, size, passages = x.hits(ids, np.cumsum(np.r_[0, ids > 0]), ends)
            if not len(at):
                return
            of = np.searchsorted(ends, at, side="right")
            far = np.flatnonzero((of[1:] != of[:-1]) | (at[1:] - at[:-1] > 2 * x.longest + n)) + 1
            for a, b in zip(np.r_[0, far].tolist(), np.r_[far, len(at)].tolist()):
                d = int(of[a])
                yield docs[d], ids[max(int(ends[d]) - sizes[d], int(at[a]) - x.longest) : min(int(ends[d]), int((at[a:b] + size[a:b]).max()) + x.longest)], at[a:b].tolist(), passages[a:b]

        def score(docs: list[int], sizes: list[int], ids: list[int]) -> pa.RecordBatch:
            x = index.value
            wanted: dict[int, list[tuple[int, np.ndarray, int]]] = defaultdict(list)
            for d, own, places, seeds in windows(docs, sizes, np.array(ids, np.int32)):
                hits: dict[int, list[int]] = {}  # of each passage: seeds, the last one's place, seeds in a row up to it, most in a row
                for at, passages in zip(places, seeds):
                    for p in passages:
                        h = hits.setdefault(p, [0, -2, 0, 0])
                        h[0] += 1
                        h[2] = h[2] + 1 if h[1] == at - 1 else 1
                        h[1], h[3] = at, max(h[3], h[2])
                listed = own.tolist()
                for p, (k, _, _, row) in hits.items():
                    if row > run - n or x.in_order(p, listed) >= min_share * len(x.passages[p]):
                        wanted[p].append((d, own, k))
            rows: list[tuple] = []
            for p, group in wanted.items():
                group.sort(key=lambda r: len(r[1]))
                perfect = MATCH * len(x.passages[p])
                at = 0
                while at < len(group):  # windows of similar length together
                    upto = at + 1
                    while upto < len(group) and len(group[upto][1]) <= 1.5 * len(group[at][1]) + 16 and (upto - at) * len(group[upto][1]) < 1 << 18:
                        upto += 1
                    part = group[at:upto]
                    padded = np.zeros((len(part), len(part[-1][1])), np.int32)
                    for i, (_, own, _k) in enumerate(part):
                        padded[i, : len(own)] = own
                    best, longest = align(x.passages[p], padded)
                    for (d, _, k), s, r in zip(part, best.tolist(), longest.tolist()):
                        if r >= run or s >= min_share * perfect:
                            rows += [(d, i, r, s / perfect, k) for i in x.items[p]]
                    at = upto
            c = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32()))], ["doc", "item", "longest_run", "score_share", "n_seeds"])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = index.value
            if not x.passages:
                return
            get, form = x.vocabulary.get, transducer().form
            docs, sizes, ids = [], [], []
            for b in batches:
                for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                    found = [get(w, 0) for w in words(form(t.as_py()))]
                    docs.append(d)
                    sizes.append(len(found))
                    ids += found
                    if len(ids) >= CHUNK:
                        yield score(docs, sizes, ids)
                        docs, sizes, ids = [], [], []
            if docs:
                yield score(docs, sizes, ids)

        return corpus.mapInArrow(scan, "doc bigint, item bigint, longest_run int, score_share double, n_seeds int")

    found = [search(b) for b in _blocks(items, item, passage)]
    if not found:
        return documents.sparkSession.createDataFrame([], f"`{doc}` bigint, `{item}` bigint, longest_run int, score_share double, n_seeds int")
    merged = reduce(DataFrame.unionByName, found).groupBy(F.col("doc").alias(doc), F.col("item").alias(item))
    return merged.agg(F.max("longest_run").alias("longest_run"), F.max("score_share").alias("score_share"), F.max("n_seeds").alias("n_seeds"))
