"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.session import checkpoint, join_dimension, ship

# Fixed value: the split pattern of the public byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Residuals that one node of the reduction tree combines.
FAN_IN = 64


@cache
def _encoding(name: str):
    """The tokenizer of a vocabulary file that was shipped under this name."""
    import tiktoken

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _shipped(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file from the driver to every executor; its name there."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"the tokenizer's vocabulary file {path} isn't on the driver")
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def token_sizes(documents: DataFrame, ident: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """Columns ident, source, tokens: the size of each whole text in tokens of the byte-level vocabulary file at ``tokenizer`` (null text: 0)."""
    ship(documents.sparkSession)
    name = _shipped(documents.sparkSession, tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(name).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([0 if t is None else len(encode(t)) for t in b.column(2).to_pylist()], pa.int64())], [ident, source, "tokens"])

    picked = documents.select(F.col(f"`{ident}`").cast("bigint").alias(ident), F.col(f"`{source}`").cast("string").alias(source), F.col(f"`{text}`").cast("string").alias("text"))
    return picked.mapInArrow(count, f"`{ident}` bigint, `{source}` string, tokens bigint")


def _chances(seed: int, ids: list[int]) -> list[float]:
    """A number in [0, 1) for each id, fixed by it and the seed, so that a repeated task decides alike."""
    h = np.array(ids, np.int64).astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (((h ^ h >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53).tolist()


def pivotal(ids: list[int], weights: list[int], shares: list[float], seed: int) -> tuple[list[tuple[int, int]], tuple[int, int, float] | None]:
    """Round ``shares`` (each in (0, 1)) to 0 or 1, keeping the sum of weight x share but for one residual, which is returned.

    Two at a time, mass weight x share moves from one to the other until one share is 0 or 1; the direction is drawn so that each share keeps its
    expectation. Weights must be positive.
    """
    decided: list[tuple[int, int]] = []
    held: tuple[int, int, float] | None = None
    for j, v, q, chance in zip(ids, weights, shares, _chances(seed, ids)):
        if held is None:
            held = (j, v, q)
            continue
        i, w, p = held
        to_i, to_j = min(w * (1 - p), v * q), min(v * (1 - q), w * p)
        if chance * (to_i + to_j) < to_j:
            p, q, full_i, full_j = p + to_i / w, q - to_i / v, to_i == w * (1 - p), to_i == v * q
            end_i, end_j = (1 if full_i else None), (0 if full_j else None)
        else:
            p, q, empty_i, full_j = p - to_j / w, q + to_j / v, to_j == w * p, to_j == v * (1 - q)
            end_i, end_j = (0 if empty_i else None), (1 if full_j else None)
        if end_i is not None:
            decided.append((i, end_i))
        if end_j is not None:
            decided.append((j, end_j))
        held = (i, w, p) if end_i is None else (j, v, q) if end_j is None else None
    return decided, held


def mixing_rates(sizes: DataFrame, source: str, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """One row per target source: target_share, max_repeats, available tokens, wanted tokens and the copies per document that give them (rate).

    With ``total_tokens`` null the total is the largest at which every source that has any tokens reaches its share (of the shares of such sources).
    A source with two different targets is an error. With a given total a source whose cap binds contributes ``max_repeats`` times its size and falls short.
    """
    have = sizes.groupBy(source).agg(F.sum("tokens").alias("available"))
    t = targets.select(F.col(f"`{source}`").alias(source), F.col("target_share").cast("double").alias("target_share"), F.greatest(F.col("max_repeats"), F.lit(0)).cast("double").alias("max_repeats"))
    t = t.where(f"`{source}` is not null and target_share > 0 and not isnan(target_share)").distinct()
    twice = t.groupBy(source).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two different targets for the source {twice[0][0]!r}")
    rows = t.join(have, source, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    present = F.col("available") * F.col("max_repeats") > 0
    sums = rows.agg(F.sum(F.when(present, F.col("target_share"))).alias("whole"), F.min(F.when(present, F.col("available") * F.col("max_repeats") / F.col("target_share"))).alias("most"))
    total = F.col("whole") * F.col("most") if total_tokens is None else F.lit(float(total_tokens))
    rows = rows.crossJoin(F.broadcast(sums))  # one row
    wanted = F.when(present, total * F.col("target_share") / F.col("whole")).otherwise(0.0)
    return rows.withColumn("wanted", wanted).withColumn("rate", F.when(present, F.least(F.col("wanted") / F.col("available"), F.col("max_repeats"))).otherwise(0.0)).drop("whole", "most")


def mix_sources(documents: DataFrame, ident: str, text: str, source: str, targets: DataFrame, tokenizer: str, *, total_tokens: int | None = None, seed: int = 17) -> DataFrame:
    """One row per document: ident, source, tokens, copies.

    ``targets`` (a few rows): ``source``, target_share, max_repeats. Each document of a source gets ``rate`` copies in expectation (see
    ``mixing_rates``), at most max_repeats rounded up from the rate; a source's total differs from its wanted tokens by less than one document.
    Documents without a source, of a source without target or without tokens get 0 copies (the last: the rate rounded at random); an empty table gives
    no rows. A repeated id is rounded as often as it occurs.

    Scale: texts are tokenised where they are read; from there on only (id, source, tokens) move. Every partition rounds its own documents and leaves
    at most one fractional residual per source; residuals are combined by trees of ``FAN_IN`` until one per source remains, which is rounded at random.
    """
    sizes = token_sizes(documents, ident, text, source, tokenizer)
    sizes = checkpoint(sizes.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    rates = mixing_rates(sizes, source, targets, total_tokens).select(source, "rate", "max_repeats")
    rated = checkpoint(join_dimension(sizes, rates, [source], "left").select(F.col("row").alias("id"), F.col(ident).alias("doc"), F.col(source).alias("source"), "tokens", "part", F.coalesce("rate", F.lit(0.0)).alias("rate")))
    whole = F.floor(F.col("rate") + 1e-9).cast("int")
    rest = F.col("rate") - whole
    fractional = rated.where(rest > 1e-9).select("id", "source", F.col("tokens").alias("weight"), rest.alias("share"), F.col("part").cast("bigint").alias("node"))
    ddl = "id bigint, source string, weight bigint, share double, node bigint, bit int"

    def level(number: int):
        def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # state per (node, source): at most one residual each
            held: dict[tuple[int, str], tuple[int, int, float]] = {}
            for b in batches:
                groups: dict[tuple[int, str], tuple[list, list, list]] = {}
                out: list[tuple] = []
                columns = [b.column(k).to_pylist() for k in range(5)]
                for i, s, w, p, node, chance in zip(*columns, _chances(seed, columns[0])):
                    if w <= 0:  # no mass to keep
                        out.append((i, s, w, p, node, int(chance < p)))
                        continue
                    g = groups.get((node, s))
                    if g is None:
                        g = groups[node, s] = ([], [], [])
                        if (node, s) in held:
                            for x, y in zip(g, held.pop((node, s))):
                                x.append(y)
                    g[0].append(i)
                    g[1].append(w)
                    g[2].append(p)
                for (node, s), (ids, ws, ps) in groups.items():
                    decided, left = pivotal(ids, ws, ps, seed + number)
                    out += [(i, s, 0, 0.0, node, bit) for i, bit in decided]
                    if left is not None:
                        held[node, s] = left
                yield batch(out)
            yield batch([(i, s, w, p, node, None) for (node, s), (i, w, p) in held.items()])

        return combine

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows)) or [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(c, kinds)], ["id", "source", "weight", "share", "node", "bit"])

    done: list[DataFrame] = []
    number = 0
    parts = fractional
    while True:
        rounded = checkpoint(parts.mapInArrow(level(number), ddl))
        done.append(rounded.where("bit is not null").select("id", "bit"))
        left = rounded.where("bit is null").drop("bit")
        most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            # the last residual of each source
            draw = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)) < F.col("share")
            done.append(left.select("id", draw.cast("int").alias("bit")))
            break
        number += 1
        node = F.floor(F.col("node") / FAN_IN)
        order = left.select("id", "source", "weight", "share", node.alias("node"))
        parts = order.repartition("node", "source").sortWithinPartitions("node", "source", "id")
    bits = reduce(DataFrame.unionByName, done).groupBy("id").agg(F.sum("bit").alias("bit"))
    out = rated.join(bits, "id", "left")
    copies = (whole + F.coalesce(F.col("bit"), F.lit(0))).cast("int")
    return out.select(F.col("doc").alias(ident), F.col("source").alias(source), "tokens", copies.alias("copies"))


def mixing_report(mixed: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """One row per source of the targets or of the corpus: target_share, documents, tokens, used_tokens, most_copies, actual_share."""
    used = mixed.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    total = used.agg(F.sum("used_tokens").alias("total"))
    t = targets.select(F.col(f"`{source}`").alias("__source"), "target_share", "max_repeats")
    both = used.join(t, used[source] == F.col("__source"), "full").crossJoin(F.broadcast(total))
    return both.select(
        F.coalesce(F.col(source), F.col("__source")).alias(source), "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "used_tokens", "most_copies")),
        F.when(F.col("total") > 0, F.coalesce("used_tokens", F.lit(0)) / F.col("total")).otherwise(0.0).alias("actual_share"),
    )
