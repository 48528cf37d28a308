"""Documents that read identically though they are stored in different characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.text_form import transducer
from tidewheel.session import checkpoint, ship


def consistent_texts(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """Columns ident, form (the consistent form of the whole text), n_changed (clusters stored otherwise). Null texts stay null, empty ones empty."""
    ship(documents.sparkSession)

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer()
        for b in batches:
            texts = b.column(1).to_pylist()
            done = [None if x is None else t.form(x) for x in texts]
            changed = [None if x is None else 0 if x == y else t.changes(x) for x, y in zip(texts, done)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string()), pa.array(changed, pa.int64())], [ident, "form", "n_changed"])

    picked = documents.select(F.col(f"`{ident}`").cast("bigint").alias(ident), F.col(f"`{text}`").cast("string").alias("text"))
    return picked.mapInArrow(forms, f"`{ident}` bigint, form string, n_changed bigint")


def reading_keys(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """Columns ident, form_key, text_key: 128-bit hashes of a document's consistent form and of its text as stored. Null texts give no row."""
    ship(documents.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer()
        digest = xxhash.xxh3_128_digest
        for b in batches:
            raw, form = [], []
            for x in b.column(1).to_pylist():
                stored = x.encode()
                raw.append(digest(stored))
                y = t.form(x)
                form.append(raw[-1] if y is x or y == x else digest(y.encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], [ident, "form_key", "text_key"])

    picked = documents.select(F.col(f"`{ident}`").cast("bigint").alias(ident), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    return picked.mapInArrow(keys, f"`{ident}` bigint, form_key binary, text_key binary")


def reading_classes(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """One row per document with a text: ident, class (least id that reads the same), n_alike (documents of the class), n_stored (different texts).

    An empty table gives no rows; a repeated id counts as often as it occurs. The shuffle holds two 16-byte keys per document, combined on the map side.
    """
    members = checkpoint(reading_keys(documents, ident, text))
    stored = members.groupBy("form_key", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("least"))
    classes = stored.groupBy("form_key").agg(F.min("least").alias("class"), F.sum("n").alias("n_alike"), F.count(F.lit(1)).alias("n_stored"))
    return members.join(classes, "form_key").select(ident, "class", "n_alike", "n_stored")


def same_reading_pairs(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """Pairs (doc_id_a < doc_id_b) of documents with the same consistent form and different stored texts.

    Exact copies are no pairs with each other, so a class is paired by stored text first and each pair of stored texts is then expanded to the documents
    that hold them; the work beyond hashing grows with the pairs that come out, which for k copies of one stored text and m of another are k x m
    (``reading_classes`` has one row per document instead). Documents whose class has one stored text are dropped before any join, so one boilerplate text
    on a third of all documents takes no part. Null texts take no part; an empty table gives no rows.
    """
    members = checkpoint(reading_keys(documents, ident, text))
    stored = members.groupBy("form_key", "text_key").agg(F.count(F.lit(1)).alias("n"))
    several = stored.groupBy("form_key").agg(F.count(F.lit(1)).alias("n_stored")).where("n_stored > 1").select("form_key")
    inside = checkpoint(members.join(several, "form_key", "left_semi").select(F.col(ident).alias("id"), "form_key", "text_key"))
    texts = inside.select("form_key", "text_key").distinct()
    pairs = texts.withColumnRenamed("text_key", "key_a").join(texts.withColumnRenamed("text_key", "key_b"), "form_key").where("key_a < key_b").drop("form_key")
    found = pairs.join(inside.select(F.col("text_key").alias("key_a"), F.col("id").alias("a")), "key_a").join(inside.select(F.col("text_key").alias("key_b"), F.col("id").alias("b")), "key_b")
    return found.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()
