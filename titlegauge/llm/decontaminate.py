"""Benchmark items inside documents: size-partitioned MinHash containment search.

Containment of an item is the share of its word shingles that a document holds. Items are
partitioned by the size of their shingle sets (ranges that double). Each partition has its own
sketch size, taken from its largest size: ``floor((1 - threshold) * largest) + 1`` minimum hashes.
An item of at least the threshold misses fewer shingles than that, so one of its minimum hashes is
in the document: the search has no false negatives, however long the document is, where a MinHash
of the long document would almost never agree with that of a short item. Documents that hold a
sketch member are verified on the item's full set.

A word is a run of bytes that are neither white space nor ASCII punctuation, A-Z in lower case. An
item with fewer than ``words`` words is one shingle of its own length.

Scale: there is one path, whatever the number of items. Documents are read once; of their shingles only
those leave the task that a filter of ``FILTER_BITS`` bits lets through (the same size for any items:
where they are many it passes more, never less). The rest is joins: document shingles meet sketch
members, the distinct candidate pairs meet the item's full set, and what the document holds of it is
counted. A shingle that many items share is looked up only where it is a sketch member.

Cases: null or empty texts hold nothing and are in nothing; items without an id are reported
under null; repeated documents or items give one row per pair of ids; texts that share an id are
searched apart, and of several pairs of the same ids the one of the largest containment is given (ties:
the larger item, then more shared shingles); extra columns are not read; an empty table on either side
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlegauge.llm.common import id_and_text, map_steps, record_batch, written
from titlegauge.llm.textwords import WHITE_SPACE_OR_PUNCTUATION, distinct, find_words, row_sums, shingles

WORDS = 5
THRESHOLD = 0.8
#: Bits of the filter that every task gets (4 MB).
FILTER_BITS = 1 << 25
#: A text is told by its id and 64 bits of the text; a null id equals itself inside a struct.
DOC, ITEM = ("doc_id", "doc_variant"), ("item_id", "variant", "length", "n")


def _item_sets(items: DataFrame, words: int) -> DataFrame:
    """(item_id, variant, length, n, hash): every shingle of every item, with its length in words."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find_words(batch.column("text"), WHITE_SPACE_OR_PUNCTUATION)
        # An item's shingles have `words` words, or all of its fewer words.
        own_length, word_hash = np.minimum(found.counts, words), found.hashes()
        parts = [shingles(found.row, found.first, word_hash, k, short=False) for k in range(1, words + 1)]
        parts = [(r[own_length[r] == k], h[own_length[r] == k]) for k, (r, h) in enumerate(parts, 1)]
        rows, hashes = distinct(*map(np.concatenate, zip(*parts, strict=True)))
        size = np.bincount(rows, minlength=batch.num_rows)
        # Items that share an id but not the text stay apart.
        ids = batch.column("doc_id").take(pa.array(rows))
        return record_batch(
            item_id=ids,
            variant=row_sums(rows, hashes, batch.num_rows)[rows].view(np.int64),
            length=own_length[rows].astype(np.int32),
            n=size[rows].astype(np.int64),
            hash=hashes.view(np.int64),
        )

    return map_steps(items, step, "item_id long, variant long, length int, n long, hash long").distinct()


def _sketch_size(n: Column, threshold: float) -> Column:
    """Minimum hashes of an item of ``n`` shingles: enough for the largest size of its partition."""
    bits = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    largest = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    return F.least(n, F.floor(F.lit(1 - threshold) * largest + 1e-9) + 1)


def _sketches(sets: DataFrame, threshold: float) -> DataFrame:
    """(length, hash, item): the minimum hashes of every item."""
    place = F.row_number().over(Window.partitionBy("item").orderBy("hash"))
    least = _sketch_size(F.col("n"), threshold)
    return sets.withColumn("place", place).filter(F.col("place") <= least).select("length", "hash", "item")


def _filter_words(sets: DataFrame) -> np.ndarray:
    """The filter as 64-bit words: the bit at (hash modulo ``FILTER_BITS``) of every item shingle."""
    at = F.pmod("hash", F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    words = sets.groupBy((at / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _document_shingles(docs: DataFrame, words: int, passing: np.ndarray) -> DataFrame:
    """(doc_id, doc_variant, length, hash): distinct shingles of every length that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(passing)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find_words(batch.column("text"), WHITE_SPACE_OR_PUNCTUATION)
        word_hash, bits = found.hashes(), shared.value
        parts = []
        for k in range(1, words + 1):
            rows, hashes = shingles(found.row, found.first, word_hash, k, short=False)
            at = hashes.view(np.int64) % FILTER_BITS
            hit = (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            rows, hashes = distinct(rows[hit], hashes[hit])
            parts.append((rows, np.full(len(rows), k, np.int32), hashes.view(np.int64)))
        rows, length, hashes = map(np.concatenate, zip(*parts, strict=True))
        taken = pa.array(rows)
        return record_batch(
            doc_id=batch.column("doc_id").take(taken), doc_variant=batch.column("doc_variant").take(taken),
            length=length, hash=hashes,
        )

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("doc_variant"))
    return map_steps(texts, step, "doc_id long, doc_variant long, length int, hash long")


def contaminated_pairs(
    docs: DataFrame,
    items: DataFrame,
    words: int = WORDS,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_item (its shingles), n_shared, containment of each pair at the threshold."""
    docs = id_and_text(docs, id_col, text_col)
    sets = written(
        _item_sets(id_and_text(items, item_id_col, item_text_col), words).select("length", "hash", "n", F.struct(*ITEM).alias("item"))
    )
    sketches = written(_sketches(sets, threshold))
    held = written(
        _document_shingles(docs, words, _filter_words(sets)).select(F.struct(*DOC).alias("doc"), "length", "hash").distinct()
    )
    candidates = held.join(sketches, ["length", "hash"]).select("doc", "item").distinct()
    pairs = (
        candidates.join(sets.select("item", "length", "hash"), "item")
        .join(held, ["doc", "length", "hash"], "left_semi")
        .groupBy("doc", "item")
        .agg(F.count("*").alias("n_shared"))
        .select("doc.doc_id", "item.item_id", F.col("item.n").alias("n_item"), "n_shared")
        .filter(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)
    )
    best = pairs.groupBy("doc_id", "item_id").agg(
        F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("best")
    )
    return best.select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")


ORACLE = r"""
WITH parts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+') AS w FROM parts),
sets AS (
  SELECT side, id, unnest(CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(
    [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, len(w) - 3)]) END) AS s
  FROM words),
items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM sets WHERE side = 'i')
SELECT d.id AS doc_id, item_id, n_item, count(*) AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM sets d JOIN items i ON d.s = i.s WHERE d.side = 'd'
GROUP BY 1, 2, 3 HAVING count(*) >= 0.8 * n_item
"""
