"""Quality rules from tokeniser fertility, with rejection bands per language or script.

A public vocabulary (a sentence-piece BPE with byte fallback) encodes each word by itself, so equal
words are encoded once per batch. Per document: characters per token, share of byte-fallback tokens,
and token entropy as a share of the largest possible for its number of tokens.

Bands are fitted on all documents of a language (of a script where the language is null) and a size
class (tokens, doubling), around the median in units of the spread between the quartiles, which is at
least ``LEAST_SPREAD``. Classes of fewer than ``LEAST_GROUP`` documents use the bands of the whole
language, and those of few documents the bands of all. A document is rejected if a measure is more
than ``WIDTH`` units off, or if characters per token and entropy are both ``CORNER`` units low: text
broken up by symbols takes more tokens per character, and few different ones.

Words are runs without ASCII white space, case kept. Base rules: too few words, or too many words
inside 5-word windows that occur twice or more.

Cases: null or empty text has no words and fails; very long texts are one step each; repeated rows
give repeated results; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.llm.common import map_steps, record_batch, written
from titlegauge.llm.textwords import Words, byte_class, find_words, shingle_starts, shingles

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = byte_class(b"#*$%&|<>")
LINE_BREAK = byte_class(b"\n")
WIDTH = 5.0
CORNER = 1.2
LEAST_GROUP = 40
#: Rows of bands (a name and six numbers each) that are sent to every task at most.
BAND_ROWS = 20_000
#: Smallest spread of each measure that a band assumes.
LEAST_SPREAD = {"chars_per_token": 0.02, "byte_share": 0.01, "entropy": 0.01}
MEASURES = tuple(LEAST_SPREAD)
_VOCABULARY_BYTES = 64 << 20


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(_VOCABULARY_BYTES + 1)
    if len(data) > _VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to send to every task")
    return data


_loaded: dict[int, tuple] = {}


def _encoder(model: bytes):
    """The processor of this Python worker, and which of its ids stand for single bytes."""
    key = hash(model)
    if key not in _loaded:
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_proto=model)
        is_byte = np.array([processor.is_byte(i) for i in range(processor.get_piece_size())])
        _loaded[key] = processor, is_byte
    return _loaded[key]


def _row_counts(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many bytes of each row a mask marks."""
    total = np.append(0, np.cumsum(mask))
    return total[bounds[1:]] - total[bounds[:-1]]


def duplicate_lines(column: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    lines = find_words(column, LINE_BREAK, lower=False)
    solid = np.append(0, np.cumsum(~byte_class(b" \t\n\x0b\x0c\r")[lines.text]))
    worded = solid[lines.end] > solid[lines.start]
    rows, hashes = lines.row[worded], lines.hashes()[worded]
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    again = (rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])
    return np.bincount(rows[1:][again], minlength=len(column))


def repeated_words(words: Words, word_hash: np.ndarray) -> np.ndarray:
    """Words of each row inside windows of ``WINDOW`` words that the row holds twice or more."""
    rows, hashes = shingles(words.row, words.first, word_hash, WINDOW, short=False)
    starts = shingle_starts(words.row, WINDOW)
    order = np.lexsort((hashes, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    twice = np.zeros(len(rows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.row) + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(words.row[covered], minlength=len(words.first) - 1)


def _token_measures(words: Words, word_hash: np.ndarray, model: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte-fallback tokens and relative entropy of each row."""
    n_rows = len(words.first) - 1
    processor, is_byte = _encoder(model)
    _, sample, which = np.unique(word_hash, return_index=True, return_inverse=True)
    text = words.text
    spelled = [text[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(words.start[sample], words.end[sample], strict=True)]
    encoded = processor.encode(spelled, num_threads=1) if spelled else []
    sizes = np.array([len(e) for e in encoded], np.int64)
    flat = np.array([i for e in encoded for i in e], np.int64)
    first = np.append(0, np.cumsum(sizes))
    of_word = sizes[which] if len(sizes) else np.zeros(0, np.int64)
    n_tokens = np.bincount(words.row, weights=of_word, minlength=n_rows).astype(np.int64)
    # Tokens of all words in order: positions first[w] .. first[w] + size[w] of the distinct words'.
    total = int(of_word.sum())
    ahead = np.append(0, np.cumsum(of_word))[:-1]
    at = np.arange(total) - np.repeat(ahead, of_word) + np.repeat(first[which] if len(which) else which, of_word)
    tokens = flat[at]
    rows = np.repeat(words.row, of_word)
    n_bytes = np.bincount(rows[is_byte[tokens]], minlength=n_rows)
    keys = np.sort((rows << 20) | tokens)
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if total else np.zeros(0, np.int64)
    times = np.diff(np.append(cut, total))
    weighted = np.bincount(keys[cut] >> 20, weights=times * np.log2(np.maximum(times, 1)), minlength=n_rows)
    n = np.maximum(n_tokens, 2)
    entropy = (np.log2(n) - weighted / n) / np.log2(n)
    return n_tokens, n_bytes, np.where(n_tokens > 1, entropy, 1.0)


def _script(text: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The script of most letters of each row, told from the UTF-8 lead bytes."""
    leads = {
        "latin": byte_class(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)])),
        "cyrillic": byte_class(bytes(range(0xD0, 0xD4))),
        "greek": byte_class(bytes(range(0xCD, 0xD0))),
        "arabic": byte_class(bytes(range(0xD8, 0xDC))),
        "indic": byte_class(b"\xe0"),
        "cjk": byte_class(bytes(range(0xE3, 0xEE))),
    }
    counts = np.stack([_row_counts(mask[text], bounds) for mask in leads.values()])
    names = np.array([*leads, "none"])
    return names[np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), len(leads))].tolist()


def measures(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    plain = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"),
        docs[lang_col].cast("string").alias("lang"),
    )
    model = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        words = find_words(column, lower=False)
        word_hash = words.hashes()
        later = np.append(0, np.cumsum((words.text & 0xC0) == 0x80))
        points = (words.end - words.start) - (later[words.end] - later[words.start])
        word_chars = np.bincount(words.row, weights=points, minlength=batch.num_rows).astype(np.int64)
        n_tokens, n_bytes, entropy = _token_measures(words, word_hash, model.value)
        whole = np.maximum(n_tokens, 1)
        return record_batch(
            doc_id=batch.column("doc_id"), lang=batch.column("lang"),
            script=pa.array(_script(words.text, words.bounds), pa.string()),
            n_words=words.counts.astype(np.int64), word_chars=word_chars,
            n_symbols=_row_counts(SYMBOLS[words.text], words.bounds).astype(np.int64),
            n_dup_lines=duplicate_lines(column).astype(np.int64),
            n_repeat_words=repeated_words(words, word_hash).astype(np.int64),
            n_tokens=n_tokens, chars_per_token=word_chars / whole, byte_share=n_bytes / whole, entropy=entropy,
        )

    return map_steps(
        plain, step,
        "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double",
    )


def _bands(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """For each group of enough documents the middle and spread of each measure."""
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in MEASURES]
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("n"), *quartiles)
    bands = []
    for m in MEASURES:
        spread = F.greatest(F.col(m)[2] - F.col(m)[0], F.lit(LEAST_SPREAD[m]))
        bands.append(F.struct(F.col(m)[1].alias("middle"), spread.alias("spread")).alias(m))
    return grouped.filter((F.col("n") >= LEAST_GROUP) | F.lit(not keys)).select(
        *[F.col(k).alias(f"{prefix}_{k}") for k in keys], F.struct(*bands).alias(prefix)
    )


def _small(bands: DataFrame, most: int = BAND_ROWS) -> DataFrame:
    """The bands as a written table, sent to every task if its rows are few, else joined by shuffle."""
    kept = written(bands)
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept


def quality_by_fertility(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_tokens and the three measures."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    rows = written(
        measures(docs, vocabulary, id_col, text_col, lang_col)
        .withColumn("base_failed", failed)
        .withColumn("group", F.coalesce("lang", F.concat(F.lit("script:"), F.col("script"))))
        .withColumn("size_class", F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))))
    )
    sound = rows.filter("not base_failed")
    fine = _small(_bands(sound, ["group", "size_class"], "fine"))
    coarse = _small(_bands(sound, ["group"], "coarse"))
    overall = _bands(sound, [], "overall").collect()[0]["overall"]  # one row
    joined = (
        rows.join(fine, (rows["group"] == fine["fine_group"]) & (rows["size_class"] == fine["fine_size_class"]), "left")
        .join(coarse, rows["group"] == coarse["coarse_group"], "left")
    )
    off = {}
    for m in MEASURES:
        middle, spread = (
            F.coalesce(F.col(f"fine.{m}.{part}"), F.col(f"coarse.{m}.{part}"), F.lit(overall[m][part]))
            for part in ("middle", "spread")
        )
        off[m] = (F.col(m) - middle) / spread
    outside = (off["chars_per_token"] < -CORNER) & (off["entropy"] < -CORNER)
    for m in MEASURES:
        outside = outside | (F.abs(off[m]) > WIDTH)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).alias("kept"),
        "n_tokens", *MEASURES,
    )
