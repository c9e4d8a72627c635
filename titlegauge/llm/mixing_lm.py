"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its bytes, A-Z in lower case, and one end symbol. Each byte is predicted bit by bit. Six
predictors hold, for a hash of a context and the bits so far, how often the next bit was 0 and 1 in
the training texts; the contexts are the last 1 to 5 bytes, and those of the five since white space.
Their log-odds are mixed with weights that two gates choose: the longest known context with its
confidence and the bit's place, and the last byte. The mixed probability is refined by a table over
(bits so far, mixed log-odds) that adapts to what occurred, and averaged with it. The sum of log10
probabilities is the score.

Training, on all training texts:
1. every byte with its context of five bytes is a gram; grams are counted over the corpus (the table
   grows with the corpus, and each distinct gram is worked on once from here on);
2. the grams' bits are summed into the predictors' hashed counters;
3. the weights learn online: grams pass in batches, each batch is predicted, then moves the weights
   by the gradient of its coding cost. An occurrence never sees itself in the counters. Tasks' weights are
   averaged by the text they saw;
4. the refining table is counted with the averaged weights.

The counters' slots grow with the distinct grams up to 62 MB in all, which bounds what is broadcast;
beyond that more contexts share a slot, and no count is dropped. Scoring handles each distinct gram of a batch once.

The token baseline needs the counts of all words: words of at least a power of two occurrences, at
most ``HOT_WORDS``, are sent to every task; the others are joined, so no frequent word is a hot key.

Cases: null text counts as empty (one end token); rows without an id are training rows; repeated
rows count each time; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.llm.common import crc_remainder, id_and_text, record_batch, text_steps, written
from titlegauge.llm.textwords import byte_class, find_words, mixed, utf8

ORDERS = 6
#: Slots of each predictor per distinct gram of the corpus, and at most (in bits; 4 bytes a slot).
SLOTS_PER_GRAM = (1.0, 0.0, 0.1, 0.5, 1.5, 4.0)
MOST_BITS = (21, 16, 20, 22, 22, 22)
SLOT_BLOCK = 1 << 12
START, END = 2, 3
#: Names the end token among word hashes.
END_WORD = np.int64(0x0E0D)
HOT_WORDS = 1 << 18
#: Text bytes of one scoring step; more text means fewer distinct grams per byte.
STEP_BYTES = 3 << 20
#: Distinct grams that are predicted at once.
SCORED_GRAMS = 50_000
#: Distinct keys that a counting task holds before it hands them on.
HELD_KEYS = 1_000_000
GATES = (ORDERS * 4 * 8, 256)
LOGIT_LIMIT = 8.0
REFINE_STEPS = 33
REFINE_PRIOR = 20.0
LEARN_BATCH = 1_024
HELD_OUT_MODULUS, HELD_OUT = 7, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = byte_class(b" \t\n\x0b\x0c\r" + bytes([START]))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of every byte and end symbol: five bytes of context and the symbol, 48 bits."""
    text, bounds = utf8(column)
    n_rows = len(bounds) - 1
    padded = np.full(len(text) + ORDERS * n_rows, START, np.uint8)
    row = np.repeat(np.arange(n_rows), np.diff(bounds))
    place = np.arange(len(text)) + ORDERS * row + ORDERS - 1
    padded[place] = _LOWER[text]
    ends = bounds[1:] + ORDERS * np.arange(1, n_rows + 1) - 1
    padded[ends] = END
    symbol = np.ones(len(padded), bool)
    begins = ends + 1 - ORDERS - np.diff(bounds)
    for i in range(ORDERS - 1):
        symbol[begins + i] = False
    del row, place
    key = np.zeros(len(padded), np.uint64)
    for back in range(ORDERS):
        byte = padded[: len(padded) - back].astype(np.uint64)
        byte <<= np.uint64(8 * back)
        key[back:] |= byte
        del byte
    key = key[symbol]
    return np.repeat(np.arange(n_rows, dtype=np.int32), np.diff(bounds) + 1), key


def contexts(gram: np.ndarray) -> np.ndarray:
    """The predictors' contexts: the bytes since the last white space, and the last 1 to 5 bytes."""
    out = np.zeros((ORDERS, len(gram)), np.uint64)
    inside = np.ones(len(gram), bool)
    for k in range(1, ORDERS):
        byte = (gram >> np.uint64(8 * k)) & np.uint64(0xFF)
        inside &= ~_BREAK[byte.astype(np.int64)]
        out[0] |= np.where(inside, byte << np.uint64(8 * k), np.uint64(0))
        out[k] = (gram >> np.uint64(8)) & np.uint64((1 << (8 * k)) - 1)
    out[0] |= inside.astype(np.uint64) << np.uint64(8 * ORDERS)
    for k in (0, *range(2, ORDERS)):
        out[k] = out[k] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k)
    return out


@dataclass(frozen=True)
class Slots:
    """Where the counters of each predictor lie; the second predictor's are not hashed."""

    bits: tuple[int, ...]

    @classmethod
    def for_grams(cls, n: int) -> Slots:
        wanted = [max(12, ceil(log2(max(1.0, n * share)))) for share in SLOTS_PER_GRAM]
        return cls(tuple(16 if k == 1 else min(w, MOST_BITS[k]) for k, w in enumerate(wanted)))

    @property
    def offsets(self) -> list[int]:
        return np.cumsum([0, *[1 << b for b in self.bits]]).tolist()

    def of(self, gram: np.ndarray, context: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """(slots of each predictor, the bits so far as 1..255) for one bit of the grams' symbols."""
        symbol = (gram & np.uint64(0xFF)).astype(np.int64)
        node = (1 << bit) | (symbol >> (8 - bit))
        out, offsets = np.empty((ORDERS, len(gram)), np.int64), self.offsets
        out[1] = offsets[1] + context[1].astype(np.int64) * 256 + node
        spread = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in (0, *range(2, ORDERS)):
            h = context[k] ^ spread
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[k] = offsets[k] + (h >> np.uint64(64 - self.bits[k])).astype(np.int64)
        return out, node


def bit_of(gram: np.ndarray, bit: int) -> np.ndarray:
    return ((gram >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)


@dataclass
class Mixer:
    """Counters, weights per gate, and the refining table (probabilities by bits so far and log-odds)."""

    slots: Slots
    counters: np.ndarray
    weights: list[np.ndarray]
    refined: np.ndarray | None = None

    def inputs(self, gram: np.ndarray, context: np.ndarray, bit: int, without_self: bool) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(log-odds of the predictors and a constant, gate numbers, bits so far)."""
        slots, node = self.slots.of(gram, context, bit)
        both = self.counters[slots]
        zeros, ones = (both & np.uint32(0xFFFF)).astype(np.float32), (both >> np.uint32(16)).astype(np.float32)
        if without_self:
            one = bit_of(gram, bit)
            ones = np.maximum(ones - one, 0)
            zeros = np.maximum(zeros - ~one, 0)
        total = zeros + ones
        x = np.empty((ORDERS + 1, len(gram)), np.float32)
        x[:ORDERS] = np.log((ones + 0.4) / (zeros + 0.4))
        x[ORDERS] = 0.3
        longest = np.ones(len(gram), np.int64)
        seen = total[1]
        for k in range(2, ORDERS):
            known = total[k] > 0
            longest = np.where(known, k, longest)
            seen = np.where(known, total[k], seen)
        sure = np.minimum(np.log2(np.maximum(seen, 1)).astype(np.int64) // 2, 3)
        last = ((gram >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
        return x, [(longest * 4 + sure) * 8 + bit, last], node

    def logits(self, x: np.ndarray, gates: list[np.ndarray]) -> np.ndarray:
        weight = self.weights[0][gates[0]] + self.weights[1][gates[1]]
        return np.clip(np.einsum("nk,kn->n", weight, x), -LOGIT_LIMIT, LOGIT_LIMIT)

    def learn(self, gram: np.ndarray, count: np.ndarray, rate: float) -> None:
        """One online step on a batch of grams: predict each bit, then follow the gradient."""
        share = (count / count.sum()).astype(np.float32)
        context = contexts(gram)
        for bit in range(8):
            x, gates, _ = self.inputs(gram, context, bit, without_self=True)
            error = bit_of(gram, bit) - 1 / (1 + np.exp(-self.logits(x, gates)))
            push = (x * (error * share)).T
            for weights, gate in zip(self.weights, gates, strict=True):
                total = np.bincount(gate, weights=share, minlength=len(weights))
                for k in range(ORDERS + 1):
                    step = np.bincount(gate, weights=push[:, k], minlength=len(weights))
                    # Each gate moves by the mean gradient of its own part, less if that is small.
                    weights[:, k] += rate * step / (total + 0.002)

    def refine_places(self, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (logit + LOGIT_LIMIT) * ((REFINE_STEPS - 1) / (2 * LOGIT_LIMIT))
        low = np.minimum(at.astype(np.int64), REFINE_STEPS - 2)
        return low, at - low

    def log2_probability(self, gram: np.ndarray) -> np.ndarray:
        """log2 of the model's probability of each gram's symbol after its context."""
        out, context = np.zeros(len(gram)), contexts(gram)
        for bit in range(8):
            x, gates, node = self.inputs(gram, context, bit, without_self=False)
            logit = self.logits(x, gates)
            p = 1 / (1 + np.exp(-logit))
            if self.refined is not None:
                low, part = self.refine_places(logit)
                p = 0.5 * p + 0.5 * ((1 - part) * self.refined[node, low] + part * self.refined[node, low + 1])
            out += np.log2(np.where(bit_of(gram, bit), p, 1 - p))
        return out


def _first_weights() -> list[np.ndarray]:
    return [np.full((GATES[0], ORDERS + 1), 0.3, np.float32), np.zeros((GATES[1], ORDERS + 1), np.float32)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def count_corpus(training: DataFrame) -> DataFrame:
    """(is_gram, key, n): all words (by hash, with the end token) and all grams of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}

        def merged(is_gram: bool) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = _summed(*map(np.concatenate, zip(*held[is_gram], strict=True)))
            held[is_gram] = [(keys, counts)]
            return keys, counts

        def row(is_gram: bool) -> pa.RecordBatch:
            keys, counts = merged(is_gram)
            held[is_gram] = []
            return record_batch(is_gram=np.full(len(keys), is_gram), key=keys.view(np.int64), n=counts.astype(np.int64))

        for batch in text_steps(batches, STEP_BYTES):
            column = batch.column("text")
            held[True].append(_distinct(grams(column)[1]))
            keys, counts = _distinct(find_words(column).hashes())
            end = np.array([END_WORD], np.int64).view(np.uint64)
            held[False].append((np.append(keys, end), np.append(counts, batch.num_rows)))
            for is_gram in (True, False):
                if sum(len(k) for k, _ in held[is_gram]) > HELD_KEYS:
                    keys, _ = merged(is_gram)
                    if len(keys) > HELD_KEYS // 2:
                        yield row(is_gram)
        for is_gram in (True, False):
            if held[is_gram]:
                yield row(is_gram)

    counted = training.select("text").mapInArrow(run, "is_gram boolean, key long, n long")
    # In random order: the weights learn from the rows as they come.
    return counted.groupBy("is_gram", "key").agg(F.sum("n").alias("n")).sortWithinPartitions(
        F.xxhash64("key", F.lit(1))
    )


def _gram_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts in batches of ``size``, in an order unrelated to the grams."""
    for batch in batches:
        gram = batch.column("key").to_numpy().view(np.uint64)
        count = batch.column("n").to_numpy()
        order = np.argsort(mixed(gram))
        for a in range(0, len(gram), size):
            part = order[a : a + size]
            yield gram[part], count[part]


def slot_counters(grams_table: DataFrame, layout: Slots) -> np.ndarray:
    """The predictors' counters: for each slot the 0s in the low and the 1s in the high 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, count in _gram_batches(batches, 200_000):
            slots, zeros, ones = [], [], []
            context = contexts(gram)
            for bit in range(8):
                place, _ = layout.of(gram, context, bit)
                one = np.broadcast_to(bit_of(gram, bit), place.shape).ravel()
                weight = np.broadcast_to(count, place.shape).ravel()
                place = place.ravel()
                order = np.argsort(place, kind="stable")
                place, one, weight = place[order], one[order], weight[order]
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                slots.append(place[first])
                ones.append(np.add.reduceat(weight * one, first))
                zeros.append(np.add.reduceat(weight * ~one, first))
            yield record_batch(slot=np.concatenate(slots), zeros=np.concatenate(zeros), ones=np.concatenate(ones))

    def pack(rows: pa.Table) -> pa.Table:
        pair = np.stack([rows.column("zeros").to_numpy(), rows.column("ones").to_numpy()])
        # Large counts are halved until both fit 16 bits, never to nothing.
        scale = np.maximum(pair.max(axis=0) / 65_535, 1)
        pair = np.where(pair > 0, np.maximum(pair / scale, 1), 0).astype(np.uint32)
        out = np.zeros(SLOT_BLOCK, np.uint32)
        slot = rows.column("slot").to_numpy()
        out[slot % SLOT_BLOCK] = pair[0] | (pair[1] << np.uint32(16))
        return pa.table({"block": [int(slot[0]) // SLOT_BLOCK], "packed": [out.tobytes()]})

    # Equal contexts of two bytes meet in one task, so a longer context's slots come from one task.
    together = grams_table.repartition(F.shiftright("key", 8).bitwiseAND(0xFFFF))
    summed = (
        together.mapInArrow(run, "slot long, zeros long, ones long")
        .groupBy("slot")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    )
    packed = (
        summed.withColumn("block", F.floor(F.col("slot") / SLOT_BLOCK))
        .groupBy("block")
        .applyInArrow(pack, "block long, packed binary")
    )
    counters = np.zeros(layout.offsets[-1], np.uint32)  # at most the sum of 2 ** MOST_BITS
    for row in written(packed).toLocalIterator():
        begin = row["block"] * SLOT_BLOCK
        counters[begin : begin + SLOT_BLOCK] = np.frombuffer(row["packed"], np.uint32)
    return counters


def learn_weights(grams_table: DataFrame, layout: Slots, counters) -> list[np.ndarray]:
    """Weights from one online pass in each task, averaged by the symbols the tasks saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, symbols, step = Mixer(layout, counters.value, _first_weights()), 0, 0
        for gram, count in _gram_batches(batches, LEARN_BATCH):
            mixer.learn(gram, count, rate=0.05 / (1 + step / 100))
            symbols, step = symbols + int(count.sum()), step + 1
        if symbols:
            flat = np.concatenate([w.ravel() for w in mixer.weights]).astype(np.float64) * symbols
            yield record_batch(symbols=pa.array([symbols], pa.int64()), weights=pa.array([flat], pa.list_(pa.float64())))

    parts = grams_table.mapInArrow(run, "symbols long, weights array<double>")
    flat = parts.select("symbols", F.posexplode("weights").alias("place", "weight")).groupBy("place").agg(
        (F.sum("weight") / F.sum("symbols")).alias("weight")
    )
    weights = _first_weights()
    ends = np.cumsum([w.size for w in weights])
    for row in flat.collect():  # one number per weight
        which = int(np.searchsorted(ends, row["place"], side="right"))
        weights[which].ravel()[row["place"] - (ends[which - 1] if which else 0)] = row["weight"]
    return weights


def learn_refinement(grams_table: DataFrame, layout: Slots, counters, weights: list[np.ndarray]) -> np.ndarray:
    """How often the next bit was 1, by bits so far and mixed log-odds (shared between two steps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(layout, counters.value, weights)
        totals = np.zeros((2, 256 * REFINE_STEPS))
        for gram, count in _gram_batches(batches, 100_000):
            context = contexts(gram)
            for bit in range(8):
                x, gates, node = mixer.inputs(gram, context, bit, without_self=True)
                low, part = mixer.refine_places(mixer.logits(x, gates))
                one = bit_of(gram, bit)
                for place, share in ((low, 1 - part), (low + 1, part)):
                    at = node * REFINE_STEPS + place
                    totals[0] += np.bincount(at, weights=share * count * one, minlength=totals.shape[1])
                    totals[1] += np.bincount(at, weights=share * count, minlength=totals.shape[1])
        at = np.flatnonzero(totals[1])
        yield record_batch(at=at, ones=totals[0][at], n=totals[1][at])

    counted = grams_table.mapInArrow(run, "at long, ones double, n double").groupBy("at").agg(
        F.sum("ones").alias("ones"), F.sum("n").alias("n")
    )
    steps = np.linspace(-LOGIT_LIMIT, LOGIT_LIMIT, REFINE_STEPS)
    prior = np.tile(1 / (1 + np.exp(-steps)), 256)
    ones, n = prior * REFINE_PRIOR, np.full(len(prior), REFINE_PRIOR)
    for row in counted.collect():  # at most 256 * REFINE_STEPS rows
        ones[row["at"]] += row["ones"]
        n[row["at"]] += row["n"]
    return np.clip(ones / n, 1e-5, 1 - 1e-5).reshape(256, REFINE_STEPS)


def _hot_words(words: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(least count, hashes, counts) of the words of at least a power of two occurrences, as many as may be."""
    powers = [1 << i for i in range(63)]
    sizes = words.agg(*[F.count(F.when(F.col("n") >= p, 1)).alias(f"p{i}") for i, p in enumerate(powers)]).first()
    least = next(p for i, p in enumerate(powers) if sizes[f"p{i}"] <= HOT_WORDS)
    rows = words.filter(F.col("n") >= least).select("key", "n").collect()  # at most HOT_WORDS
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return least, keys[order], np.array([r["n"] for r in rows], np.int64)[order]


def _score_texts(docs: DataFrame, model, hot) -> DataFrame:
    """Per row: score, n_tokens, and what the hot words give; the other words with their times."""

    def rest_words(words, which, keys):
        """Words of each row that are not hot, as (offsets, hashes, times)."""
        row, key = words.row[~which], keys[~which]
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]) if len(row) else row
        times = np.diff(np.append(first, len(row)))
        cut = np.searchsorted(row[first], np.arange(len(words.first)))
        return cut, key[first], times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, (hot_keys, hot_counts) = model(), hot.value
        end_key = np.array([END_WORD], np.int64).view(np.uint64)[0]
        for batch in text_steps(batches, STEP_BYTES):
            column, n_rows = batch.column("text"), batch.num_rows
            row, gram = grams(column)
            sums = np.zeros(n_rows)
            for begin in range(0, n_rows, 1 << 16):  # row numbers share a key with the gram
                part = (row >= begin) & (row < begin + (1 << 16)) if n_rows > 1 << 16 else slice(None)
                both = gram[part] << np.uint64(16)
                both |= (row[part] - begin).astype(np.uint64)
                if n_rows <= 1 << 16:
                    del row, gram  # one part is all
                both.sort()
                # Where the gram changes: some bit above the row's differs.
                first = np.flatnonzero(np.r_[True, (both[1:] ^ both[:-1]) >= np.uint64(1 << 16)])
                cost = np.empty(len(first))
                for a in range(0, len(first), SCORED_GRAMS):
                    name = both[first[a : a + SCORED_GRAMS]] >> np.uint64(16)
                    cost[a : a + SCORED_GRAMS] = mixer.log2_probability(name)
                each = np.repeat(cost, np.diff(np.append(first, len(both))))
                both &= np.uint64(0xFFFF)
                some = np.bincount(both.view(np.int64), weights=each)
                sums[begin : begin + len(some)] += some
                del both, each, first, cost
            words = find_words(column)
            keys = words.hashes()
            at = np.minimum(np.searchsorted(hot_keys, keys), max(len(hot_keys) - 1, 0))
            which = hot_keys[at] == keys if len(hot_keys) else np.zeros(len(keys), bool)
            logs = np.log10(hot_counts[at[which]] + 1.0) if len(hot_keys) else np.zeros(0)
            end_at = np.searchsorted(hot_keys, end_key)
            end_hot = end_at < len(hot_keys) and hot_keys[end_at] == end_key
            end_log = np.log10(hot_counts[end_at] + 1.0) if end_hot else 0.0
            cut, rest, times = rest_words(words, which, keys)
            yield record_batch(
                doc_id=batch.column("doc_id"), score=sums * np.log10(2.0), n_tokens=words.counts.astype(np.int64) + 1,
                hot_known=np.bincount(words.row[which], minlength=n_rows).astype(np.int64) + int(end_hot),
                hot_log=np.bincount(words.row[which], weights=logs, minlength=n_rows) + end_log,
                rest=pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(rest.view(np.int64))),
                times=pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(times.astype(np.int64))),
            )

    return docs.mapInArrow(
        run,
        "doc_id long, score double, n_tokens long, hot_known long, hot_log double, rest array<long>, times array<long>",
    )


def score_language(docs: DataFrame, training=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10).

    ``training``: condition on ``doc_id`` that says which texts are learned from (all by default).
    """
    docs = id_and_text(docs, id_col, text_col)
    counts = written(count_corpus(docs.filter(F.lit(True) if training is None else training)))
    words = counts.filter("not is_gram")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    grams_table = counts.filter("is_gram").select("key", "n")
    context = docs.sparkSession.sparkContext
    layout = Slots.for_grams(grams_table.count())
    counters = context.broadcast(slot_counters(grams_table, layout))
    weights = learn_weights(grams_table, layout, counters)
    refined = learn_refinement(grams_table, layout, counters, weights)
    least, hot_keys, hot_counts = _hot_words(words)
    hot = context.broadcast((hot_keys, hot_counts))

    def model() -> Mixer:
        return Mixer(layout, counters.value, weights, refined)

    scored = written(_score_texts(docs, model, hot).withColumn("row", F.monotonically_increasing_id()))
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w")).select(
        "row", F.col("w.rest").alias("key"), F.col("w.times").alias("times")
    )
    rare = words.filter(F.col("n") < least).select("key", "n")
    known = (
        rest.join(rare, "key")
        .groupBy("row")
        .agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("log"))
    )
    joined = scored.join(known, "row", "left")
    base = F.col("hot_log") + F.coalesce("log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return joined.select(
        "doc_id", "n_tokens", (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def contract_scores(docs: DataFrame) -> DataFrame:
    held_out = crc_remainder(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT
    scored = score_language(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
