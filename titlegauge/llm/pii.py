"""Personal data: pattern matches, and spans that a character BiLSTM-CRF adds to them.

The tagger learns from labelled spans: windows of text about ``QUOTA`` pattern matches of each kind and
``QUOTA`` places of texts without a match, drawn from the whole table (smallest md5 of id, text and
place), with digits redrawn and some matches rewritten (another separator, no country prefix), so that
it learns the forms and not the values.

Whole texts are covered: every window of the text that holds a digit or an @ is tagged. A span
without either is none of the four kinds and would be dropped, so other windows cannot add one.
Windows overlap by half. Each is decoded by Viterbi; then, over the whole document, spans of one
kind that overlap are united (a span cut by a window's edge meets its other part there), and of
spans that still overlap the set of greatest total weight (confidence times length) is kept.
Pattern matches always stay; an added span overlaps none of them, reaches ``CONFIDENCE`` and passes the
kind's own test (digits, checksum, parts).

Cases: null or empty text has no spans; very long texts are tagged window by window; repeated rows
give repeated results; extra columns are not read; where no text has a match, nothing can be learned and no span is
returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.llm.char_tagger import PAD, CharTagger, char_classes
from titlegauge.llm.common import id_and_text, map_steps, record_batch, text_steps, texts, written
from titlegauge.llm.pii_spans import (
    CARD_DIGITS,
    KINDS,
    PHONE_DIGITS,
    Span,
    base_spans,
    digits_of,
    ip_holds,
    luhn,
    ordered,
)

WINDOW = 96
STRIDE = 48
#: Characters on each side of a digit or @ that are tagged with it.
CONTEXT = 40
TRAIN_WINDOWS = 1_200
#: Training places of each kind, and of texts without a match.
QUOTA = TRAIN_WINDOWS // (len(KINDS) + 1)
CONFIDENCE = 0.9
TAG_BATCH = 2_048
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,confidence:double>>"


def _windows(n: int, triggers: np.ndarray) -> list[int]:
    """Starts of the windows over a text of ``n`` characters that cover the triggers' context."""
    out: list[int] = []
    low = np.maximum(triggers - CONTEXT, 0)
    high = np.minimum(triggers + CONTEXT + 1, n)
    breaks = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    for a, b in zip(low[breaks], high[np.r_[breaks[1:] - 1, len(high) - 1]], strict=True):
        start = int(a)
        while True:
            out.append(start)
            if start + WINDOW >= b:
                break
            start += STRIDE
    return out


def _cut(classes: np.ndarray, start: int) -> np.ndarray:
    part = classes[start : start + WINDOW]
    return part if len(part) == WINDOW else np.r_[part, np.full(WINDOW - len(part), PAD)]


def _tags(spans: list[Span], start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    for a, b, kind in spans:
        for at in range(max(a, start), min(b, start + WINDOW)):
            out[at - start] = 2 + 2 * KINDS.index(kind) - (at == a or at == start)
    return out


def _variant(rng: np.random.Generator, match: str, kind: str) -> str:
    """Another value of the same form, sometimes in another form."""
    if kind == "phone" and rng.random() < 0.4:
        match = match[match.find(" ") + 1 :] if " " in match else match.lstrip("+")
    if kind in ("phone", "card") and rng.random() < 0.3:
        match = match.replace(" ", rng.choice(["-", ".", "/"]))
    if kind == "card" and rng.random() < 0.3:
        match = digits_of(match)
        match = " ".join(match[i : i + 4] for i in range(0, len(match), 4))
    if kind == "ip":
        return match
    return "".join(str(rng.integers(0, 10)) if "0" <= c <= "9" and rng.random() < 0.7 else c for c in match)


def _training_windows(docs: DataFrame) -> list:
    """(text, spans) about ``QUOTA`` matches of each kind, and about as many digits of texts without a match."""

    def places_of(doc_id: int | None, text: str) -> Iterator[tuple]:
        """(kind, or none, and its order, id, hash of the text, place, text about it, spans in that)."""
        spans = base_spans(text)
        places = {(kind, a - a % 16) for a, _, kind in spans}
        if not spans:
            digit = next((i for i, c in enumerate(text) if "0" <= c <= "9" or c == "@"), None)
            places = {("none", digit)} if digit is not None else set()
        name = hashlib.md5(text.encode()).hexdigest() if places else ""
        for kind, at in places:
            begin, end = max(0, at - WINDOW), at + 2 * WINDOW
            near = [(a - begin, min(b, end) - begin, k) for a, b, k in spans if begin <= a < end]
            order = hashlib.md5(f"{'' if doc_id is None else doc_id}:{name}:{at}".encode()).hexdigest()
            yield kind, order, doc_id, name, at, text[begin:end], near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {kind: [] for kind in (*KINDS, "none")}
        for batch in text_steps(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                for kind, *place in places_of(doc_id, text):
                    held[kind].append(place)
            # Of a task, no more than the quota can be among the smallest of all.
            held = {kind: sorted(h, key=lambda p: (p[0], p[2], p[3]))[:QUOTA] for kind, h in held.items()}
        rows = [(kind, *place[:-1], *([s[i] for s in place[-1]] for i in range(3))) for kind, h in held.items() for place in h]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
        names = ["kind", "order", "doc_id", "name", "at", "text", "starts", "ends", "kinds"]
        yield record_batch(**{n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    schema = "kind string, order string, doc_id long, name string, at long, text string, starts array<int>, ends array<int>, kinds array<string>"
    places = written(docs.select("doc_id", "text").mapInArrow(run, schema))
    out = []
    for kind in (*KINDS, "none"):
        # Rows that tie on all of these are copies of one row.
        out += places.filter(F.col("kind") == kind).orderBy("order", "doc_id", "name", "at").limit(QUOTA).collect()
    return out


def train_tagger(docs: DataFrame, copies: int = 3) -> CharTagger | None:
    """A tagger fitted on the driver to at most ``TRAIN_WINDOWS`` places, each in a few variants."""
    rng = np.random.default_rng(11)
    x, tags, seen = [], [], False
    for row in _training_windows(docs):
        spans = sorted(zip(row["starts"], row["ends"], row["kinds"], strict=True))
        seen = seen or bool(spans)
        for copy in range(copies):
            text, placed, end = "", [], 0
            for a, b, kind in spans:
                if a < end:
                    continue
                text += row["text"][end:a]
                value = _variant(rng, row["text"][a:b], kind) if copy else row["text"][a:b]
                placed.append((len(text), len(text) + len(value), kind))
                text, end = text + value, b
            text += row["text"][end:]
            start = int(rng.integers(0, max(1, len(text) - WINDOW)))
            x.append(_cut(char_classes(text), start))
            tags.append(_tags(placed, start))
    if not seen:
        return None
    tagger = CharTagger(len(KINDS))
    tagger.fit(np.array(x), np.array(tags))
    return tagger


def _plausible(kind: str, match: str) -> bool:
    digits = digits_of(match)
    if kind == "email":
        return "@" in match and "." in match
    if kind == "ip":
        parts = match.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and ip_holds(match)
    if kind == "card":
        return len(digits) in CARD_DIGITS and luhn(digits)
    return len(digits) in PHONE_DIGITS


def window_spans(tags: np.ndarray, sure: np.ndarray, start: int, n: int) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, confidence) in the text of the spans of one decoded window."""
    out, at, size = [], 0, min(WINDOW, n - start)
    while at < size:
        if not tags[at]:
            at += 1
            continue
        kind, end = (tags[at] - 1) // 2, at + 1
        while end < size and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((start + at, start + end, KINDS[kind], float(sure[at:end].mean())))
        at = end
    return out


def reconcile(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Unite overlapping spans of a kind; of the rest keep the set without overlap of most weight."""
    united: list[tuple[int, int, str, float]] = []
    for kind in KINDS:
        last = None
        for a, b, _, c in sorted(s for s in found if s[2] == kind):
            if last and a < last[1]:
                last = (last[0], max(b, last[1]), kind, max(c, last[3]))
            else:
                if last:
                    united.append(last)
                last = (a, b, kind, c)
        if last:
            united.append(last)
    united.sort(key=lambda s: (s[1], s[0]))
    ends = [s[1] for s in united]
    weights, take = [0.0], []
    for i, (a, b, _, c) in enumerate(united):
        before = int(np.searchsorted(ends[:i], a, side="right"))
        with_it = weights[before] + c * (b - a)
        take.append(before if with_it > weights[i] else None)
        weights.append(max(with_it, weights[i]))
    kept, i = [], len(united)
    while i:
        if take[i - 1] is None:
            i -= 1
        else:
            kept.append(united[i - 1])
            i = take[i - 1]
    return kept[::-1]


def _tagged(tagger: CharTagger, batch_texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """Reconciled spans of each text."""
    places: list[tuple[int, int, int]] = []
    rows: list[np.ndarray] = []
    found: list[list] = [[] for _ in batch_texts]

    def flush():
        if rows:
            tags, sure = tagger.decode(np.array(rows))
            for (number, start, n), t, s in zip(places, tags, sure, strict=True):
                found[number] += window_spans(t, s, start, n)
            rows.clear()
            places.clear()

    for number, text in enumerate(batch_texts):
        if not (text and ("@" in text or any(d in text for d in "0123456789"))):
            continue
        classes = char_classes(text)
        triggers = np.flatnonzero(((classes >= 16) & (classes < 26)) | (classes == 32))
        for start in _windows(len(classes), triggers):
            places.append((number, start, len(classes)))
            rows.append(_cut(classes, start))
            if len(rows) == TAG_BATCH:
                flush()
    flush()
    return [reconcile(f) for f in found]


def spans_of(batch_texts: list[str], tagger: CharTagger | None) -> list[list[tuple[int, int, str, bool, float]]]:
    """(start, end, kind, base, confidence) of all spans of each text, by start, then kind."""
    added = _tagged(tagger, batch_texts) if tagger else [[] for _ in batch_texts]
    out = []
    for text, more in zip(batch_texts, added, strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for a, b, _ in base)
        firsts = [a for a, _ in taken]
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
        spans = [(a, b, kind, True, 1.0) for a, b, kind in base]
        for a, b, kind, sure in more:
            before = int(np.searchsorted(firsts, b))
            if before and reach[before - 1] > a or sure < CONFIDENCE or not _plausible(kind, text[a:b]):
                continue
            spans.append((a, b, kind, False, sure))
        place = {s: i for i, s in enumerate(ordered([(s[0], s[1], s[2]) for s in spans]))}
        out.append(sorted(spans, key=lambda s: place[s[:3]]))
    return out


def _tagger_for(docs: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(train_tagger(docs.filter(F.col("text").rlike("[0-9@]"))))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: kind, start, end (code points, end exclusive), base, confidence."""
    docs = id_and_text(docs, id_col, text_col)
    tagger = _tagger_for(docs)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = spans_of(texts(batch.column("text")), tagger.value)
        flat = [s for spans in found for s in spans]
        parts = pa.StructArray.from_arrays(
            [
                pa.array([s[2] for s in flat], pa.string()), pa.array([s[0] for s in flat], pa.int32()),
                pa.array([s[1] for s in flat], pa.int32()), pa.array([s[3] for s in flat], pa.bool_()),
                pa.array([s[4] for s in flat], pa.float64()),
            ],
            names=["kind", "start", "end", "base", "confidence"],
        )
        cut = pa.array(np.append(0, np.cumsum([len(s) for s in found])), pa.int32())
        return record_batch(doc_id=batch.column("doc_id"), spans=pa.ListArray.from_arrays(cut, parts))

    return map_steps(docs, step, f"doc_id long, spans {SPANS}")


def mask_personal_data(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; other columns unchanged."""
    tagger = _tagger_for(id_and_text(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches, column=text_col):
            column = batch.column(text_col)
            whole = texts(column)
            found = spans_of(whole, tagger.value)
            clean = [_masked(text, spans) for text, spans in zip(whole, found, strict=True)]
            masked = pc.if_else(column.is_null(), pa.scalar(None, pa.string()), pa.array(clean, pa.string()))
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, masked)

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[tuple[int, int, str, bool, float]]) -> str:
    pieces, end = [], 0
    for a, b, kind, _, _ in spans:
        if a >= end:
            pieces += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(pieces) + text[end:]


def _joined(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def contract_spans(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[_count(kind) for kind in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
