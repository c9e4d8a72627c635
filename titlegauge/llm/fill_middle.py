"""Fill-in-middle: a document's lines reordered so that a model learns to write the middle part.

Method: secondary-sort assembly. A text becomes pieces of whole lines (a line longer than a piece is
cut), keyed by document and *output* position. One repartition by document with a sort inside the
partitions brings the pieces into output order, and a task streams them: nothing of a document is
held but the piece at hand and two digests. While it streams, the task reads the output back: it
finds the marks in the bytes it has just written, learns each piece's place in the original text,
and hands the pieces on. They are sorted again where they are (the partitions stay), and streamed a
second time in the order of the original. Texts are therefore shuffled once and never joined into
one value, unless the caller asks for texts (``gathered``).

A document's cuts come from a digest of its id, so reruns agree and no random state is kept.

Defined cases. A null text counts as empty; empty texts stay plain, as do texts that hold a mark.
A null id counts as the empty text in the digest. Rows are told apart by id, a 128-bit hash of the
text and the input partition they come from, so many rows without an id spread out; equal rows of a
partition are carried once with their number and come out as often. Order of equal pieces cannot
matter: positions are unique within a document. Very long texts are many pieces; only the row that
holds the text is whole, as the input has it. Extra columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.llm.common import id_and_text, record_batch, text_steps

#: Bytes of a piece at most; an Arrow batch of 10,000 pieces stays below 80 MB.
PIECE_BYTES = 8 << 10
#: Bytes that a step hands on at once.
OUT_BYTES = 4 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
MARKS = {PREFIX: b"<P>", MIDDLE: b"<M>", SUFFIX: b"<S>"}
#: The order of the parts in each form, each behind its mark.
ORDERS = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}

ROW_KEY = ["doc_id", "text_hash", "dealt"]
PIECES = "doc_id long, text_hash binary, dealt int, form string, times long, part int, at long, piece binary"


@dataclass(frozen=True)
class Rates:
    """Parameters: digest prefix, percentages of transformed and of suffix-first documents, size of
    a piece."""

    seed: str = "7"
    transformed: int = 100
    suffix_first: int = 50
    piece_bytes: int = PIECE_BYTES


def cuts(doc_id: str, n_units: int, rates: Rates) -> tuple[int, int, str]:
    """Units before the middle and before the suffix, and the form if nothing keeps the text plain."""
    digest = hashlib.sha256(f"{rates.seed}:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    ends = sorted((h[0] % (n_units + 1), h[1] % (n_units + 1)))
    if h[2] % 100 >= rates.transformed:
        return *ends, PLAIN
    return *ends, SPM if h[3] % 100 < rates.suffix_first else PSM


def parts_of(text: bytes, doc_id: str, rates: Rates) -> tuple[str, list[tuple[int, bytes]]]:
    """Form, and (part, bytes) in output order, marks included as pieces of their part."""
    line_ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    starts = np.concatenate([[0], line_ends[line_ends < len(text)], [len(text)]]) if text else np.zeros(1, np.int64)
    n = len(starts) - 1
    first, second, form = cuts(doc_id, n, rates)
    if not text or any(mark in text for mark in MARKS.values()):
        form = PLAIN
    if form == PLAIN:
        return PLAIN, [(PREFIX, p) for p in _chunks(text, starts, 0, n, rates.piece_bytes)] or [(PREFIX, b"")]
    units = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, n)}
    out = []
    for part in ORDERS[form]:
        out.append((part, MARKS[part]))
        out += [(part, p) for p in _chunks(text, starts, *units[part], rates.piece_bytes)]
    return form, out


def _chunks(text: bytes, starts: np.ndarray, begin: int, end: int, size: int) -> Iterator[bytes]:
    """Units ``begin`` to ``end`` as pieces of whole units where they fit."""
    while begin < end:
        stop = max(begin + 1, int(np.searchsorted(starts, starts[begin] + size, side="right")) - 1)
        stop = min(stop, end)
        for at in range(int(starts[begin]), int(starts[stop]), size):
            yield text[at : min(at + size, int(starts[stop]))]
        begin = stop


def output_pieces(docs: DataFrame, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every output, in output order within each partition.

    ``at`` is the piece's byte position in the output, ``part`` the part it belongs to, ``times`` the
    number of equal rows it stands for (given with the first piece, else 0).
    """
    source = id_and_text(docs, id_col, text_col).withColumn("dealt", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches):
            rows: dict[tuple, list] = {}
            for doc_id, text, dealt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                key = (doc_id, hashlib.md5(data, usedforsecurity=False).digest(), dealt)
                rows.setdefault(key, [0, data])[0] += 1
            collected = _Rows(PIECES)
            for key, (times, data) in rows.items():
                form, pieces = parts_of(data, "" if key[0] is None else str(key[0]), rates)
                at = 0
                for part, piece in pieces:
                    collected.add(len(piece), *key, form, times if at == 0 else 0, part, at, piece)
                    at += max(1, len(piece))
                    yield from collected.full()
            yield from collected.rest()

    pieces = source.mapInArrow(cut, PIECES)
    return pieces.repartition(*ROW_KEY).sortWithinPartitions(*ROW_KEY, "at")


class _Rows:
    """Collects rows and gives them out as batches of bounded size."""

    def __init__(self, ddl: str):
        self.names = [field.split()[0] for field in ddl.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        self.types = [kinds[field.split()[1]] for field in ddl.split(", ")]
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.names]
        self.size = 0

    def add(self, size: int, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.size += size + 64

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.size >= OUT_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            arrays = [pa.array(c, t) for c, t in zip(self.columns, self.types, strict=True)]
            yield record_batch(**dict(zip(self.names, arrays, strict=True)))
            self.clear()


class _Documents:
    """Runs over sorted pieces and calls back at each new document and each piece of it.

    ``at`` orders the pieces of a document; equal positions are copies of one piece, whose ``times``
    add up.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], start: Callable, piece: Callable, end: Callable):
        self.batches, self.start, self.piece, self.end = batches, start, piece, end

    def run(self, out: _Rows) -> Iterator[pa.RecordBatch]:
        key, place = None, None
        for batch in self.batches:
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                now = tuple(row[c] for c in ROW_KEY)
                if now != key:
                    if key is not None:
                        self.end(key)
                    key, place = now, None
                    self.start(row)
                here = (row["part"], row["at"])
                self.piece(row, here == place)
                place = here
                yield from out.full()
        if key is not None:
            self.end(key)
        yield from out.rest()


class _Reader:
    """Reads an output as it streams by and says which part each byte range belongs to.

    Between pieces it holds back up to two bytes, which may begin a mark.
    """

    def __init__(self, form: str):
        self.order = list(ORDERS.get(form, ()))
        self.part = PREFIX
        self.held = b""

    def read(self, piece: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        data = self.held + piece
        self.held = b""
        while self.order:
            mark = MARKS[self.order[0]]
            found = data.find(mark)
            if found < 0:
                break
            if found:
                yield self.part, data[:found]
            self.part = self.order.pop(0)
            data = data[found + len(mark) :]
        if self.order and not last:
            mark = MARKS[self.order[0]]
            keep = next((k for k in (2, 1) if data.endswith(mark[:k])), 0)
            data, self.held = data[: len(data) - keep], data[len(data) - keep :]
        if data:
            yield self.part, data


def code_points(data: bytes) -> int:
    """Code points that begin in ``data`` (UTF-8)."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


RESTORED = PIECES + ", output_sha256 string, prefix_chars long, middle_chars long"
#: The part under which the facts of the output travel, before all pieces.
FACTS = -1


def restored_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces of ``output_pieces`` read back from the outputs, in the order of the original texts.

    Each document begins with a row of part -1 that has the digest and counts of its output.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(RESTORED)
        state: dict = {}

        def start(row: dict) -> None:
            state.update(form=row["form"], times=0, digest=hashlib.sha256(), reader=_Reader(row["form"]), chars=[0, 0, 0], at=[0, 0, 0])

        def hand_on(key: tuple, found: Iterator[tuple[int, bytes]]) -> None:
            for part, data in found:
                state["chars"][part] += code_points(data)
                out.add(len(data), *key, state["form"], 0, part, state["at"][part], data, None, None, None)
                state["at"][part] += len(data)

        def piece(row: dict, copy: bool) -> None:
            state["times"] += row["times"]
            if not copy:
                state["digest"].update(row["piece"])
                hand_on(tuple(row[c] for c in ROW_KEY), state["reader"].read(row["piece"]))

        def end(key: tuple) -> None:
            hand_on(key, state["reader"].read(b"", last=True))
            chars = (None, None) if state["form"] == PLAIN else state["chars"][:2]
            out.add(100, *key, state["form"], state["times"], FACTS, 0, b"", state["digest"].hexdigest(), *chars)

        yield from _Documents(batches, start, piece, end).run(out)

    return pieces.mapInArrow(read, RESTORED).sortWithinPartitions(*ROW_KEY, "part", "at")


DIGESTS = (
    "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
)


def digests(restored: DataFrame) -> DataFrame:
    """One row per document: line count, form, sizes, and digests of output and restored text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(DIGESTS)
        state: dict = {}

        def start(row: dict) -> None:
            state.update(facts=row, digest=hashlib.sha256(), lines=0, last=b"\n")

        def piece(row: dict, copy: bool) -> None:
            if row["piece"]:
                state["digest"].update(row["piece"])
                state["lines"] += row["piece"].count(b"\n")
                state["last"] = row["piece"][-1:]

        def end(key: tuple) -> None:
            facts, n = state["facts"], state["lines"] + (state["last"] != b"\n")
            for _ in range(facts["times"]):
                out.add(200, key[0], n, facts["form"], facts["prefix_chars"], facts["middle_chars"], facts["output_sha256"], state["digest"].hexdigest())

        yield from _Documents(batches, start, piece, end).run(out)

    return restored.mapInArrow(digest, DIGESTS)


TEXTS = "doc_id long, form string, text string"


def gathered(pieces: DataFrame) -> DataFrame:
    """(doc_id, form, text): pieces in order joined to whole texts, outputs or restored ones."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(TEXTS)
        state: dict = {}

        def start(row: dict) -> None:
            state.update(form=row["form"], times=0, data=[])

        def piece(row: dict, copy: bool) -> None:
            state["times"] += row["times"]
            if not copy:
                state["data"].append(row["piece"])

        def end(key: tuple) -> None:
            text = b"".join(state["data"]).decode()
            for _ in range(state["times"]):
                out.add(len(text), key[0], state["form"], text)

        yield from _Documents(batches, start, piece, end).run(out)

    return pieces.mapInArrow(gather, TEXTS)


def fill_in_middle(docs: DataFrame, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, form, text): every document's output as a whole text."""
    return gathered(output_pieces(docs, rates, id_col, text_col))


def restored_texts(docs: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """(doc_id, form, text): the originals, rebuilt from outputs and forms."""
    return gathered(restored_pieces(output_pieces(docs, rates)))


def contract_digests(docs: DataFrame) -> DataFrame:
    return digests(restored_pieces(output_pieces(docs)))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
       WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
         ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
