"""Exact repeated passages: suffix arrays by linear grouping, dealt out by content anchors.

A byte is removed if some string of ``LENGTH`` bytes that covers it starts anywhere else too. Suffixes
that share so long a prefix must meet in one suffix array, and no array can hold the corpus:

1. The anchor of a window of ``LENGTH`` bytes is its ``GRAM``-byte string of smallest hash, the leftmost
   of equals. It depends on the window's bytes alone, so equal windows have equal anchors at equal
   offsets. Windows in a row with one anchor form a segment; a text has about one per 85 bytes.
2. Only segments whose anchor occurs again can hold a repeat. Equal segments are collapsed and
   counted first: all windows of a segment that occurs twice are repeats. A hot passage ends here.
3. What is left are segments about the ends of repeats. Per anchor the ones that can share a window
   make one small text, whose suffix array is built; neighbours in it that share ``LENGTH`` bytes are
   repeats.
4. An anchor with more than ``LANE_SEGMENTS`` different segments is cut by longer anchors: windows that
   start in the same few places about it share all but a few bytes, and these bytes name smaller lanes.
   Equal parts are collapsed again, lanes of few parts go to suffix arrays, crowded ones are cut finer.

Cases: null text counts as empty; texts shorter than ``LENGTH`` keep all bytes; repeated rows are
repeats of each other, and ties among equal segments do not matter, as all are removed; rows without
an id take part; a very long text is one step; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.llm.common import id_and_text, map_steps, record_batch, text_steps, written
from titlegauge.llm.suffix_groups import suffix_arrays
from titlegauge.llm.textwords import mixed, range_hashes, running_sums, utf8

LENGTH = 200
GRAM = 32
LANE_SEGMENTS = 32
#: Text that one task's batch of suffix arrays holds.
LANE_BYTES = 2 << 20
KEY = ["k1", "k2"]


def _sliding_smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by running minima within blocks from both sides."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(column: pa.Array, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Per segment: row, anchor hash, hash of its bytes, and (from the row's begin) first, last, anchor.

    ``first`` and ``last`` are the starts of its windows; its bytes are first .. last + length.
    """
    text, bounds = utf8(column)
    names = ("row", "anchor", "bytes", "first", "last", "at")
    if len(text) < length:
        return {name: np.zeros(0, np.int64) for name in names}
    sums = running_sums(text)
    gram = range_hashes(sums, np.arange(len(text) - GRAM + 1), np.arange(GRAM, len(text) + 1))
    low = np.uint64((1 << max(20, len(text).bit_length())) - 1)
    keyed = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    at = (_sliding_smallest(keyed, length - GRAM + 1) & low).astype(np.int64)
    valid = np.zeros(len(at) + 1, bool)
    edge = np.zeros(len(text) + 2, np.int64)
    long = bounds[1:] - bounds[:-1] >= length
    np.add.at(edge, bounds[:-1][long], 1)
    np.add.at(edge, bounds[1:][long] - length + 1, -1)
    valid[:-1] = np.cumsum(edge)[: len(at)] > 0
    starts = valid[:-1].copy()
    starts[1:] &= ~valid[:-2] | (at[1:] != at[:-1])
    starts |= np.isin(np.arange(len(at)), bounds[:-1][long])
    first = np.flatnonzero(starts)
    stops = valid[:-1] & ~np.append(valid[1:-1] & ~starts[1:], False)
    last = np.flatnonzero(stops)
    row = np.searchsorted(bounds, first, side="right") - 1
    begin = bounds[row]
    return {
        "row": row, "anchor": gram[at[first]], "bytes": range_hashes(sums, first, last + length),
        "first": first - begin, "last": last - begin, "at": at[first] - begin,
    }


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts under id and 64 bits of the text; without an id, under 128 bits of the text.

    Ids are kept as they are, because random numbers in their place take much more disk.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")
    return docs.select(
        "doc_id", text.alias("text"), F.coalesce("doc_id", half).alias("k1"), F.xxhash64(text).alias("k2")
    )


def _shape(found: dict[str, np.ndarray]) -> np.ndarray:
    """Window starts of a segment, and 256 times the anchor's place in it; both are below 256."""
    return (found["at"] - found["first"]) * 256 + found["last"] - found["first"] + 1


def _anchors(docs: DataFrame) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = segments(batch.column("text"))
        row = pa.array(found["row"])
        return record_batch(
            k1=batch.column("k1").take(row), k2=batch.column("k2").take(row),
            anchor=found["anchor"].view(np.int64), bytes=found["bytes"].view(np.int64),
            first=found["first"], shape=_shape(found).astype(np.int32),
        )

    return map_steps(
        docs.select(*KEY, "text"), step, "k1 long, k2 long, anchor long, bytes long, first long, shape int"
    )


def _with_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` segments with their bytes cut out of the texts."""
    lists = wanted.groupBy(*KEY).agg(
        F.collect_list(F.struct("first", "shape", "anchor", "copies", "different")).alias("cuts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches):
            text, bounds = utf8(batch.column("text"))
            cuts = batch.column("cuts")
            flat = cuts.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(cuts.offsets.to_numpy()))
            first, shape = flat.field("first").to_numpy(), flat.field("shape").to_numpy()
            width = shape % 256
            begin = bounds[row] + first
            pieces = [text[a : a + n].tobytes() for a, n in zip(begin, width + LENGTH - 1, strict=True)]
            yield record_batch(
                k1=batch.column("k1").take(pa.array(row)), k2=batch.column("k2").take(pa.array(row)),
                first=flat.field("first"), width=width, at=shape // 256, anchor=flat.field("anchor"),
                copies=flat.field("copies"), different=flat.field("different"), piece=pa.array(pieces, pa.binary()),
            )

    joined = docs.select(*KEY, "text").join(lists, KEY)
    return joined.mapInArrow(
        run, "k1 long, k2 long, first long, width int, at int, anchor long, copies long, different long, piece binary"
    )


def repeated_windows(pieces: list[list[bytes]], copies: list[list[int]], length: int = LENGTH) -> list[list[np.ndarray]]:
    """For each piece of each lane, which of its window starts occur twice in the lane.

    ``copies`` counts how often a piece occurs. A piece has len - length + 1 window starts.
    """
    layouts = []
    for lane in pieces:
        # Byte + 1, and 0 after each piece: no window crosses it.
        text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int16) + 1, 0) for p in lane])
        layouts.append(text)
    out = []
    for text, order, lane, times in zip(layouts, suffix_arrays(layouts), pieces, copies, strict=True):
        sizes = np.array([len(p) for p in lane])
        begin = np.cumsum(sizes + 1) - sizes - 1
        number = np.repeat(np.arange(len(lane)), sizes + 1)
        offset = np.arange(len(text)) - begin[number]
        start = order[offset[order] + length <= sizes[number[order]]]
        flags = [np.full(max(0, n - length + 1), c > 1) for n, c in zip(sizes, times, strict=True)]
        if len(start) > 1:
            windows = np.lib.stride_tricks.sliding_window_view(text, length)
            same = np.concatenate(
                [
                    (windows[start[a + 1 : a + 4_097]] == windows[start[a : a + 4_096][: len(start) - 1 - a]]).all(axis=1)
                    for a in range(0, len(start) - 1, 4_096)
                ]
            )
            twice = np.append(same, False) | np.append(False, same)
            for p in start[twice]:
                flags[number[p]][offset[p]] = True
        out.append(flags)
    return out


def _partners(pieces: list[bytes], at: list[int]) -> list[int]:
    """Numbers of the pieces of an anchor that can share a window with another one.

    All windows of a piece hold its core, the bytes between the start of its last window and the end
    of its first. A shared window holds both cores, in the same place about the anchor.
    """
    cores = [(len(p) - LENGTH, LENGTH) for p in pieces]
    kept = set()
    for i, piece in enumerate(pieces):
        for j in range(i + 1, len(pieces)):
            move = at[j] - at[i]
            if _holds(pieces[j], piece, cores[i], move) and _holds(piece, pieces[j], cores[j], -move):
                kept |= {i, j}
    return sorted(kept)


def _holds(other: bytes, piece: bytes, core: tuple[int, int], move: int) -> bool:
    low, high = core[0] + move, core[1] + move
    return low >= 0 and high <= len(other) and other[low:high] == piece[core[0] : core[1]]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1


def _from_suffix_arrays(open_pieces: DataFrame) -> DataFrame:
    """(k1, k2, first, last) of repeated window starts in segments that occur once."""
    total = open_pieces.agg(F.sum(F.length("piece")).alias("n")).first()["n"] or 0
    n_batches = total // LANE_BYTES + 1

    def step(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("anchor", "ascending"), ("k1", "ascending"), ("k2", "ascending"), ("first", "ascending")])
        anchor = rows.column("anchor").to_numpy()
        cut = np.append(np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]), len(anchor))
        pieces, copies, place = (rows.column(c).to_pylist() for c in ("piece", "copies", "at"))
        lanes = [
            [a + i for i in _partners(pieces[a:b], place[a:b])] for a, b in zip(cut[:-1], cut[1:], strict=True)
        ]
        lanes = [lane for lane in lanes if lane]
        found = repeated_windows([[pieces[i] for i in n] for n in lanes], [[copies[i] for i in n] for n in lanes])
        which, begin, end = [], [], []
        first = rows.column("first").to_numpy()
        for lane, flags in zip(lanes, found, strict=True):
            for i, own in zip(lane, flags, strict=True):
                if copies[i] == 1 and own.any():
                    low, high = _runs(own)
                    which += [i] * len(low)
                    begin += (first[i] + low).tolist()
                    end += (first[i] + high).tolist()
        at = pa.array(which, pa.int64())
        return pa.table(
            {
                "k1": rows.column("k1").take(at), "k2": rows.column("k2").take(at),
                "first": pa.array(begin, pa.int64()), "last": pa.array(end, pa.int64()),
            }
        )

    dealt = open_pieces.withColumn("batch", F.pmod(F.xxhash64("anchor"), F.lit(n_batches)))
    return dealt.groupBy("batch").applyInArrow(step, "k1 long, k2 long, first long, last long")


#: Window starts of one part when a crowded lane is cut, level by level; at last each stands alone.
PART_STARTS = (24, 6, 1)
CUT = "anchor long, bytes long, k1 long, k2 long, first long, width int, at int, copies long, piece binary"


def cut_parts(
    anchor: np.ndarray, first: np.ndarray, width: np.ndarray, at: np.ndarray, pieces: list[bytes], starts: int
) -> dict[str, np.ndarray | list[bytes]]:
    """Pieces cut by where their windows start about the anchor, ``starts`` places a part.

    All windows of a part hold the same LENGTH - starts + 1 bytes in the same place about the anchor:
    a longer anchor, which names the part's lane. Equal windows are in parts of one lane.
    """
    low, high = -at, width - 1 - at  # first and last start of a piece, from its anchor
    begin_block, end_block = low // starts, high // starts
    n = end_block - begin_block + 1
    row = np.repeat(np.arange(len(n)), n)
    block = begin_block[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.maximum(low[row], block * starts) + at[row]
    end = np.minimum(high[row], block * starts + starts - 1) + at[row]
    core = block * starts + starts - 1 + at[row]
    sizes = width + LENGTH - 1
    text = np.frombuffer(b"".join(pieces), np.uint8)
    base = (np.cumsum(sizes) - sizes)[row]
    sums, again = running_sums(text), running_sums(text ^ np.uint8(0x5A))
    place = mixed((begin - at[row]).astype(np.int64).view(np.uint64))
    where = mixed(anchor.view(np.uint64)[row] ^ mixed(block.astype(np.int64).view(np.uint64)))
    return {
        "row": row, "first": first[row] + begin, "width": end - begin + 1, "at": at[row] - begin,
        "anchor": mixed(range_hashes(sums, base + core, base + core + LENGTH - starts + 1) ^ where).view(np.int64),
        "bytes": mixed(range_hashes(again, base + begin, base + end + LENGTH) ^ place).view(np.int64),
        "piece": [pieces[r][a : b + LENGTH] for r, a, b in zip(row, begin.tolist(), end.tolist(), strict=True)],
    }


def _parts(pieces: DataFrame, starts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                rows = batch.slice(at, 2_048)
                numbers = (rows.column(c).to_numpy().astype(np.int64) for c in ("anchor", "first", "width", "at"))
                found = cut_parts(*numbers, rows.column("piece").to_pylist(), starts)
                take = pa.array(found["row"])
                yield record_batch(
                    anchor=found["anchor"], bytes=found["bytes"], k1=rows.column("k1").take(take), k2=rows.column("k2").take(take),
                    first=found["first"], width=found["width"].astype(np.int32), at=found["at"].astype(np.int32),
                    copies=rows.column("copies").take(take), piece=pa.array(found["piece"], pa.binary()),
                )

    return pieces.select("anchor", *KEY, "first", "width", "at", "copies", "piece").mapInArrow(run, CUT)


def _from_crowded_lanes(pieces: DataFrame) -> DataFrame:
    """(k1, k2, first, last) for anchors with many different segments.

    Their segments are cut into parts whose lanes are named by longer and longer anchors. Equal parts
    are counted and collapsed: all their windows are repeats. A part alone in its lane has none. Lanes
    of few parts go to suffix arrays; crowded ones are cut again, until a part is one window.
    """
    found = None
    for starts in PART_STARTS:
        parts = written(_parts(pieces, starts))
        one = F.min(F.struct(*KEY, "first", "width", "at", "piece")).alias("one")
        kinds = written(parts.groupBy("anchor", "bytes").agg(F.sum("copies").alias("copies"), one))
        twice = kinds.filter("copies > 1").select("anchor", "bytes")
        runs = parts.filter("copies = 1").join(twice, ["anchor", "bytes"]).select(
            *KEY, "first", (F.col("first") + F.col("width") - 1).alias("last")
        )
        found = runs if found is None else found.unionByName(runs)
        if starts > 1:
            lanes = kinds.groupBy("anchor").agg(F.count("*").alias("different"), F.min("copies").alias("fewest"))
            lanes = lanes.filter("different > 1 and fewest = 1").select("anchor", "different")
            open_parts = written(kinds.join(lanes, "anchor").select("anchor", "copies", "different", "one.*"))
            few = F.col("different") <= LANE_SEGMENTS
            found = found.unionByName(_from_suffix_arrays(open_parts.filter(few)))
            pieces = open_parts.filter(~few)
    return found


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(k1, k2, first, last): starts of windows that occur anywhere else, for every keyed text."""
    anchors = written(_anchors(docs))
    again = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    members = written(anchors.join(again, "anchor"))
    one = F.min(F.struct("k1", "k2", "first", "shape")).alias("one")
    kinds = written(members.groupBy("anchor", "bytes").agg(F.count("*").alias("copies"), one))
    whole = members.join(kinds.filter("copies > 1").select("anchor", "bytes"), ["anchor", "bytes"]).select(
        *KEY, "first", (F.col("first") + F.col("shape") % 256 - 1).alias("last")
    )
    mixed_anchors = (
        kinds.groupBy("anchor")
        .agg(F.count("*").alias("different"), F.min("copies").alias("fewest"))
        .filter("different > 1 and fewest = 1")
        .select("anchor", "different")
    )
    wanted = kinds.join(mixed_anchors, "anchor").select("anchor", "copies", "different", "one.*")
    # Equal rows have equal keys and give the same pieces.
    pieces = written(_with_bytes(docs, wanted).dropDuplicates([*KEY, "first", "anchor"]))
    few = F.col("different") <= LANE_SEGMENTS
    ranges = whole.unionByName(_from_suffix_arrays(pieces.filter(few)))
    crowded = pieces.filter(~few)
    if not crowded.isEmpty():
        ranges = ranges.unionByName(_from_crowded_lanes(crowded))
    # Rows that share a key are equal: one list of ranges serves them all.
    return ranges.distinct()


def _kept_parts(text: bytes, ranges: list) -> tuple[bytes, int, int]:
    """(what is left, removed bytes, removed runs) of one text."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, [r["first"] for r in ranges], 1)
    np.add.at(edge, [r["last"] + LENGTH for r in ranges], -1)
    gone = np.cumsum(edge[:-1]) > 0
    low, _ = _runs(gone)
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), len(low)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every text."""
    keyed = _keyed(id_and_text(docs, id_col, text_col))
    ranges = repeated_ranges(keyed).groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    joined = keyed.join(ranges, KEY, "left").select("doc_id", "text", "ranges")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = [t.encode() for t in batch.column("text").to_pylist()]
        parts = [
            _kept_parts(t, r) if r else (t, 0, 0)
            for t, r in zip(whole, batch.column("ranges").to_pylist(), strict=True)
        ]
        return record_batch(
            doc_id=batch.column("doc_id"), n_bytes=pa.array([len(t) for t in whole], pa.int64()),
            n_removed=pa.array([p[1] for p in parts], pa.int64()), n_spans=pa.array([p[2] for p in parts], pa.int64()),
            kept=pa.array([p[0] for p in parts], pa.binary()),
        )

    return map_steps(joined, step, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def contract_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT rid, unnest(range(0, greatest(0, len(h) // 2 - 199)::BIGINT)) AS p, h FROM texts),
named AS (SELECT rid, p, md5(substr(h, 2 * p + 1, 400)) AS w FROM windows),
twice AS (SELECT w FROM named GROUP BY w HAVING count(*) > 1),
dup AS (SELECT rid, p FROM named SEMI JOIN twice USING (w)),
islands AS (SELECT rid, p, max(p) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM dup),
marked AS (SELECT rid, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY p) AS span FROM islands),
spans AS (SELECT rid, span, min(p) AS a, max(p) + 200 AS b FROM marked GROUP BY rid, span),
gaps AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS since FROM spans),
kept AS (SELECT rid, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS left_over,
                sum(b - a) AS n_removed, count(*) AS n_spans FROM gaps JOIN texts USING (rid) GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""
