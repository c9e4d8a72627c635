"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. Each document's shingle set is named by its size and 128 bits over all its members. Documents
   with equal sets are one class, so copies are compared once. A class is named by its smallest id.
2. Class signatures are cut into bands. Classes that share a band with others are candidates; the
   links of each class to the smallest class of its bands give clusters of candidates.
3. In each cluster the class that shares most bands is its centre. Every class meets the centre:
   signatures are compared batch by batch, a pair is given up once the posterior probability that
   its similarity reaches the threshold falls below ``miss``, and survivors are verified on full sets.
4. Classes not linked to the centre ("open" ones) meet every class of their cluster, in blocks of
   bounded size on both sides. Pairs already joined inside a block are skipped: one link joins them.
5. Components of the verified links name the groups.

Scale: a group of near copies that all resemble its centre costs one comparison per copy, whatever
its size. Work beyond that is only for open classes. Shingle sets are built again from the texts of
candidates instead of being stored for all documents.

Cases: null or empty text (or no word) has the empty set, links with nothing and is its own
component; a row without an id cannot name a group: it has no component and is kept; rows with
the same id count as one document, of which the smallest set is compared; extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegauge.llm.common import id_and_text, map_steps, record_batch, rows_of_bytes, written
from titlegauge.llm.components import components
from titlegauge.llm.textwords import distinct, find_words, mixed, row_sums, shingles


@dataclass(frozen=True)
class NearDupPlan:
    """Pairs link when 100 * intersection >= percent * union of their shingles of ``words`` words.

    ``bands`` of ``rows`` minimum hashes: a pair at 85 % shares none of 32 bands of 6 with
    probability 3e-7, one at 80 % with 8e-5 (2e-9 with 48 bands of 5).
    """

    words: int = 3
    percent: int = 85
    bands: int = 32
    rows: int = 6
    batch: int = 32
    miss: float = 1e-6
    block: int = 256

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


CONTRACT = NearDupPlan()
#: Five words and 80 % for pipelines.
CORPUS = NearDupPlan(words=5, percent=80, bands=48, rows=5, batch=48)


def linked(intersection: np.ndarray | int, size_a: int, size_b: int, percent: int):
    return 100 * intersection >= percent * (size_a + size_b - intersection)


@lru_cache
def fewest_matches(hashes: int, batch: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, matches a pair needs to stay) after each batch.

    With a uniform prior and m of n matches the similarity is Beta(m + 1, n - m + 1), which lies
    above t with probability P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in [*range(batch, hashes, batch), hashes]:
        below, m = 0.0, 0
        while True:
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def survivors(own: np.ndarray, others: np.ndarray, plan: NearDupPlan) -> np.ndarray:
    """Indices of the rows of ``others`` that may be similar to ``own``, by batches of signatures."""
    left = np.arange(len(others))
    matches = np.zeros(len(others), np.int32)
    done = 0
    for n, least in fewest_matches(plan.hashes, plan.batch, plan.percent, plan.miss):
        matches = matches + (others[left, done:n] == own[done:n]).sum(axis=1)
        stay = matches >= least
        left, matches, done = left[stay], matches[stay], n
        if not len(left):
            break
    return left


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(rows: np.ndarray, hashes: np.ndarray, n_rows: int, n_hashes: int) -> np.ndarray:
    """Minimum hashes of each row's set; rows without members get the largest value."""
    out = np.full((n_rows, n_hashes), 0xFFFFFFFF, np.uint32)
    if not len(rows):
        return out
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    present = rows[first]
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    factor, shift = _seeds(n_hashes)
    y = np.empty_like(x)
    for i in range(n_hashes):
        np.multiply(x, factor[i], out=y)
        y += shift[i]
        out[present, i] = np.minimum.reduceat(y, first)
    return out


def _sets(column: pa.Array, plan: NearDupPlan) -> tuple[np.ndarray, np.ndarray]:
    words = find_words(column)
    return distinct(*shingles(words.row, words.first, words.hashes(), plan.words))


def shingle_sets(docs: DataFrame, plan: NearDupPlan) -> DataFrame:
    """doc_id, n (set size), h1 and h2 (the set's name), signature."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_rows = batch.num_rows
        rows, hashes = _sets(batch.column("text"), plan)
        size = np.bincount(rows, minlength=n_rows)
        h1 = row_sums(rows, mixed(hashes + np.uint64(1)), n_rows)
        h2 = row_sums(rows, mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), n_rows)
        return record_batch(
            doc_id=batch.column("doc_id"), n=size, h1=h1.view(np.int64), h2=h2.view(np.int64),
            signature=rows_of_bytes(signatures(rows, hashes, n_rows, plan.hashes)),
        )

    return map_steps(docs, step, "doc_id long, n long, h1 long, h2 long, signature binary")


def _band_keys(classes: DataFrame, plan: NearDupPlan) -> DataFrame:
    """(band, doc_id): one row per class and band."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _matrix(batch.column("signature"), plan)
            keys = np.zeros((len(matrix), plan.bands), np.uint64)
            for j in range(plan.rows):
                keys = mixed(keys * np.uint64(3) + matrix[:, j :: plan.rows])
            keys = mixed(keys + np.arange(plan.bands, dtype=np.uint64)).view(np.int64)
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), plan.bands)
            yield record_batch(band=keys.reshape(-1), doc_id=ids)

    return classes.select("doc_id", "signature").mapInArrow(step, "band long, doc_id long")


def _matrix(column: pa.Array, plan: NearDupPlan) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint32).reshape(-1, plan.hashes)


def _candidate_sets(docs: DataFrame, ids: DataFrame, plan: NearDupPlan) -> DataFrame:
    """(doc_id, h1, members) with the sorted shingle hashes of the classes in ``ids``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, hashes = _sets(batch.column("text"), plan)
        first = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        members = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        h1 = row_sums(rows, mixed(hashes + np.uint64(1)), batch.num_rows)
        return record_batch(
            doc_id=batch.column("doc_id"), h1=h1.view(np.int64), members=pa.array(members, pa.binary())
        )

    wanted = docs.join(ids, "doc_id", "left_semi")
    return map_steps(wanted, step, "doc_id long, h1 long, members binary")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Members that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    return int((b[place] == a).sum()) if len(b) else 0


def _meets_centre(pairs: DataFrame, plan: NearDupPlan) -> DataFrame:
    """(doc_id, centre, linked) of each class and the centre of its cluster."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, other = _matrix(batch.column("signature"), plan), _matrix(batch.column("c_signature"), plan)
            alive = np.ones(len(own), bool)
            done, matches = 0, np.zeros(len(own), np.int32)
            for n, least in fewest_matches(plan.hashes, plan.batch, plan.percent, plan.miss):
                matches += (own[:, done:n] == other[:, done:n]).sum(axis=1, dtype=np.int32)
                alive &= matches >= least
                done = n
            mine, theirs = batch.column("members"), batch.column("c_members")
            for i in np.flatnonzero(alive):
                a = np.frombuffer(mine[i].as_py(), np.uint64)
                b = np.frombuffer(theirs[i].as_py(), np.uint64)
                alive[i] = linked(_common(a, b), len(a), len(b), plan.percent)
            yield record_batch(doc_id=batch.column("doc_id"), centre=batch.column("centre"), linked=alive)

    columns = ["doc_id", "centre", "signature", "members", "c_signature", "c_members"]
    return pairs.select(*columns).mapInArrow(step, "doc_id long, centre long, linked boolean")


def _block_links(ids, group, is_open, matrix, members, plan: NearDupPlan) -> list[tuple[int, int]]:
    """Links of open classes with the others of a block that join what was not joined before."""
    root = {g: g for g in group}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i in np.flatnonzero(is_open):
        for j in survivors(matrix[i], matrix, plan):
            a, b = find(group[i]), find(group[j])
            if a != b and linked(_common(members[i], members[j]), len(members[i]), len(members[j]), plan.percent):
                root[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
    return out


def _open_links(cluster_rows: DataFrame, plan: NearDupPlan) -> DataFrame:
    """Verified links (a, b) of open classes, within pairs of blocks of their cluster.

    ``cluster_rows``: doc_id, cluster, group (the centre for classes linked to it, else the class),
    is_open, n_all, n_open, signature, members.
    """
    n_all = F.ceil(F.col("n_all") / plan.block)
    n_open = F.ceil(F.col("n_open") / plan.block)
    zero = F.lit(0).cast("long")
    base = cluster_rows.withColumn("all_block", F.pmod(F.xxhash64("doc_id"), n_all)).withColumn(
        "open_block", F.pmod(F.xxhash64("doc_id", F.lit(1)), n_open)
    )
    kept = ["doc_id", "cluster", "group", "signature", "members"]
    # Each class once per block of open ones, each open class once per block of all.
    as_other = base.select(
        *kept, F.lit(False).alias("is_open"), "all_block",
        F.explode(F.sequence(zero, n_open - 1)).alias("open_block"),
    )
    as_open = base.filter("is_open").select(
        *kept, "is_open", F.explode(F.sequence(zero, n_all - 1)).alias("all_block"), "open_block"
    )

    def step(rows: pa.Table) -> pa.Table:
        ids = rows.column("doc_id").to_numpy()
        members = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("members")]
        links = _block_links(
            ids.tolist(), rows.column("group").to_pylist(),
            rows.column("is_open").to_numpy(zero_copy_only=False),
            _matrix(rows.column("signature"), plan), members, plan,
        )
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = as_other.unionByName(as_open.select(as_other.columns))
    return blocks.groupBy("cluster", "all_block", "open_block").applyInArrow(step, "a long, b long")


def class_links(docs: DataFrame, classes: DataFrame, plan: NearDupPlan) -> DataFrame:
    """Verified links (a, b) between classes: enough of them to connect all that links connect."""
    bands = written(_band_keys(classes, plan))
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("smallest"))
    members = written(bands.join(shared.filter("n > 1"), "band").select("doc_id", "n", "smallest"))
    popular = members.groupBy("doc_id").agg(F.sum("n").alias("popularity"))
    clusters = components(members.select(F.col("doc_id").alias("a"), F.col("smallest").alias("b")))
    placed = popular.join(clusters, popular["doc_id"] == clusters["node"]).select(
        "doc_id", F.col("component").alias("cluster"), "popularity"
    )
    centres = placed.groupBy("cluster").agg(
        F.max(F.struct("popularity", -F.col("doc_id")))["col2"].alias("minus"), F.count("*").alias("n_all")
    ).select("cluster", (-F.col("minus")).alias("centre"), "n_all")
    placed = written(placed.join(centres, "cluster").select("doc_id", "cluster", "centre", "n_all"))
    sets = written(
        _candidate_sets(docs, placed.select("doc_id"), plan)
        .join(classes.select("doc_id", "h1", "signature"), ["doc_id", "h1"])
        .dropDuplicates(["doc_id"])
        .join(placed, "doc_id")
    )
    centre_sets = sets.filter("doc_id = centre").select(
        F.col("cluster").alias("c_cluster"), F.col("signature").alias("c_signature"), F.col("members").alias("c_members")
    )
    pairs = sets.filter("doc_id <> centre").join(centre_sets, F.col("cluster") == F.col("c_cluster"))
    met = written(_meets_centre(pairs, plan))
    open_ones = met.filter("not linked").select("doc_id", F.lit(True).alias("is_open"))
    stuck = met.filter("not linked").groupBy("centre").agg(F.count("*").alias("n_open"))
    stuck = stuck.select(F.col("centre").alias("s_centre"), "n_open")
    cluster_rows = (
        sets.join(stuck, F.col("centre") == F.col("s_centre"))
        .join(open_ones, "doc_id", "left")
        .withColumn("is_open", F.coalesce("is_open", F.lit(False)))
        .withColumn("group", F.when(F.col("is_open"), F.col("doc_id")).otherwise(F.col("centre")))
    )
    to_centre = met.filter("linked").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"))
    return to_centre.unionByName(_open_links(cluster_rows, plan))


def near_duplicates(
    docs: DataFrame, plan: NearDupPlan = CONTRACT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
    docs = id_and_text(docs, id_col, text_col)
    sets = written(shingle_sets(docs, plan))
    named = sets.filter("n > 0 and doc_id is not null")
    names = written(named.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("class")))
    # A class is read from one row: the one with its smallest id.
    classes = written(
        named.join(names, (F.col("class") == named["doc_id"]) & _same_set(named, names))
        .groupBy(named["doc_id"])
        .agg(F.min(F.struct(named["n"], named["h1"], named["h2"], named["signature"])).alias("row"))
        .select("doc_id", "row.n", "row.h1", "row.h2", "row.signature")
    )
    grouped = components(written(class_links(docs.filter("doc_id is not null"), classes, plan)))
    of_set = names.join(grouped, names["class"] == grouped["node"], "left").select(
        "n", "h1", "h2", F.coalesce("component", "class").alias("component")
    )
    joined = sets.join(
        of_set, _same_set(sets, of_set) & sets["doc_id"].isNotNull() & (sets["n"] > 0), "left"
    )
    component = F.when(sets["doc_id"].isNotNull(), F.coalesce("component", sets["doc_id"]))
    return joined.select(sets["doc_id"], sets["n"].alias("n_shingles"), component.alias("component_id")).select(
        "*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _same_set(a: DataFrame, b: DataFrame):
    return (a["n"] == b["n"]) & (a["h1"] == b["h1"]) & (a["h2"] == b["h2"])


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM words),
one AS (SELECT list_sort(s) AS s, min(doc_id) AS class FROM sets WHERE len(s) > 0 GROUP BY 1),
members AS (SELECT class, len(s) AS n, unnest(s) AS m FROM one),
shared AS (SELECT a.class AS a, b.class AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
           FROM members a JOIN members b ON a.m = b.m AND a.class < b.class
            AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT class, class FROM one UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
named AS (SELECT a AS class, min(b) AS component FROM reach GROUP BY 1)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id,
       coalesce(component, d.doc_id) = d.doc_id AS kept
FROM sets d LEFT JOIN one o ON list_sort(d.s) = o.s LEFT JOIN named c ON o.class = c.class
"""
