"""Title features: vocabulary, weights, standardised structure, assembly.

A *feature space* is one table, a row per community and feature:

    subreddit, kind, feature, center, factor
      kind 't'  text term        value = (1 + ln tf) * factor (= idf), unit length per title
      kind 'c'  character gram   the same, with a vocabulary and a length of its own
      kind 's'  structural       value = (raw - center) * factor (= 1 / sigma)
      kind 'e'  embedding cell   value = raw
      kind 'i'  intercept        value = factor

so every kind is weighted, joined and scored by the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titlegauge.functions.text import STRUCTURAL_NAMES, with_structural, with_term_counts
from titlegauge.operators.joins import lookup_join
from titlegauge.operators.ranking import first_n
from titlegauge.operators.term_counts import folded_terms
from titlegauge.operators.title_cells import INTERCEPT, Cells, codes, per_chunk

MIN_DF, MAX_FEATURES = 3, 20_000
PAIR_MIN_DF, PAIR_MAX_FEATURES = 2, 3_000
VOCABULARY_SALTS = 64
# The text kinds of each analyzer, and what counts their terms.
TEXT_KINDS = {
    "word": {"t": "word"}, "char": {"t": "char"}, "word_char": {"t": "word", "c": "char"},
}
SPACE_KEYS = ["subreddit", "kind", "feature"]
SPACE_COLUMNS = [*SPACE_KEYS, "center", "factor"]


def title_terms(
    posts: DataFrame, analyzer: str = "word", keep: Sequence[str] = (), folded: bool = False, weight: str | None = None,
) -> DataFrame:
    """(subreddit, id, feature, tf): one row per distinct term of each title; ``folded``, instead the
    partial sums of ``folded_terms`` over titles, with ``keep`` as its means."""
    if folded:
        return folded_terms(posts, analyzer, weight, keep)
    counted = with_term_counts(posts.select("subreddit", "id", *keep, "title"), "title", analyzer)
    # explode_outer: plain explode adds a "not empty" filter that is pushed below the counting
    # and would repeat it.
    return (
        counted.select("subreddit", "id", *keep, F.explode_outer("terms").alias("_t"))
        .filter(F.col("_t").isNotNull())
        .select("subreddit", "id", *keep, "_t.feature", "_t.tf")
    )


def vocabulary(
    train: DataFrame, min_df: int = MIN_DF, max_features: int = MAX_FEATURES,
    analyzer: str = "word", weight: str | None = None, means: dict[str, str] | None = None,
) -> DataFrame:
    """(subreddit, feature, tf, df, idf): terms in ``min_df`` training titles of the community,
    the ``max_features`` most frequent (ties by term), with smoothed inverse document frequency.
    A row with a ``weight`` counts as that many titles. ``means`` adds, under each of its names, the
    mean of a column over the titles that hold the term, from the same pass.
    """
    means = means or {}
    times = F.col(weight) if weight else F.lit(1)
    terms = title_terms(train, analyzer, keep=list(means.values()), folded=True, weight=weight)
    counted = (
        terms.groupBy("subreddit", "feature")
        .agg(
            F.sum("tf").alias("tf"), F.sum("df").alias("df"),
            *[(F.sum(f"sum_{i}") / F.nullif(F.sum(f"n_{i}"), F.lit(0))).alias(name) for i, name in enumerate(means)],
        )
        .filter(F.col("df") >= min_df)
    )
    kept = first_n(
        counted, ["subreddit"], [F.desc("tf"), F.col("feature")], max_features,
        salts=VOCABULARY_SALTS, spread=["feature"],
    )
    sizes = train.groupBy("subreddit").agg(F.sum(times).alias("_size"))
    idf = F.log((1 + F.col("_size")) / (1 + F.col("df"))) + 1
    return lookup_join(kept, sizes, ["subreddit"], spread=["feature"]).select(
        "subreddit", "feature", "tf", "df", idf.alias("idf"), *means
    )


def text_space(vocab: DataFrame, kind: str = "t", extra: Sequence[str] = ()) -> DataFrame:
    return vocab.select(
        "subreddit", F.lit(kind).alias("kind"), "feature",
        F.lit(0.0).alias("center"), F.col("idf").alias("factor"), *extra,
    )


def structural_space(train: DataFrame, weight: str | None = None) -> DataFrame:
    """Training mean and 1 / population sigma (1 where sigma is 0) of each structural feature.

    A row with a ``weight`` counts as that many titles.
    """
    values = with_structural(train.select("subreddit", "title", *([weight] if weight else [])))
    moments = []
    for name in STRUCTURAL_NAMES:
        if weight:
            n, x = F.sum(weight), F.col(name)
            mean = F.sum(x * F.col(weight)) / n
            square = F.sum(x * x * F.col(weight)) / n
            sigma = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
            # Rounding leaves a trace of a variance that is none.
            sigma = F.when(sigma > 1e-7 * F.sqrt(square), sigma).otherwise(0.0)
        else:
            mean, sigma = F.avg(name), F.stddev_pop(name)
        moments += [mean.alias(f"m_{name}"), sigma.alias(f"s_{name}")]
    stats = values.groupBy("subreddit").agg(*moments)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.col(f"m_{name}").alias("center"),
                F.when(F.col(f"s_{name}") > 0, 1 / F.nullif(F.col(f"s_{name}"), F.lit(0.0)))
                .otherwise(1.0)
                .alias("factor"),
            )
            for name in STRUCTURAL_NAMES
        ]
    )
    return stats.select("subreddit", F.lit("s").alias("kind"), F.explode(rows).alias("_r")).select(
        "subreddit", "kind", "_r.*"
    )


def embedding_space(communities: DataFrame, size: int) -> DataFrame:
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.concat(F.lit("e"), i.cast("string"))
    )
    return communities.select("subreddit").distinct().select(
        "subreddit", F.lit("e").alias("kind"), F.explode(cells).alias("feature"),
        F.lit(0.0).alias("center"), F.lit(1.0).alias("factor"),
    )


def intercept_space(communities: DataFrame, factor: float = 1.0) -> DataFrame:
    return communities.select("subreddit").distinct().select(
        "subreddit", F.lit("i").alias("kind"), F.lit(INTERCEPT).alias("feature"),
        F.lit(0.0).alias("center"), F.lit(factor).alias("factor"),
    )


def fit_space(
    train: DataFrame, min_df: int = MIN_DF, max_features: int = MAX_FEATURES,
    analyzer: str | None = "word", intercept_factor: float = 1.0, weight: str | None = None,
) -> DataFrame:
    """Text, structural and intercept features of every community, from training rows only; no text
    without an ``analyzer``."""
    space = structural_space(train, weight)
    for kind, counter in (TEXT_KINDS[analyzer] if analyzer else {}).items():
        terms = vocabulary(train, min_df, max_features, counter, weight)
        space = space.unionByName(text_space(terms, kind))
    return (
        space
        .unionByName(intercept_space(train, intercept_factor))
        .select(*SPACE_COLUMNS)
    )


def _cell(kind: str, feature: Column, x: Column, raw: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), feature.alias("feature"),
        x.cast("double").alias("x"), raw.cast("double").alias("raw"),
    )


def _term_cell(kind: str) -> Callable[[Column], Column]:
    return lambda t: _cell(kind, t["feature"], 1 + F.log(t["tf"].cast("double")), t["tf"])


def raw_features(
    posts: DataFrame, keys: Sequence[str], analyzer: str | None = "word",
    embedding: str | None = None,
) -> DataFrame:
    """(keys, kind, feature, x, raw): every raw feature of every title, one pass over the rows."""
    # Columns first: inside the generator the expressions would be evaluated one by one, twice.
    staged = with_structural(posts)
    text_kinds = TEXT_KINDS[analyzer] if analyzer else {}
    for kind, counter in text_kinds.items():
        staged = with_term_counts(staged, "title", counter, out=f"_terms_{kind}")
    structure = F.array(
        *[_cell("s", F.lit(name), F.col(name), F.col(name)) for name in STRUCTURAL_NAMES],
        _cell("i", F.lit(INTERCEPT), F.lit(1.0), F.lit(1.0)),
    )
    parts = [structure]
    for kind in text_kinds:
        parts.append(F.transform(f"_terms_{kind}", _term_cell(kind)))
    if embedding:
        cells = F.transform(
            embedding,
            lambda x, i: _cell("e", F.concat(F.lit("e"), i.cast("string")), x, x),
        )
        # A title without a vector keeps its other features.
        parts.append(F.coalesce(cells, F.slice(structure, 1, 0)))
    # Never empty; explode_outer keeps the optimizer from filtering on a second evaluation.
    cells = F.explode_outer(F.concat(*parts) if len(parts) > 1 else parts[0])
    return staged.select(*keys, cells.alias("_c")).select(*keys, "_c.*")


def _weighted_cells(
    posts: DataFrame, space: DataFrame, keys: Sequence[str], analyzer: str | None,
    embedding: str | None, deal: Sequence[str] = (),
) -> DataFrame:
    """(keys, kind, feature, x, raw, columns of ``space``, value): in-space features before text
    weights get unit length.

    Titles are dealt by ``keys`` before they are unrolled, or by those of them that ``deal`` names: what
    moves is a title, not its features, and whatever is summed or gathered per title, or per value of
    ``deal``, afterwards finds its rows in one place.
    """
    raw = raw_features(posts.repartition(*[F.col(k) for k in deal or keys]), keys, analyzer, embedding)
    joined = lookup_join(raw, space, SPACE_KEYS, spread=[*keys, "feature"])
    value = F.when(F.col("kind") == "i", F.col("factor")).otherwise(
        (F.col("x") - F.col("center")) * F.col("factor")
    )
    return joined.withColumn("value", value)


def _square(kind: str) -> Column:
    return F.sum(F.when(F.col("kind") == kind, F.col("value") * F.col("value")))


def feature_cells(
    posts: DataFrame, space: DataFrame, keys: Sequence[str], analyzer: str | None = "word",
    embedding: str | None = None, extra: Sequence[str] = (), deal: Sequence[str] = (),
) -> DataFrame:
    """(keys, kind, feature, value, raw, extra): a row per weighted, in-space feature of each title."""
    cells = _weighted_cells(posts, space, keys, analyzer, embedding, deal)
    if not analyzer:
        # No text, so no lengths.
        return cells.select(*keys, "kind", "feature", "value", "raw", *extra)
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(*keys, "kind")))
    value = F.when(F.col("kind").isin("t", "c"), F.col("value") / length).otherwise(F.col("value"))
    return cells.select(*keys, "kind", "feature", value.alias("value"), "raw", *extra)


def weighted_sums(
    posts: DataFrame, model: DataFrame, keys: Sequence[str], analyzer: str | None = "word",
    embedding: str | None = None,
) -> DataFrame:
    """(keys, prediction): the sum of value * coef per title; no features are gathered."""
    keys = list(keys)
    schema = posts.select(*keys).schema.add("prediction", "double")

    def work(rows: pa.Table, cells: Cells) -> pa.Table:
        # Without a coefficient a feature adds nothing.
        coef = cells.space["coef"].cast(pa.float64()).fill_null(0.0).to_numpy()
        held = np.unique(cells.title)
        total = cells.per_title(cells.value * coef[cells.place])[held]
        return rows.select(keys).take(pa.array(cells.first[held])).append_column("prediction", pa.array(total))

    kinds = TEXT_KINDS[analyzer] if analyzer else {}
    return per_chunk(posts, model, keys, kinds, embedding, ["coef"], work, schema)


def featurize(
    posts: DataFrame, space: DataFrame, keys: Sequence[str], analyzer: str | None = "word",
    embedding: str | None = None, extra: Sequence[str] = (), named: bool = True,
) -> DataFrame:
    """(keys, features): the weighted, in-space features of each title as one array.

    ``extra`` names further columns of ``space`` to carry (index, coefficient). The array of a
    title is bounded by its length; text weights have unit length over in-vocabulary terms. Without
    ``named`` an array holds value and ``extra`` only.
    """
    keys, extra = list(keys), list(extra)
    carried = [*(["kind", "feature"] if named else []), "value", *(["raw"] if named else []), *extra]
    given = {f.name: f.dataType for f in space.schema} | {"value": T.DoubleType(), "raw": T.DoubleType()}
    struct = T.StructType([T.StructField(name, given[name]) for name in carried])
    schema = posts.select(*keys).schema.add("features", T.ArrayType(struct))

    def work(rows: pa.Table, cells: Cells) -> pa.Table:
        # Sorted cells: equal titles then give bit-equal sums in every run.
        own = {"value": pa.array(cells.value), "raw": pa.array(cells.raw)}
        place = pa.array(cells.place)
        fields = [own[c] if c in own else cells.space[c].combine_chunks().take(place) for c in carried]
        held, offsets = np.unique(cells.title), cells.offsets()
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(offsets[held], offsets[-1]), pa.int32()), pa.StructArray.from_arrays(fields, carried)
        )
        return rows.select(keys).take(pa.array(cells.first[held])).append_column("features", lists)

    kinds = TEXT_KINDS[analyzer] if analyzer else {}
    return per_chunk(posts, space, keys, kinds, embedding, extra, work, schema)


def long_features(featurized: DataFrame, keys: Sequence[str]) -> DataFrame:
    return featurized.select(*keys, F.explode_outer("features").alias("_f")).select(*keys, "_f.*")


def tfidf(posts: DataFrame, vocab: DataFrame, analyzer: str = "word") -> DataFrame:
    """(subreddit, id, feature, weight) over in-vocabulary terms."""
    keys = ["subreddit", "id"]
    cells = feature_cells(posts, text_space(vocab), keys, analyzer).filter(F.col("kind") == "t")
    return cells.select(*keys, "feature", F.col("value").alias("weight"))


def scaled_structural(posts: DataFrame, space: DataFrame) -> DataFrame:
    """(subreddit, id, the eight standardised features)."""
    keys = ["subreddit", "id"]
    wide = [F.max(F.when(F.col("feature") == n, F.col("scaled"))).alias(n) for n in STRUCTURAL_NAMES]
    raw = raw_features(posts, keys, analyzer=None).filter(F.col("kind") == "s")
    scaled = lookup_join(raw, space, SPACE_KEYS, spread=["id", "feature"]).withColumn(
        "scaled", (F.col("x") - F.col("center")) * F.col("factor")
    )
    return scaled.groupBy(*keys).agg(*wide)


def pair_titles(pairs: DataFrame, keys: Sequence[str], community: Column) -> DataFrame:
    """Both titles of each pair as rows (keys, side, subreddit, title)."""
    sides = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("side"), F.col("title_a").alias("title")),
            F.struct(F.lit(-1.0).alias("side"), F.col("title_b").alias("title")),
        )
    )
    return pairs.select(*keys, community.alias("subreddit"), sides.alias("_s")).select(
        *keys, "subreddit", "_s.*"
    )


def pair_features(
    pairs: DataFrame, space: DataFrame, keys: Sequence[str], community: Column,
    analyzer: str | None = "word", fields: Sequence[str] = ("kind", "feature", "value"),
) -> DataFrame:
    """(keys, features): features of title_a minus features of title_b as one array of ``fields``, which are
    ``value`` and columns of ``space``, in order of kind and feature; no intercept."""
    keys, fields = list(keys), list(fields)
    sides = pair_titles(pairs, keys, community)
    given = {f.name: f.dataType for f in space.schema} | {"value": T.DoubleType()}
    struct = T.StructType([T.StructField(name, given[name]) for name in fields])
    schema = sides.select(*keys).schema.add("features", T.ArrayType(struct))

    def work(rows: pa.Table, cells: Cells) -> pa.Table:
        titles = rows.take(pa.array(cells.first))
        pair_of, first = codes(titles, keys)
        side = titles["side"].to_numpy()
        inside = np.not_equal(cells.space["kind"].to_numpy(), "i")[cells.place]
        title, place, size = cells.title[inside], cells.place[inside], max(cells.space.num_rows, 1)
        key, at = np.unique(pair_of[title] * size + place, return_inverse=True)
        value = np.bincount(at, cells.value[inside] * side[title], len(key)).astype(float)
        pair, place = np.divmod(key, size)
        columns = [
            pa.array(value) if c == "value" else cells.space[c].combine_chunks().take(pa.array(place)) for c in fields
        ]
        held, begin = np.unique(pair, return_index=True)
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(begin, len(pair)), pa.int32()), pa.StructArray.from_arrays(columns, fields)
        )
        return titles.select(keys).take(pa.array(first[held])).append_column("features", lists)

    kinds = TEXT_KINDS[analyzer] if analyzer else {}
    extra = [c for c in fields if c not in ("kind", "feature", "value", "center", "factor")]
    return per_chunk(sides, space, [*keys, "side", "subreddit"], kinds, None, extra, work, schema, deal=keys)


def pair_differences(
    pairs: DataFrame, space: DataFrame, keys: Sequence[str], community: Column,
    analyzer: str | None = "word", extra: Sequence[str] = (),
) -> DataFrame:
    """(keys, kind, feature, extra, value): ``pair_features``, a row per feature."""
    fields = ["kind", "feature", *extra, "value"]
    return long_features(pair_features(pairs, space, keys, community, analyzer, fields), keys).filter("kind is not null")


def attach_vectors(posts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every post with its precomputed vector; ``covered`` says whether there is one."""
    joined = posts.join(vectors.select("id", "embedding"), "id", "left")
    return joined.withColumn("covered", F.col("embedding").isNotNull())


def vector_coverage(posts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per community: posts, posts with a vector, and whether the vectors cover all of them."""
    return (
        posts.select("subreddit", "id")
        .join(vectors.select("id", F.size("embedding").alias("dims")), "id", "left")
        .groupBy("subreddit")
        .agg(
            F.count(F.lit(1)).alias("n_posts"),
            F.count("dims").alias("n_vectors"),
            F.max("dims").alias("dims"),
        )
        .withColumn("complete", F.col("n_posts") == F.col("n_vectors"))
    )
