"""Scoring surface: bands, verdicts, ranking, explanations, confidence.

A *model* is a feature space plus a ``coef`` column (see operators.features); *metrics* holds one
row per community with its held-out rank correlation ``rho``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlegauge.functions.text import strip_spaces
from titlegauge.functions.values import verdict
from titlegauge.operators.features import featurize, weighted_sums
from titlegauge.operators.ranking import ordinal_rank

# Wording of structural features, confidence floors and notes, empty explanation.
CONTINUOUS_LABELS = {
    "n_words": "title length (words)",
    "n_chars": "title length (characters)",
    "avg_word_len": "average word length",
    "caps_ratio": "capitalization",
}
BINARY_LABELS = {
    "has_number": ("contains a number", "no number"),
    "has_question": ("phrased as a question", "not a question"),
    "has_exclaim": ("has an exclamation mark", "no exclamation mark"),
    "starts_wh": ("opens with what/why/how", "no what/why/how opener"),
}
RHO_LOW, RHO_HIGH = 0.15, 0.25
NOTE_MISSING = "No reliability metric stored for this subreddit."
NOTE_NAN = "Reliability metric unavailable for this subreddit."
NOTE_HIGH = "Titles are fairly predictive in this subreddit."
NOTE_MODERATE = "Titles carry modest signal here; treat scores as directional."
NOTE_LOW = (
    "This subreddit is not very title-predictable (upvotes barely track the title), "
    "so treat the score as a rough guess."
)
NOTHING_NOTABLE = "(nothing notable)"
RANKED, NO_MODEL, TOO_FEW = "ranked", "no model", "too few drafts"
SMALLEST_CONTRIBUTION = 1e-9
# A pair of carriage return and line feed ends one line; so do the separators of text files.
LINE_ENDS = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"


def draft_lines(requests: DataFrame) -> DataFrame:
    """One row per non-empty trimmed line of ``drafts``; ``position`` grows with the line."""
    lines = F.posexplode(F.split(F.coalesce("drafts", F.lit("")), LINE_ENDS))
    return (
        requests.select("request_id", "subreddit", "position", lines.alias("_line", "_text"))
        .withColumn("title", strip_spaces(F.col("_text")))
        .filter(F.col("title") != "")
        .select(
            "request_id", (F.col("position") + F.col("_line")).alias("position"),
            "subreddit", "title",
        )
    )


def predict(
    posts: DataFrame, model: DataFrame, keys: Sequence[str], analyzer: str | None = "word",
    embedding: str | None = None, with_features: bool = True,
) -> DataFrame:
    """(keys, features, prediction): sum of value * coef; the intercept is a feature.

    Without ``with_features`` the features are summed where they lie and none is gathered.
    """
    if not with_features:
        return weighted_sums(posts, model, keys, analyzer, embedding)
    scored = featurize(posts, model, keys, analyzer, embedding, extra=["coef"])
    total = F.aggregate(
        "features", F.lit(0.0), lambda acc, f: acc + f["value"] * f["coef"]
    )
    return scored.withColumn("prediction", total)


def band(prediction: Column) -> Column:
    """0-100, to nine decimals: bands that differ less are ties."""
    return F.round(F.least(F.greatest(prediction, F.lit(0.0)), F.lit(1.0)) * 100, 9)


def score_titles(
    posts: DataFrame, model: DataFrame, keys: Sequence[str], analyzer: str = "word",
    with_features: bool = True,
) -> DataFrame:
    """0-100 band and verdict per title. A title of a community without a model has neither, and an
    ``error`` that says so. ``with_features`` keeps what ``explain`` reads."""
    scored = predict(posts, model, keys, analyzer, with_features=with_features).withColumn(
        "band", band(F.col("prediction"))
    )
    scored = scored.withColumns(
        {"verdict": verdict(F.col("band")), "error": F.lit(None).cast("string")}
    )
    known = model.select("subreddit").distinct()
    unscored = {
        f.name: F.lit(None).cast(f.dataType) for f in scored.schema if f.name not in (*keys, "error")
    }
    missing = posts.select(*keys).join(known, "subreddit", "left_anti").select(*keys)
    error = F.concat(F.lit("no model for "), F.col("subreddit"))
    return scored.unionByName(missing.withColumns({**unscored, "error": error}))


def rank_drafts(scored: DataFrame, min_drafts: int = 2) -> DataFrame:
    """Order the drafts of each request by band, best first, ties in input order, unscored ones last.

    ``status`` tells apart what is not a ranking: a draft without a model, or a request with fewer
    than ``min_drafts`` drafts.
    """
    prepared = scored.withColumn("_low", F.coalesce(-F.col("band"), F.lit(1.0)))
    ranked = ordinal_rank(prepared, ["request_id"], "_low", "position", "rank").drop("_low")
    sizes = scored.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    status = (
        F.when(F.col("band").isNull(), NO_MODEL).when(F.col("_n") < min_drafts, TOO_FEW).otherwise(RANKED)
    )
    return ranked.join(sizes, "request_id").withColumn("status", status).drop("_n")


def strongest_draft(scored: DataFrame) -> DataFrame:
    """The best draft of each request (ties: the earliest); combines in the map tasks."""
    best = F.max_by(
        F.struct("subreddit", "position", "title", "band", "verdict"),
        F.struct("band", -F.col("position")),
    )
    return scored.groupBy("request_id").agg(best.alias("_b")).select("request_id", "_b.*")


def feature_label(kind: Column, feature: Column, raw: Column) -> Column:
    """Quoted term, or the wording of a structural feature (binary ones by their raw value)."""
    chain = F.when(kind.isin("t", "c"), F.concat(F.lit('"'), feature, F.lit('"')))
    for name, (present, absent) in BINARY_LABELS.items():
        chain = chain.when(
            feature == name, F.when(raw >= 0.5, F.lit(present)).otherwise(F.lit(absent))
        )
    for name, text in CONTINUOUS_LABELS.items():
        chain = chain.when(feature == name, F.lit(text))
    return chain.otherwise(feature)


def explain(predicted: DataFrame, k: int = 5) -> DataFrame:
    """Add ``boosts`` and ``hurts``: the ``k`` largest contributions on either side.

    Works inside the feature array of each title; the intercept takes no part.
    """
    # Sort keys: size of the contribution, then label, so equal contributions keep one order.
    contributions = F.transform(
        F.filter("features", lambda f: f["kind"] != "i"),
        lambda f: F.struct(
            F.round(f["value"] * f["coef"], 12).alias("c"),
            feature_label(f["kind"], f["feature"], f["raw"]).alias("label"),
        ),
    )
    nothing = F.array().cast("array<struct<c:double,label:string>>")
    staged = predicted.withColumn("_all", F.coalesce(contributions, nothing))

    def top(sign: int) -> Column:
        mine = F.filter("_all", lambda x: x["c"] * sign > SMALLEST_CONTRIBUTION)
        ordered = F.array_sort(
            F.transform(
                mine,
                lambda x: F.struct((-x["c"] * sign).alias("o"), x["label"].alias("label")),
            )
        )
        return F.transform(
            F.slice(ordered, 1, k),
            lambda x: F.struct(
                x["label"].alias("label"), (-x["o"] * sign).alias("contribution")
            ),
        )

    return staged.withColumn("boosts", top(1)).withColumn("hurts", top(-1)).drop("_all")


def explanation_rows(explained: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, direction, k, label, contribution): flat form of the explanation."""
    sides = []
    for name in ("boosts", "hurts"):
        cells = F.posexplode(name).alias("_k", "_c")
        sides.append(
            explained.select(*keys, F.lit(name[:-1]).alias("direction"), cells).select(
                *keys, "direction", (F.col("_k") + 1).alias("k"), "_c.*"
            )
        )
    return sides[0].unionByName(sides[1])


def explanation_text(side: Column) -> Column:
    labels = F.array_join(F.transform(side, lambda c: c["label"]), ", ")
    return F.when(F.size(side) == 0, F.lit(NOTHING_NOTABLE)).otherwise(labels)


def confidence(metrics: DataFrame) -> DataFrame:
    """(subreddit, rho, level, note) from the held-out rank correlation."""
    rho = F.col("rho")
    known = rho.isNotNull() & ~F.isnan(rho)

    def pick(missing: str, nan: str, high: str, moderate: str, low: str) -> Column:
        return (
            F.when(rho.isNull(), missing).when(F.isnan(rho), nan)
            .when(rho >= RHO_HIGH, high).when(rho >= RHO_LOW, moderate).otherwise(low)
        )

    return metrics.select(
        "subreddit",
        F.when(known, rho).alias("rho"),
        pick("unknown", "unknown", "high", "moderate", "low").alias("level"),
        pick(NOTE_MISSING, NOTE_NAN, NOTE_HIGH, NOTE_MODERATE, NOTE_LOW).alias("note"),
    )


def trained_communities(metrics: DataFrame) -> DataFrame:
    return metrics.select("subreddit").distinct().orderBy("subreddit")


def unknown_communities(requests: DataFrame, metrics: DataFrame) -> DataFrame:
    """Requested communities without a model, with a message naming those that exist.

    The message lists the catalogue, one name per trained community.
    """
    catalogue = metrics.select("subreddit").distinct()
    names = catalogue.agg(
        F.coalesce(
            F.nullif(F.array_join(F.sort_array(F.collect_set("subreddit")), ", "), F.lit("")),
            F.lit("(none trained yet)"),
        ).alias("names")
    )
    missing = requests.select("subreddit").distinct().join(catalogue, "subreddit", "left_anti")
    return missing.withColumn(
        "error",
        F.concat(
            F.lit("no model for "), F.col("subreddit"), F.lit("; trained: "), names.scalar()
        ),
    )


def require_models(requests: DataFrame, metrics: DataFrame) -> DataFrame:
    """The requests themselves; raises when one names a community without a model."""
    errors = unknown_communities(requests, metrics).limit(5).collect()
    if errors:
        raise LookupError("; ".join(row["error"] for row in errors))
    return requests


