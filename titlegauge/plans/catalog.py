"""Every operator as a named query over the given tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlegauge.functions.text import STRUCTURAL_NAMES, with_structural
from titlegauge.functions.urls import norm_url
from titlegauge.functions.values import verdict
from titlegauge.operators.joins import lookup_join
from titlegauge.operators.models import GRADIENT_LIMIT
from titlegauge.operators import evaluate, features, ingest, labels, models, noise, pairs, profile, ridge, score
from titlegauge.plans import pair_study, training
from titlegauge.plans.drafts import DRAFT_KEYS, draft_report
from titlegauge.plans.posts import labelled_posts, split_sides
from titlegauge.session import cut_lineage, scratch_path, tune
from titlegauge.sources import fixtures, model_store, tables

Query = Callable[[SparkSession, str], DataFrame]

# Query parameters: small enough to bind at the smallest scale factors.
BEFORE_EPOCH = 946_684_800  # 2000-01-01
LATEST_N, MONTHLY_N, STRIDE, SCAN_ROWS = 100, 200, 3, 60
SAMPLE_N = 5
WANTED = ["src0", "src3", "src7", "src11", "src19"]
MIN_LINK_POSTS = 2_000
RIDGE_ALPHA, FEW_TERMS, RETRAIN_ALPHA = 10.0, 12, 3.0
EMBEDDING_SIZE = 64

_QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register ``build`` under its name; the session settings are applied first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(tune(spark), sf_dir)

    _QUERIES[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals, the precision two engines agree on."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(name, digits) for name in doubles})


# ---------------------------------------------------------------- shared inputs


def _clean(spark, sf):
    return ingest.clean_posts(fixtures.raw_posts(spark, sf))


def _stored_clean(spark, sf):
    """Clean posts as a written table, for queries that read them more than once."""
    return cut_lineage(_clean(spark, sf))


def _labelled(spark, sf):
    return labelled_posts(fixtures.raw_posts(spark, sf))


def _links(spark, sf):
    return fixtures.links(spark, sf)


def _stored_links(spark, sf):
    """Links as a written table, for queries that read them more than once; pairs of reposts do."""
    return cut_lineage(_links(spark, sf).select("sub", "nurl", "title", "score", "id", "created_utc"))


def _reposts(spark, sf, links=None):
    """Repost pairs as a written table, for queries that read them more than once."""
    return cut_lineage(pairs.repost_pairs(_stored_links(spark, sf) if links is None else links))


def _ab_pairs(spark, sf):
    return pairs.ab_pairs(fixtures.ab_variants(spark, sf), fixtures.AB_MIN_IMPRESSIONS)


def _fixed(spark, sf):
    """Labelled posts and the closed-form model fitted on their training side."""
    labelled = cut_lineage(_labelled(spark, sf))
    train, _ = split_sides(labelled)
    return labelled, cut_lineage(training.fixed_model(train))


def _link_model(links, without=None):
    """Closed-form models of the link communities, from the titles of all stored links, or of those whose
    content is not among the keys ``without``."""
    if without is not None:
        links = lookup_join(links, without, ["nurl"], how="left_anti")
    links = links.select(
        "id", "title", F.col("sub").alias("subreddit"), "score", F.lit(2024).alias("year"),
        F.lit(False).alias("is_test"),
    )
    return cut_lineage(training.fixed_model(cut_lineage(labels.era_percentile(links))))


def _modelled_links(links):
    """Link communities with enough posts to count as modelled."""
    counted = profile.rows_per(links, ["sub"]).filter(F.col("n_rows") >= MIN_LINK_POSTS)
    return counted.select(F.col("sub").alias("subreddit"))


def _predicted_test(spark, sf):
    labelled, model = _fixed(spark, sf)
    _, test = split_sides(labelled)
    keys = ["subreddit", "id", "title", "label"]
    predicted = score.predict(test, model, keys, with_features=False)
    # Rounded so that ties are ties in every engine.
    return labelled, cut_lineage(predicted.withColumn("prediction", F.round("prediction", 9)))


def _fixed_evaluation(spark, sf):
    labelled, predicted = _predicted_test(spark, sf)
    train, _ = split_sides(labelled)
    sizes = profile.rows_per(train, ["subreddit"], "n_train")
    return evaluate.evaluation_rows(predicted, sizes)


def _metrics(spark, sf):
    return training.metrics_of(_fixed_evaluation(spark, sf))


def _scored_drafts(spark, sf, with_features=False):
    _, model = _fixed(spark, sf)
    drafts = fixtures.drafts(spark, sf)
    return cut_lineage(score.score_titles(drafts, model, DRAFT_KEYS, with_features=with_features))


# ---------------------------------------------------------------- ingest and cleaning


@query
def clean_posts(spark, sf):
    return _clean(spark, sf)


@query
def clean_posts_historical(spark, sf):
    return ingest.clean_posts(fixtures.raw_posts(spark, sf), bad_time="zero")


@query
def community_filter(spark, sf):
    return ingest.in_communities(_clean(spark, sf), WANTED)


@query
def month_stride_scan(spark, sf):
    orders = fixtures.table(spark, sf, "orders")
    monthly = orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return ingest.month_stride_scan(monthly, STRIDE).select(
        "month", "o_orderkey", "o_custkey", "o_orderpriority"
    )


@query
def first_file_per_month(spark, sf):
    orders = fixtures.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("_"), "o_orderpriority").alias("file"),
        "o_orderkey",
    )
    return ingest.month_stride_scan(orders, STRIDE, "file")


@query
def latest_per_community(spark, sf):
    return ingest.latest_per_community(_clean(spark, sf), LATEST_N, BEFORE_EPOCH)


@query
def latest_links(spark, sf):
    return ingest.latest_per_community(_links(spark, sf), LATEST_N, community="sub")


@query
def two_level_quota(spark, sf):
    monthly = ingest.with_month(_clean(spark, sf))
    return ingest.two_level_quota(monthly, MONTHLY_N, 80).select(
        *ingest.CLEAN_COLUMNS, "month"
    )


@query
def scan_bound(spark, sf):
    raw = ingest.with_month(fixtures.raw_posts(spark, sf))
    return ingest.scan_bound(raw, SCAN_ROWS, "file_order").select("id", "month", "subreddit")


@query
def historical_sample(spark, sf):
    raw = ingest.with_month(fixtures.raw_posts(spark, sf))
    return ingest.historical_sample(raw, WANTED, STRIDE, MONTHLY_N, SCAN_ROWS)


@query
def recent_sample(spark, sf):
    raw = fixtures.raw_posts(spark, sf)
    pulled_twice = raw.unionByName(raw)
    return ingest.recent_sample(pulled_twice, WANTED, LATEST_N, BEFORE_EPOCH)


@query
def dedupe_posts(spark, sf):
    # Two overlapping pulls; the earlier one wins.
    posts = _clean(spark, sf)
    first = posts.withColumn("pull", F.lit(1))
    second = posts.withColumn("score", F.col("score") + 1).withColumn("pull", F.lit(2))
    return ingest.first_per_id(first.unionByName(second), [F.col("pull")])


@query
def norm_urls(spark, sf):
    pages = fixtures.table(spark, sf, "pages")
    return pages.select("page_id", "url", norm_url(F.col("url")).alias("nurl"))


@query
def external_links(spark, sf):
    return _links(spark, sf)


@query
def ab_click_rates(spark, sf):
    variants = fixtures.ab_variants(spark, sf)
    return rounded(pairs.ab_click_rates(variants, fixtures.AB_MIN_IMPRESSIONS))


@query
def ab_csv_round_trip(spark, sf):
    path = scratch_path(spark, "ab-variants")
    tables.write_csv(fixtures.ab_variants(spark, sf), path)
    return tables.read_ab_csv(spark, path)


@query
def parquet_round_trip(spark, sf):
    path = scratch_path(spark, "posts")
    tables.write_table(_clean(spark, sf), path)
    return tables.read_posts(spark, path)


@query
def rated_links(spark, sf):
    return pairs.rated_links(_links(spark, sf))


@query
def posting_times(spark, sf):
    return pairs.with_posting_time(_links(spark, sf)).select(
        "id", "created_utc", "hour", "weekend"
    )


@query
def draft_lines(spark, sf):
    documents = fixtures.table(spark, sf, "documents")
    return score.draft_lines(
        documents.select(
            F.col("doc_id").alias("request_id"), F.col("source").alias("subreddit"),
            F.lit(0).alias("position"), F.col("text").alias("drafts"),
        )
    )


# ---------------------------------------------------------------- profiles


@query
def community_profile(spark, sf):
    return rounded(profile.community_profile(_stored_clean(spark, sf)))


@query
def rows_per_year(spark, sf):
    return profile.rows_per(_clean(spark, sf), ["year"])


@query
def hash_sample(spark, sf):
    return profile.hash_sample(_clean(spark, sf), SAMPLE_N)


@query
def table_summary(spark, sf):
    return profile.table_summary(_clean(spark, sf))


@query
def variant_summary(spark, sf):
    return profile.variant_summary(fixtures.ab_variants(spark, sf))


@query
def ab_pair_summary(spark, sf):
    return rounded(profile.ab_pair_summary(_ab_pairs(spark, sf)))


@query
def ratio_summary(spark, sf):
    return rounded(profile.ratio_summary(_links(spark, sf)))


@query
def repost_groups_per_community(spark, sf):
    return profile.rows_per(pairs.repost_groups(_links(spark, sf)), ["sub"], "n_groups")


@query
def pairs_per_community(spark, sf):
    return profile.rows_per(pairs.repost_pairs(_stored_links(spark, sf)), ["subreddit"], "n_pairs")


# ---------------------------------------------------------------- pairs and label noise


@query
def repost_groups(spark, sf):
    return rounded(pairs.repost_groups(_links(spark, sf)))


@query
def noise_floor(spark, sf):
    return rounded(pairs.noise_floor(pairs.repost_groups(_links(spark, sf))))


@query
def top_posts_per_group(spark, sf):
    return pairs.top_posts_per_group(_links(spark, sf))


@query
def repost_pairs(spark, sf):
    return pairs.repost_pairs(_stored_links(spark, sf))


@query
def ab_pairs(spark, sf):
    return rounded(_ab_pairs(spark, sf))


@query
def dual_label_pairs(spark, sf):
    return rounded(pairs.dual_label_pairs(_links(spark, sf)))


@query
def balanced_pairs(spark, sf):
    return pairs.balanced_pairs(_reposts(spark, sf), pair_study.PAIR_KEYS).select(
        "pair_index", "nurl", "title_a", "title_b", "y"
    )


@query
def symmetric_examples(spark, sf):
    return pairs.symmetric_examples(_ab_pairs(spark, sf)).select(
        "group_id", "title_a", "title_b", "y"
    )


@query
def pair_viability(spark, sf):
    return pairs.dual_viability(_links(spark, sf))


@query
def decisive_reposts(spark, sf):
    return pairs.decisive_reposts(pairs.repost_pairs(_stored_links(spark, sf)))


@query
def decisive_ab(spark, sf):
    return rounded(pairs.decisive_ab(_ab_pairs(spark, sf)))


@query
def within_group_cv(spark, sf):
    return rounded(noise.within_group_cv(_links(spark, sf)))


@query
def winner_agreement(spark, sf):
    return rounded(noise.winner_agreement(_links(spark, sf)))


@query
def time_matched_noise(spark, sf):
    return rounded(noise.time_matched_noise(_links(spark, sf)))


# ---------------------------------------------------------------- labels and splits


@query
def stratified_split(spark, sf):
    return labels.stratified_split(_stored_clean(spark, sf)).select("id", "subreddit", "year", "is_test")


@query
def group_split(spark, sf):
    return labels.group_split(_reposts(spark, sf), ["nurl"], pair_study.TEST_SHARE).select(
        *pair_study.PAIR_KEYS, "is_test"
    )


@query
def ecdf_table(spark, sf):
    split = labels.stratified_split(_stored_clean(spark, sf))
    return labels.fit_ecdf(split.filter("not is_test"))


@query
def era_percentile(spark, sf):
    return rounded(
        _labelled(spark, sf).select("id", "subreddit", "year", "score", "is_test", "label")
    )


# ---------------------------------------------------------------- features


@query
def structural_features(spark, sf):
    return rounded(with_structural(_clean(spark, sf)).select("id", *STRUCTURAL_NAMES))


@query
def title_terms(spark, sf):
    return features.title_terms(_clean(spark, sf))


@query
def char_terms(spark, sf):
    """Character n-grams of all titles, counted per community."""
    terms = features.title_terms(_clean(spark, sf), analyzer="char", folded=True)
    return terms.groupBy("subreddit", "feature").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _train_of(posts):
    return cut_lineage(labels.stratified_split(posts).filter("not is_test").drop("is_test"))


def _train(spark, sf):
    return _train_of(_stored_clean(spark, sf))


@query
def vocabulary(spark, sf):
    return rounded(features.vocabulary(_train(spark, sf)))


@query
def tfidf(spark, sf):
    posts = _stored_clean(spark, sf)
    vocab = cut_lineage(features.vocabulary(_train_of(posts)))
    return rounded(features.tfidf(posts, vocab))


@query
def scaled_structural(spark, sf):
    posts = _stored_clean(spark, sf)
    space = features.structural_space(_train_of(posts))
    return rounded(features.scaled_structural(posts, space))


@query
def assembled_features(spark, sf):
    """Non-zero features per kind and title, with their sum: the assembled row, summarised."""
    keys = ["subreddit", "id"]
    posts = _stored_clean(spark, sf)
    space = features.fit_space(_train_of(posts))
    cells = features.feature_cells(posts, space, keys)
    return rounded(
        cells.groupBy(*keys, "kind").agg(
            F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total")
        )
    )


@query
def pair_differences(spark, sf):
    balanced = cut_lineage(pairs.balanced_pairs(_reposts(spark, sf), pair_study.PAIR_KEYS))
    community = F.lit("all")
    titles = features.pair_titles(balanced, ["pair_index"], community)
    space = features.fit_space(
        titles.withColumn("id", F.col("pair_index")),
        features.PAIR_MIN_DF, features.PAIR_MAX_FEATURES,
    )
    return rounded(features.pair_differences(balanced, space, ["pair_index"], community))


@query
def embedding_lookup(spark, sf):
    return features.vector_coverage(_clean(spark, sf), fixtures.post_vectors(spark, sf))


@query
def embedding_features(spark, sf):
    """(subreddit, id, kind, cells, sum) of the [embedding, structure] rows."""
    clean = _stored_clean(spark, sf)
    train = _train_of(clean)
    space = features.embedding_space(train, EMBEDDING_SIZE).unionByName(
        features.structural_space(train)
    )
    posts = features.attach_vectors(clean, fixtures.post_vectors(spark, sf))
    keys = ["subreddit", "id"]
    cells = features.feature_cells(posts, space, keys, analyzer=None, embedding="embedding")
    return rounded(
        cells.groupBy(*keys, "kind").agg(
            F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total")
        )
    )


# ---------------------------------------------------------------- models and evaluation


@query
def fixed_model(spark, sf):
    _, model = _fixed(spark, sf)
    return rounded(model)


@query
def fixed_predictions(spark, sf):
    _, predicted = _predicted_test(spark, sf)
    return rounded(predicted.select("subreddit", "id", "prediction"))


@query
def spearman_naive(spark, sf):
    _, test = split_sides(_labelled(spark, sf))
    return rounded(evaluate.naive_spearman(test))


@query
def spearman_model(spark, sf):
    _, predicted = _predicted_test(spark, sf)
    return rounded(evaluate.spearman(predicted, ["subreddit"], "prediction", "label", "rho_model"))


@query
def top_decile(spark, sf):
    _, predicted = _predicted_test(spark, sf)
    return rounded(evaluate.top_decile(predicted, ["subreddit"], "prediction", "label"))


@query
def eval_table(spark, sf):
    return rounded(evaluate.with_mean_row(_fixed_evaluation(spark, sf)))


@query
def model_comparison(spark, sf):
    """Fixed model against the word-count baseline, with the difference."""
    rows = cut_lineage(_fixed_evaluation(spark, sf))
    naive = rows.select("subreddit", F.col("rho_naive").alias("rho"))
    model = rows.select("subreddit", F.col("rho_model").alias("rho"))
    return rounded(evaluate.compare_metrics(naive, model, "rho", "rho_naive", "rho_model"))


@query
def model_tables(spark, sf):
    """Write the bundle, read a few communities back (only their partitions are scanned)."""
    labelled, model = _fixed(spark, sf)
    train, _ = split_sides(labelled)
    folder = scratch_path(spark, "models")
    metrics = profile.rows_per(train, ["subreddit"], "n_train")
    model_store.write_models(folder, model, labels.fit_ecdf(train), metrics)
    stored = model_store.read_models(spark, folder, WANTED)
    sizes = [
        stored[name].groupBy("subreddit").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        for name in ("model", "ecdf")
    ]
    return stored["metrics"].select("subreddit", "n_train").join(sizes[0], "subreddit").join(
        sizes[1], "subreddit"
    )


def _stored(spark, sf, analyzer=None):
    """The posts, a folder of models trained on them, and the tables read back from it."""
    labelled, folder = cut_lineage(_labelled(spark, sf)), scratch_path(spark, "models")
    return labelled, folder, training.train_and_store(folder, labelled, analyzer)


@query
def trained_communities(spark, sf):
    """The catalogue of a store of trained models."""
    return score.trained_communities(_stored(spark, sf)[2]["model"])


@query
def stored_scores(spark, sf):
    """Drafts scored by models on structure that were trained, stored and read back."""
    model = _stored(spark, sf)[2]["model"]
    scored = score.score_titles(
        fixtures.drafts(spark, sf), model, DRAFT_KEYS, analyzer=None, with_features=False
    )
    return rounded(scored.select("request_id", "position", "subreddit", "band", "error"), 4)


@query
def retrained_community(spark, sf):
    """One community is trained anew with another penalty; the others stay as they were stored."""
    labelled, folder, _ = _stored(spark, sf)
    mine = labelled.filter(F.col("subreddit") == WANTED[0])
    model = training.train_and_store(folder, mine, None, alphas=(RETRAIN_ALPHA,))["model"]
    return model.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n_features"), F.max("alpha").alias("alpha"))


@query
def trained_report(spark, sf):
    """The flagship: text models trained, stored and read back rank and explain every draft."""
    stored = _stored(spark, sf, "word")[2]
    return rounded(draft_report(fixtures.drafts(spark, sf), stored["model"], stored["metrics"]))


@query
def unknown_communities(spark, sf):
    links = _links(spark, sf)
    return score.unknown_communities(links.select(F.col("sub").alias("subreddit")), _modelled_links(links))


@query
def community_overlap(spark, sf):
    links = _stored_links(spark, sf)
    return evaluate.community_overlap(pairs.repost_pairs(links), _modelled_links(links))


@query
def modelled_pairs(spark, sf):
    links = _stored_links(spark, sf)
    return evaluate.modelled_pairs(pairs.repost_pairs(links), _modelled_links(links))


def _judged(spark, sf):
    links = _stored_links(spark, sf)
    return pair_study.judged_pointwise(_reposts(spark, sf, links), _link_model(links))


@query
def pair_accuracy(spark, sf):
    return rounded(evaluate.pair_accuracy(_judged(spark, sf)))


@query
def margin_accuracy(spark, sf):
    judged = pairs.with_margin(_judged(spark, sf)).withColumn(
        "correct", F.col("band_win") > F.col("band_lose")
    )
    return rounded(evaluate.margin_accuracy(judged))


@query
def order_symmetric_accuracy(spark, sf):
    return rounded(evaluate.order_symmetric_accuracy(fixtures.pair_logits(spark, sf)))


@query
def ridge_structural(spark, sf):
    """Coefficients of ridge models on structure alone, at a fixed penalty."""
    train, _ = split_sides(cut_lineage(_labelled(spark, sf)))
    space = features.structural_space(train).unionByName(
        features.intercept_space(train, training.INTERCEPT_FACTOR)
    )
    model = training.fit_ridge(train, space, alphas=(RIDGE_ALPHA,), analyzer=None)
    return rounded(model.select("subreddit", "kind", "feature", "coef"), 4)


@query
def ridge_model(spark, sf):
    """The features of the per-community ridge models, and whether each is at its optimum: the
    gradient of the penalised squared error vanishes in it."""
    train, _ = split_sides(cut_lineage(_labelled(spark, sf)))
    space = features.fit_space(train, intercept_factor=training.INTERCEPT_FACTOR)
    model = training.fit_ridge(train, space)
    at_optimum = (F.col("gradient") <= GRADIENT_LIMIT).alias("optimal")
    return model.select("subreddit", "kind", "feature", at_optimum)


@query
def ridge_few_terms(spark, sf):
    """Coefficients of ridge models on the few most frequent terms and structure."""
    train, _ = split_sides(cut_lineage(_labelled(spark, sf)))
    space = features.fit_space(train, max_features=FEW_TERMS, intercept_factor=training.INTERCEPT_FACTOR)
    model = training.fit_ridge(train, space, alphas=(RIDGE_ALPHA,))
    return rounded(model.select("subreddit", "kind", "feature", "coef"), 4)


@query
def loo_alpha(spark, sf):
    """The penalty by leaving out each post and by folds, on structure, and where they differ."""
    train, _ = split_sides(cut_lineage(_labelled(spark, sf)))
    space = features.fit_space(train, analyzer=None, intercept_factor=training.INTERCEPT_FACTOR)
    return rounded(ridge.compare_choices(train, space, training.ALPHAS, training.FOLDS), 4)


@query
def ridge_structural_evaluation(spark, sf):
    """Trained on structure with the penalty chosen by folds, evaluated on the held-out posts."""
    labelled = cut_lineage(_labelled(spark, sf))
    return rounded(training.train_and_evaluate(labelled, analyzer=None).evaluation)


@query
def ridge_evaluation(spark, sf):
    return training.train_and_evaluate(cut_lineage(_labelled(spark, sf))).evaluation


@query
def word_char_evaluation(spark, sf):
    labelled = cut_lineage(_labelled(spark, sf))
    return training.train_and_evaluate(labelled, analyzer="word_char").evaluation


@query
def embedding_comparison(spark, sf):
    """Held-out rank correlation of the embedding ridge next to the text ridge, on the same posts."""
    labelled = cut_lineage(_labelled(spark, sf))
    train, _ = split_sides(labelled)
    space = features.fit_space(train, intercept_factor=training.INTERCEPT_FACTOR)
    model = training.fit_ridge(train, space)
    vectors = cut_lineage(fixtures.post_vectors(spark, sf))
    covered = cut_lineage(features.attach_vectors(labelled, vectors).filter("covered"))
    _, rows = training.train_embedding(labelled, vectors, EMBEDDING_SIZE, strict=False)
    text = training.evaluate_model(covered, model)
    return evaluate.compare_metrics(
        cut_lineage(text), cut_lineage(rows), "rho_model", "rho_text", "rho_embedding"
    )


def _preference_study(spark, sf, analyzer):
    """Both sides are judged on pairs whose content neither has seen."""
    links = _stored_links(spark, sf)
    split = cut_lineage(pair_study.split_pairs(_reposts(spark, sf, links)))
    held_out = split.filter("is_test").select("nurl").distinct()
    return rounded(pair_study.preference_study(split, _link_model(links, held_out), analyzer))


@query
def preference_study(spark, sf):
    return _preference_study(spark, sf, "word")


@query
def preference_structural(spark, sf):
    """The preference study with a classifier on structure alone."""
    return _preference_study(spark, sf, None)


@query
def preference_coefficients(spark, sf):
    """The classifier of the structural study, at its optimum."""
    split = cut_lineage(pair_study.split_pairs(_reposts(spark, sf)))
    model = models.fit_preference(split.filter("not is_test"), ["pair_index"], analyzer=None)
    return rounded(model.select("kind", "feature", "coef"), 4)


@query
def label_study(spark, sf):
    return rounded(pair_study.label_study(_links(spark, sf)))


@query
def label_study_structural(spark, sf):
    """The label study with models on structure alone."""
    return rounded(pair_study.label_study(_links(spark, sf), analyzer=None))


@query
def matched_pairs(spark, sf):
    """The pairs that the models of the label study are fitted to."""
    return pair_study.matched_pairs(pair_study.study_posts(_links(spark, sf)))


# ---------------------------------------------------------------- scoring surface


@query
def score_titles(spark, sf):
    return rounded(_scored_drafts(spark, sf).drop("prediction"))


@query
def verdicts(spark, sf):
    posts = _clean(spark, sf).withColumn("band", F.pmod("score", F.lit(101)).cast("double"))
    return posts.groupBy(verdict(F.col("band")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query
def rank_drafts(spark, sf):
    ranked = score.rank_drafts(_scored_drafts(spark, sf))
    return rounded(ranked.drop("prediction", "title"))


@query
def strongest_draft(spark, sf):
    return rounded(score.strongest_draft(_scored_drafts(spark, sf)))


@query
def explain(spark, sf):
    explained = score.explain(_scored_drafts(spark, sf, with_features=True))
    return rounded(score.explanation_rows(explained, ["request_id", "position"]))


@query
def explanation_text(spark, sf):
    explained = score.explain(_scored_drafts(spark, sf, with_features=True), k=3)
    return explained.select(
        "request_id", "position",
        score.explanation_text(F.col("boosts")).alias("boosted_by"),
        score.explanation_text(F.col("hurts")).alias("hurt_by"),
    )


@query
def confidence(spark, sf):
    return rounded(score.confidence(_metrics(spark, sf)))


@query
def ranked_report(spark, sf):
    """Drafts ranked per request with reasons and confidence, by the closed-form model."""
    labelled, model = _fixed(spark, sf)
    metrics = cut_lineage(training.metrics_of(training.evaluate_model(labelled, model)))
    return rounded(draft_report(fixtures.drafts(spark, sf), model, metrics))


