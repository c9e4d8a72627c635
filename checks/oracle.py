"""The same results in plain SQL for DuckDB, written from the definitions in FIXTURES.md.

``_CTES`` holds named sub-queries; an oracle names the ones it starts from and their own
dependencies follow.
"""

from __future__ import annotations

import re

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WORDS = r"[\p{L}\p{N}_]{2,}"
STRIPPED_LINE = f"regexp_replace(line, '^{SPACES}|{SPACES}$', '', 'g')"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WANTED = "('src0', 'src3', 'src7', 'src11', 'src19')"
CLEAN = "id, title, subreddit, score, num_comments, year, created_utc"
STRUCTURAL = [
    "n_words", "n_chars", "avg_word_len", "has_number",
    "has_question", "has_exclaim", "caps_ratio", "starts_wh",
]
ALPHAS = (0.1, 1.0, 10.0, 100.0)
COEFS = {
    "n_words": 0.01, "n_chars": -0.01, "avg_word_len": 0.02, "has_number": 0.03,
    "has_question": -0.02, "has_exclaim": 0.015, "caps_ratio": -0.03, "starts_wh": 0.025,
}


def flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SPACES}', ' ', 'g'))"


def whole(text: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({text}), '[+-]?[0-9]+') THEN CAST(trim({text}) AS BIGINT) END"


def hash_order(text: str, seed: int = 0) -> str:
    return f"CAST('0x' || substr(md5({text} || '#{seed}'), 1, 8) AS BIGINT)"


def clean_sql(raw: str, bad_time: str, extra: str = "") -> str:
    year = "CAST(coalesce(year(make_timestamp(created_utc * 1000000)), 0) AS INTEGER)"
    timed = "AND created_utc IS NOT NULL" if bad_time == "drop" else ""
    return f"""
      SELECT id, title, subreddit, score, num_comments, {year} AS year, created_utc {extra}
      FROM (SELECT id, {flat('title')} AS title, subreddit, {whole('score')} AS score,
                   coalesce({whole('num_comments')}, 0) AS num_comments,
                   {whole('created_utc')} AS created_utc {extra}
            FROM {raw})
      WHERE title NOT IN ('[deleted]', '[removed]', '') AND score >= 1 {timed}"""


def structural_sql(table: str, keys: str) -> str:
    text = "coalesce(title, '')"
    words = f"CASE WHEN {flat(text)} = '' THEN 0 ELSE len(string_split({flat(text)}, ' ')) END"
    first = f"trim(lower(string_split({flat(text)}, ' ')[1]), '?.!,\"''')"
    letters = f"length(regexp_replace({text}, '[^\\p{{L}}]', '', 'g'))"
    upper = f"length(regexp_replace({text}, '[^\\p{{Lu}}]', '', 'g'))"
    return f"""
      SELECT {keys}, CAST({words} AS DOUBLE) AS n_words, CAST(length({text}) AS DOUBLE) AS n_chars,
        CASE WHEN {words} > 0 THEN length({text}) / CAST({words} AS DOUBLE) ELSE 0.0 END AS avg_word_len,
        CAST(regexp_matches({text}, '\\p{{Nd}}') AS INTEGER)::DOUBLE AS has_number,
        CAST(contains({text}, '?') AS INTEGER)::DOUBLE AS has_question,
        CAST(contains({text}, '!') AS INTEGER)::DOUBLE AS has_exclaim,
        CASE WHEN {letters} > 0 THEN {upper} / CAST({letters} AS DOUBLE) ELSE 0.0 END AS caps_ratio,
        CAST({first} IN ('what','why','how','when','where','who','which','whose','whom') AS INTEGER)::DOUBLE AS starts_wh
      FROM {table}"""


def terms_sql(table: str, keys: str) -> str:
    """(keys, feature, tf) of words and bigrams."""
    return f"""
      SELECT {keys}, feature, count(*) AS tf FROM (
        SELECT {keys}, tok AS feature FROM ({_tokens(table, keys)})
        UNION ALL
        SELECT {keys}, tok || ' ' || nxt FROM (
          SELECT {keys}, tok, lead(tok) OVER (PARTITION BY {keys} ORDER BY pos) AS nxt
          FROM ({_tokens(table, keys)})) WHERE nxt IS NOT NULL)
      GROUP BY {keys}, feature"""


def _tokens(table: str, keys: str) -> str:
    return f"""
      SELECT {keys}, generate_subscripts(w, 1) AS pos, unnest(w) AS tok
      FROM (SELECT {keys}, regexp_extract_all(lower(title), '{WORDS}') AS w FROM {table})"""


def vocabulary_sql(terms: str, docs: str, min_df: int, top: int, group: str = "subreddit") -> str:
    return f"""
      SELECT {group}, feature, tf, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (
        SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY tf DESC, feature) AS rn
        FROM (SELECT {group}, feature, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df
              FROM {terms} GROUP BY {group}, feature HAVING count(*) >= {min_df}))
      JOIN (SELECT {group}, count(*) AS n FROM {docs} GROUP BY {group}) USING ({group})
      WHERE rn <= {top}"""


def weights_sql(terms: str, vocab: str, keys: str) -> str:
    """(keys, subreddit, feature, weight): unit-length tf-idf."""
    return f"""
      SELECT {keys}, feature, v / sqrt(sum(v * v) OVER (PARTITION BY {keys})) AS weight
      FROM (SELECT t.*, (1 + ln(t.tf::DOUBLE)) * v.idf AS v
            FROM {terms} t JOIN {vocab} v USING (subreddit, feature))"""


def scaler_sql(structure: str, group: str = "subreddit") -> str:
    parts = []
    for name in STRUCTURAL:
        parts.append(
            f"SELECT {group}, '{name}' AS feature, avg({name}) AS center, "
            f"CASE WHEN stddev_pop({name}) > 0 THEN 1 / stddev_pop({name}) ELSE 1.0 END AS factor "
            f"FROM {structure} GROUP BY {group}"
        )
    return " UNION ALL ".join(parts)


def unpivot_sql(structure: str, keys: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS feature, {name} AS raw FROM {structure}" for name in STRUCTURAL
    )


def model_sql(vocab: str, terms: str, labelled: str, scaler: str) -> str:
    """(subreddit, kind, feature, center, factor, coef) of the closed-form model."""
    cases = " ".join(f"WHEN '{name}' THEN {value}" for name, value in COEFS.items())
    return f"""
      WITH means AS (SELECT subreddit, avg(label) AS m FROM {labelled} GROUP BY subreddit)
      SELECT subreddit, 't' AS kind, feature, 0.0::DOUBLE AS center, idf AS factor, a - m AS coef
      FROM {vocab} JOIN (SELECT subreddit, feature, avg(label) AS a
                         FROM {terms} JOIN {labelled} USING (subreddit, id)
                         GROUP BY subreddit, feature) USING (subreddit, feature)
      JOIN means USING (subreddit)
      UNION ALL
      SELECT subreddit, 's', feature, center, factor, (CASE feature {cases} END)::DOUBLE FROM {scaler}
      UNION ALL
      SELECT subreddit, 'i', '(intercept)', 0.0::DOUBLE, 1.0::DOUBLE, m FROM means"""


def ridge_sql(values: str, labelled: str, alphas: tuple[float, ...], folds: int = 0) -> str:
    """Sub-queries for ridge models by elimination. ``values``: (subreddit, id, feature, v).

    ``solved`` has a row per community, system (a fold is left out; the last has all rows) and penalty:
    the centred matrix with the penalty on its diagonal is swept next to a unit matrix and the right
    side, so ``m`` ends with the inverse and the coefficients.
    """
    grid = ", ".join(str(a) for a in alphas)
    fold = f"{hash_order('CAST(id AS VARCHAR)', 1)} % {folds}" if folds else "-1"
    return f"""
      numbered AS (SELECT subreddit, feature, row_number() OVER (PARTITION BY subreddit ORDER BY feature) AS f, count(*) OVER (PARTITION BY subreddit) AS w
        FROM (SELECT DISTINCT subreddit, feature FROM {values})),
      labels_ AS (SELECT subreddit, id, label, {fold} AS fold FROM {labelled}),
      systems AS (SELECT unnest(range({folds + 1})) AS sys),
      part AS (SELECT l.*, s.sys FROM labels_ l JOIN systems s ON s.sys = {folds} OR l.fold <> s.sys),
      size_ AS (SELECT subreddit, sys, count(*) AS n, avg(label) AS ym FROM part GROUP BY subreddit, sys),
      cell AS (SELECT p.subreddit, p.sys, p.id, n.f, v.v, p.label FROM part p JOIN {values} v USING (subreddit, id) JOIN numbered n USING (subreddit, feature)),
      means_ AS (SELECT s.subreddit, s.sys, x.f, coalesce(sum(c.v), 0) / any_value(s.n) AS mv, coalesce(sum(c.v * c.label), 0) - coalesce(sum(c.v), 0) * any_value(s.ym) AS rhs
        FROM size_ s JOIN numbered x USING (subreddit) LEFT JOIN cell c ON c.subreddit = s.subreddit AND c.sys = s.sys AND c.f = x.f GROUP BY s.subreddit, s.sys, x.f),
      both_ AS (SELECT a.subreddit, a.sys, a.f AS i, b.f AS j, sum(a.v * b.v) AS s FROM cell a JOIN cell b USING (subreddit, sys, id) GROUP BY a.subreddit, a.sys, a.f, b.f),
      product AS (SELECT a.subreddit, a.sys, a.f AS i, b.f AS j, coalesce(s, 0) - z.n * a.mv * b.mv AS s, a.rhs, z.n, z.ym
        FROM means_ a JOIN means_ b USING (subreddit, sys) JOIN size_ z USING (subreddit, sys) LEFT JOIN both_ q ON q.subreddit = a.subreddit AND q.sys = a.sys AND q.i = a.f AND q.j = b.f),
      line AS (SELECT subreddit, sys, alpha, i, any_value(n) AS n, any_value(ym) AS ym,
          list_concat(list_concat(list(s + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY j), list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END ORDER BY j)), [any_value(rhs)]) AS r
        FROM product JOIN (SELECT unnest([{grid}]::DOUBLE[]) AS alpha) ON true GROUP BY subreddit, sys, alpha, i),
      sweep AS (
        SELECT subreddit, sys, alpha, any_value(n) AS n, any_value(ym) AS ym, count(*) AS w, 0 AS k, list(r ORDER BY i) AS m FROM line GROUP BY subreddit, sys, alpha
        UNION ALL
        SELECT subreddit, sys, alpha, n, ym, w, k + 1, [CASE WHEN i = k + 1 THEN [x / m[k + 1][k + 1] FOR x IN m[k + 1]]
          ELSE [m[i][j] - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j] FOR j IN range(1, 2 * w + 2)] END FOR i IN range(1, w + 1)]
        FROM sweep WHERE k < w),
      solved AS (SELECT * EXCLUDE (k) FROM sweep WHERE k = w),
      weight_ AS (SELECT s.subreddit, s.sys, s.alpha, s.n, s.ym, x.f, x.feature, a.mv, s.m[x.f][2 * w + 1] AS coef, s.m[x.f][w + 1:2 * w] AS inverse
        FROM solved s JOIN numbered x USING (subreddit, w) JOIN means_ a ON a.subreddit = s.subreddit AND a.sys = s.sys AND a.f = x.f),
      base_ AS (SELECT subreddit, sys, alpha, any_value(ym) - sum(mv * coef) AS intercept FROM weight_ GROUP BY subreddit, sys, alpha)"""


def fold_choice_sql(values: str, folds: int) -> str:
    """(subreddit, alpha, error) with the least squared error on the left-out folds."""
    return f"""
      SELECT subreddit, min({{'e': error, 'a': alpha}}).a AS alpha, min({{'e': error, 'a': alpha}}).e AS error FROM (
        SELECT subreddit, alpha, sum((label - p) * (label - p)) AS error FROM (
          SELECT l.subreddit, l.id, w.alpha, any_value(l.label) AS label, any_value(b.intercept) + sum(v.v * w.coef) AS p
          FROM labels_ l JOIN {values} v USING (subreddit, id) JOIN weight_ w ON w.subreddit = l.subreddit AND w.sys = l.fold AND w.feature = v.feature
          JOIN base_ b ON b.subreddit = w.subreddit AND b.sys = w.sys AND b.alpha = w.alpha
          WHERE l.fold < {folds} GROUP BY l.subreddit, l.id, w.alpha) GROUP BY subreddit, alpha) GROUP BY subreddit"""


def left_out_choice_sql(values: str, folds: int) -> str:
    """(subreddit, alpha, error) with the least squared error of rows left out one by one."""
    return f"""
      SELECT subreddit, min({{'e': error, 'a': alpha}}).a AS alpha, min({{'e': error, 'a': alpha}}).e AS error FROM (
        SELECT subreddit, alpha, sum(pow((label - p) / (1 - h), 2)) AS error FROM (
          SELECT l.subreddit, l.id, w.alpha, any_value(l.label) AS label, any_value(w.ym) + sum((v.v - w.mv) * w.coef) AS p,
            1.0 / any_value(w.n) + list_dot_product(list(v.v - w.mv ORDER BY w.f), list(list_dot_product(w.inverse, z.x) ORDER BY w.f)) AS h
          FROM labels_ l JOIN {values} v USING (subreddit, id) JOIN weight_ w ON w.subreddit = l.subreddit AND w.sys = {folds} AND w.feature = v.feature
          JOIN (SELECT v.subreddit, v.id, list(v.v - a.mv ORDER BY a.f) AS x FROM {values} v JOIN numbered x USING (subreddit, feature)
                JOIN means_ a ON a.subreddit = v.subreddit AND a.sys = {folds} AND a.f = x.f GROUP BY v.subreddit, v.id) z ON z.subreddit = l.subreddit AND z.id = l.id
          GROUP BY l.subreddit, l.id, w.alpha) GROUP BY subreddit, alpha) GROUP BY subreddit"""


def cells_sql(terms: str, structure: str, model: str, keys: str) -> str:
    """(keys, subreddit, kind, feature, raw, value, coef) of every feature of every title."""
    by = f"{keys}, subreddit"
    return f"""
      SELECT {by}, 't' AS kind, feature, tf::DOUBLE AS raw,
             v / sqrt(sum(v * v) OVER (PARTITION BY {by})) AS value, coef
      FROM (SELECT t.*, (1 + ln(t.tf::DOUBLE)) * m.factor AS v, m.coef
            FROM {terms} t JOIN {model} m USING (subreddit, feature) WHERE m.kind = 't')
      UNION ALL
      SELECT {by}, 's', feature, raw, (raw - center) * factor, coef
      FROM ({unpivot_sql(structure, by)}) JOIN {model} m USING (subreddit, feature)
      WHERE m.kind = 's'
      UNION ALL
      SELECT {by}, 'i', '(intercept)', 1.0, 1.0, coef
      FROM {structure} JOIN {model} m USING (subreddit) WHERE m.kind = 'i'"""


def predictions_sql(cells: str, by: str) -> str:
    return f"SELECT {by}, sum(value * coef) AS prediction FROM {cells} GROUP BY {by}"


BAND = "round(least(greatest(prediction, 0.0), 1.0) * 100, 9)"


def verdict_sql(band: str) -> str:
    return (
        f"CASE WHEN {band} >= 75 THEN 'strong' WHEN {band} >= 50 THEN 'above average' "
        f"WHEN {band} >= 25 THEN 'below average' ELSE 'weak' END"
    )


def spearman_sql(table: str, x: str, y: str, out: str) -> str:
    def rank(c: str) -> str:
        return (
            f"rank() OVER (PARTITION BY subreddit ORDER BY {c}) + "
            f"(count(*) OVER (PARTITION BY subreddit, {c}) - 1) / 2.0"
        )

    return f"""
      SELECT subreddit, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS {out}
      FROM (SELECT subreddit, {rank(x)} AS a, {rank(y)} AS b FROM {table}) GROUP BY subreddit"""


def top_decile_sql(table: str) -> str:
    k = "CAST(greatest(1, round_even(0.1::DOUBLE * n, 0)) AS BIGINT)"
    return f"""
      SELECT subreddit, any_value(n) AS n_test, any_value(k) AS k,
             sum(CASE WHEN rp <= k AND rt <= k THEN 1 ELSE 0 END) / any_value(k)::DOUBLE AS top10_model,
             any_value(k) / any_value(n)::DOUBLE AS top10_random
      FROM (SELECT *, {k} AS k FROM (
        SELECT subreddit, count(*) OVER (PARTITION BY subreddit) AS n,
               row_number() OVER (PARTITION BY subreddit ORDER BY prediction DESC, id) AS rp,
               row_number() OVER (PARTITION BY subreddit ORDER BY label DESC, id) AS rt
        FROM {table})) GROUP BY subreddit"""


URL = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"
HOST = f"regexp_replace(lower(regexp_extract(trim(url), '{URL}', 1)), '^www\\.', '')"
SKIP = "('i.redd.it','v.redd.it','reddit.com','www.reddit.com','redd.it','old.reddit.com')"
TRACKERS = (
    "('si','feature','t','start_radio','ref','ref_src','ref_url','fbclid','gclid','share','app',"
    "'smid','partner','sns','spm','source','cmpid','ncid')"
)

_CTES = {
    "lines": """
      SELECT doc_id, source, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
      FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)""",
    "raw_posts": """
      SELECT printf('%x_%x', l.doc_id, l.line_no) AS id,
        CASE WHEN b.toxic = 1 THEN '[removed]' WHEN b.quality = 0 THEN '[deleted]' ELSE l.line END AS title,
        l.source AS subreddit,
        CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'n/a'
             ELSE CAST(CAST(floor(o.o_totalprice / 1000) AS BIGINT) AS VARCHAR) END AS score,
        CASE WHEN o.o_orderstatus = 'P' THEN 'x' ELSE CAST(o.o_custkey AS VARCHAR) END AS num_comments,
        CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '5-LOW' THEN 'unknown'
             ELSE CAST(CAST(epoch(o.o_orderdate) AS BIGINT) AS VARCHAR) END AS created_utc
      FROM lines l JOIN orders o ON o.o_orderkey = (l.doc_id * 15 + l.line_no) % (SELECT count(*) FROM orders)
      LEFT JOIN labels b ON b.doc_id = l.doc_id""",
    "posts": clean_sql("raw_posts", "drop"),
    "raw_months": f"""
      SELECT *, coalesce(strftime(make_timestamp({whole('created_utc')} * 1000000), '%Y-%m'), '0000-00') AS month,
             coalesce({whole('created_utc')}, 0) AS file_order FROM raw_posts""",
    "split": f"""
      SELECT * EXCLUDE (h, n, rn), rn <= CASE WHEN n >= 2 THEN greatest(1, floor(0.2::DOUBLE * n + 0.5)) ELSE 0 END AS is_test
      FROM (SELECT *, row_number() OVER (PARTITION BY subreddit, year ORDER BY h, id) AS rn
            FROM (SELECT *, {hash_order('CAST(id AS VARCHAR)')} AS h,
                         count(*) OVER (PARTITION BY subreddit, year) AS n FROM posts))""",
    "labelled": """
      SELECT * EXCLUDE (e, en, w, wn), CASE WHEN en > 0 THEN e / en::DOUBLE ELSE w / wn::DOUBLE END AS label
      FROM (SELECT *,
        sum((NOT is_test)::INT) OVER (PARTITION BY subreddit, year ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e,
        sum((NOT is_test)::INT) OVER (PARTITION BY subreddit, year) AS en,
        sum((NOT is_test)::INT) OVER (PARTITION BY subreddit ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w,
        sum((NOT is_test)::INT) OVER (PARTITION BY subreddit) AS wn
        FROM split)""",
    "train": "SELECT * FROM labelled WHERE NOT is_test",
    "test": "SELECT * FROM labelled WHERE is_test",
    "terms": terms_sql("posts", "subreddit, id"),
    "train_terms": "SELECT t.* FROM terms t SEMI JOIN train USING (id)",
    "vocab": vocabulary_sql("train_terms", "train", 3, 20000),
    "structure": structural_sql("posts", "subreddit, id"),
    "train_structure": "SELECT s.* FROM structure s SEMI JOIN train USING (id)",
    "scaler": scaler_sql("train_structure"),
    "model": model_sql("vocab", "train_terms", "train", "scaler"),
    "test_structure": "SELECT s.* FROM structure s SEMI JOIN test USING (id)",
    "test_terms": "SELECT t.* FROM terms t SEMI JOIN test USING (id)",
    "test_cells": cells_sql("test_terms", "test_structure", "model", "id"),
    "predicted": f"""
      SELECT p.subreddit, p.id, t.label, s.n_words, round(p.prediction, 9) AS prediction
      FROM ({predictions_sql('test_cells', 'subreddit, id')}) p JOIN test t USING (id)
      JOIN structure s USING (id)""",
    "evaluation": f"""
      SELECT subreddit, n_train, n_test, rho_naive, rho_model, top10_model, top10_random
      FROM (SELECT subreddit, count(*) AS n_train FROM train GROUP BY subreddit)
      JOIN ({top_decile_sql('predicted')}) USING (subreddit)
      LEFT JOIN ({spearman_sql('predicted', 'n_words', 'label', 'rho_naive')}) USING (subreddit)
      LEFT JOIN ({spearman_sql('predicted', 'prediction', 'label', 'rho_model')}) USING (subreddit)""",
    # drafts
    "drafts": f"""
      SELECT request_id, position + line_no AS position, subreddit, {STRIPPED_LINE} AS title FROM (
        SELECT conv_id AS request_id, 'src' || (conv_id % 21) AS subreddit, turn * 1000000 AS position,
               generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
        FROM (SELECT *, string_split_regex(text, '{LINE_END}') AS parts FROM conversations))
      WHERE {STRIPPED_LINE} <> ''""",
    "draft_terms": terms_sql("drafts", "request_id, position, subreddit"),
    "draft_structure": structural_sql("drafts", "request_id, position, subreddit"),
    "draft_cells": cells_sql("draft_terms", "draft_structure", "model", "request_id, position"),
    "scored": f"""
      SELECT request_id, position, subreddit, title, CASE WHEN prediction IS NOT NULL THEN {BAND} END AS band,
             CASE WHEN prediction IS NOT NULL THEN {verdict_sql(BAND)} END AS verdict,
             CASE WHEN prediction IS NULL THEN 'no model for ' || subreddit END AS error
      FROM drafts LEFT JOIN ({predictions_sql('draft_cells', 'request_id, position')}) USING (request_id, position)""",
    "ranked": """
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY band DESC NULLS LAST, position) AS rank,
             CASE WHEN band IS NULL THEN 'no model' WHEN count(*) OVER (PARTITION BY request_id) < 2 THEN 'too few drafts'
                  ELSE 'ranked' END AS status
      FROM scored""",
    "reasons": """
      SELECT request_id, position, direction, label, contribution,
             row_number() OVER (PARTITION BY request_id, position, direction ORDER BY abs(contribution) DESC, label) AS k
      FROM (SELECT request_id, position, CASE WHEN c > 0 THEN 'boost' ELSE 'hurt' END AS direction, c AS contribution,
              CASE WHEN kind = 't' THEN '"' || feature || '"'
                WHEN feature = 'has_number' THEN CASE WHEN raw >= 0.5 THEN 'contains a number' ELSE 'no number' END
                WHEN feature = 'has_question' THEN CASE WHEN raw >= 0.5 THEN 'phrased as a question' ELSE 'not a question' END
                WHEN feature = 'has_exclaim' THEN CASE WHEN raw >= 0.5 THEN 'has an exclamation mark' ELSE 'no exclamation mark' END
                WHEN feature = 'starts_wh' THEN CASE WHEN raw >= 0.5 THEN 'opens with what/why/how' ELSE 'no what/why/how opener' END
                WHEN feature = 'n_words' THEN 'title length (words)' WHEN feature = 'n_chars' THEN 'title length (characters)'
                WHEN feature = 'avg_word_len' THEN 'average word length' ELSE 'capitalization' END AS label
            FROM (SELECT *, round(value * coef, 12) AS c FROM draft_cells WHERE kind <> 'i') WHERE abs(c) > 1e-9)""",
    "reason_text": """
      SELECT s.request_id, s.position, {k} AS top,
        coalesce(string_agg(r.label, ', ' ORDER BY r.k) FILTER (r.direction = 'boost' AND r.k <= {k}), '(nothing notable)') AS boosted_by,
        coalesce(string_agg(r.label, ', ' ORDER BY r.k) FILTER (r.direction = 'hurt' AND r.k <= {k}), '(nothing notable)') AS hurt_by
      FROM scored s LEFT JOIN reasons r USING (request_id, position) GROUP BY s.request_id, s.position""",
    "trust": """
      SELECT subreddit, rho_model AS rho,
        CASE WHEN rho_model IS NULL THEN 'unknown' WHEN rho_model >= 0.25 THEN 'high' WHEN rho_model >= 0.15 THEN 'moderate' ELSE 'low' END AS level,
        CASE WHEN rho_model IS NULL THEN 'No reliability metric stored for this subreddit.'
          WHEN rho_model >= 0.25 THEN 'Titles are fairly predictive in this subreddit.'
          WHEN rho_model >= 0.15 THEN 'Titles carry modest signal here; treat scores as directional.'
          ELSE 'This subreddit is not very title-predictable (upvotes barely track the title), so treat the score as a rough guess.' END AS note
      FROM evaluation""",
    # links and pairs
    "raw_links": f"""
      SELECT 'l' || printf('%x', e.event_id) AS id, regexp_extract({HOST}, '([^.]+)$', 1) AS sub, p.url,
        CASE WHEN e.event_id % 3 = 0 THEN regexp_extract(p.html, '<title>([^<]*)</title>', 1) ELSE split_part(d.text, chr(10), 1) END AS title, CAST(floor(e.value) AS BIGINT) AS score,
        CAST(regexp_extract(e.props, '([0-9]+)', 1) AS DOUBLE) / 100 AS upvote_ratio, e.user_id AS num_comments,
        CAST(floor(epoch(e.ts)) AS BIGINT) AS created_utc, e.event_type = 'signup' AS is_self
      FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
      JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)""",
    "url_parts": f"""
      SELECT DISTINCT url, {HOST} AS host, regexp_replace(regexp_extract(trim(url), '{URL}', 2), '/+$', '') AS path,
             string_split(regexp_extract(trim(url), '{URL}', 3), '&') AS q FROM pages""",
    "url_params": f"""
      SELECT url, string_agg(replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+'), '&' ORDER BY k, v) AS qs
      FROM (SELECT url, url_decode(replace(regexp_extract(part, '^([^=]*)=', 1), '+', ' ')) AS k,
                   url_decode(replace(regexp_replace(part, '^[^=]*=', ''), '+', ' ')) AS v
            FROM (SELECT url, unnest(q) AS part FROM url_parts) WHERE regexp_matches(part, '^[^=]*=.+$'))
      WHERE lower(k) NOT IN {TRACKERS} AND NOT starts_with(lower(k), 'utm') GROUP BY url""",
    "nurls": f"""
      SELECT url, CASE WHEN host <> '' AND host NOT IN {SKIP}
                       THEN host || path || CASE WHEN qs IS NULL THEN '' ELSE '?' || qs END END AS nurl
      FROM url_parts LEFT JOIN url_params USING (url)""",
    "full_links": f"""
      SELECT r.sub, n.nurl, {flat('r.title')} AS title, r.score, r.upvote_ratio, r.num_comments, r.id, r.created_utc
      FROM raw_links r JOIN nurls n USING (url)
      WHERE NOT r.is_self AND n.nurl IS NOT NULL AND {flat('r.title')} NOT IN ('[deleted]', '[removed]', '')""",
    "links": """
      SELECT * FROM full_links""",
    "groups": """
      SELECT sub, nurl, count(*) AS n_posts, count(DISTINCT title) AS n_titles, min(score) AS min_score, max(score) AS max_score,
             (max(score) + 1) / (min(score) + 1)::DOUBLE AS ratio
      FROM links GROUP BY sub, nurl HAVING count(*) >= 2 AND count(DISTINCT title) >= 2""",
    "ordered_links": "SELECT *, row_number() OVER (PARTITION BY sub, nurl ORDER BY created_utc DESC, id) AS pos FROM links",
    "reposts": """
      SELECT DISTINCT subreddit, nurl, title_win, score_win, title_lose, score_lose FROM (
        SELECT a.sub AS subreddit, a.nurl, CASE WHEN a.score > b.score THEN a.title ELSE b.title END AS title_win,
          greatest(a.score, b.score) AS score_win, CASE WHEN a.score > b.score THEN b.title ELSE a.title END AS title_lose,
          least(a.score, b.score) AS score_lose,
          row_number() OVER (PARTITION BY a.sub, a.nurl ORDER BY a.pos, b.pos) AS rn
        FROM ordered_links a JOIN ordered_links b ON a.sub = b.sub AND a.nurl = b.nurl AND a.pos < b.pos
          AND a.title <> b.title AND a.score <> b.score) WHERE rn <= 10""",
    "variants": """
      SELECT l_suppkey AS clickability_test_id, l_linestatus AS eyecatcher_id, p_name AS headline, sum(l_quantity) AS impressions,
             sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS clicks
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "rates": f"""
      SELECT clickability_test_id, eyecatcher_id, impressions, {STRIPPED_LINE.replace('line,', 'headline,')} AS headline, clicks / impressions AS ctr
      FROM variants WHERE impressions >= 100""",
    "ab": """
      SELECT title_win, title_lose, ctr_win, ctr_lose, CAST(clickability_test_id AS VARCHAR) AS group_id, 'ab_test' AS source FROM (
        SELECT *, row_number() OVER (PARTITION BY title_win, title_lose ORDER BY clickability_test_id, eyecatcher_id) AS rn FROM (
          SELECT a.clickability_test_id, a.eyecatcher_id, a.headline AS title_win, b.headline AS title_lose, a.ctr AS ctr_win, b.ctr AS ctr_lose
          FROM rates a JOIN rates b ON a.clickability_test_id = b.clickability_test_id AND a.eyecatcher_id = b.eyecatcher_id
            AND a.headline <> b.headline AND a.ctr > b.ctr)) WHERE rn = 1""",
    "timed": """
      SELECT *, hour(make_timestamp(created_utc * 1000000)) AS hour, isodow(make_timestamp(created_utc * 1000000)) >= 6 AS weekend FROM links""",
    "dual": """
      SELECT a.sub, a.nurl, a.title AS ta, b.title AS tb, a.score::DOUBLE AS sa, b.score::DOUBLE AS sb, a.upvote_ratio AS ua, b.upvote_ratio AS ub,
        least(abs(a.hour - b.hour), 24 - abs(a.hour - b.hour)) <= 3 AND a.weekend = b.weekend AS time_matched,
        (greatest(a.score, b.score) + 1) / (least(a.score, b.score) + 1)::DOUBLE AS sratio,
        a.hour AS ha, b.hour AS hb, a.weekend AS wa, b.weekend AS wb
      FROM timed a JOIN timed b ON a.sub = b.sub AND a.nurl = b.nurl AND a.title < b.title""",
    "balanced": f"""
      SELECT *, CASE WHEN pair_index % 2 = 0 THEN title_win ELSE title_lose END AS title_a,
             CASE WHEN pair_index % 2 = 0 THEN title_lose ELSE title_win END AS title_b, (pair_index % 2 = 0)::INTEGER AS y
      FROM (SELECT *, row_number() OVER (ORDER BY h, subreddit, nurl, title_win, score_win, title_lose, score_lose) - 1 AS pair_index
            FROM (SELECT *, {hash_order("concat_ws(chr(31), subreddit, nurl, title_win, CAST(score_win AS VARCHAR), title_lose, CAST(score_lose AS VARCHAR))")} AS h FROM reposts))""",
    "modelled": "SELECT sub AS subreddit FROM links GROUP BY sub HAVING count(*) >= 2000",
    # link models
    "link_posts": """
      SELECT id, title, sub AS subreddit, score,
        count(*) OVER (PARTITION BY sub ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (count(*) OVER (PARTITION BY sub))::DOUBLE AS label
      FROM links""",
    "link_terms": terms_sql("link_posts", "subreddit, id"),
    "link_vocab": vocabulary_sql("link_terms", "link_posts", 3, 20000),
    "link_structure": structural_sql("link_posts", "subreddit, id"),
    "link_scaler": scaler_sql("link_structure"),
    "link_model": model_sql("link_vocab", "link_terms", "link_posts", "link_scaler"),
    "link_cells": cells_sql("link_terms", "link_structure", "link_model", "id"),
    "title_bands": f"""
      SELECT DISTINCT subreddit, title, {BAND} AS band
      FROM ({predictions_sql('link_cells', 'subreddit, id')}) JOIN link_posts USING (subreddit, id)""",
    "judged": """
      SELECT r.*, w.band AS band_win, l.band AS band_lose,
        CASE WHEN m >= 1 AND m < 2 THEN '<2x' WHEN m >= 2 AND m < 5 THEN '2-5x' WHEN m >= 5 AND m < 20 THEN '5-20x' WHEN m >= 20 AND m < 1e9 THEN '>20x' END AS margin
      FROM (SELECT *, (score_win + 1) / (score_lose + 1)::DOUBLE AS m FROM reposts) r
      JOIN title_bands w ON w.subreddit = r.subreddit AND w.title = r.title_win
      JOIN title_bands l ON l.subreddit = r.subreddit AND l.title = r.title_lose""",
    # pair preference on structure
    "pair_sides_of": f"""
      SELECT nurl, row_number() OVER (ORDER BY {hash_order('nurl')}) <= ceil(0.25 * count(*) OVER ()) AS is_test FROM (SELECT DISTINCT nurl FROM reposts)""",
    "split_pairs": "SELECT b.*, g.is_test FROM balanced b JOIN pair_sides_of g USING (nurl)",
    "pref_sides": """
      SELECT pair_index, 1.0::DOUBLE AS side, 'all' AS subreddit, is_test, y, title_a AS title FROM split_pairs
      UNION ALL SELECT pair_index, -1.0, 'all', is_test, y, title_b FROM split_pairs""",
    "pref_structure": structural_sql("pref_sides", "pair_index, side, subreddit, is_test, y"),
    "pref_scaler": scaler_sql("(SELECT * FROM pref_structure WHERE NOT is_test)"),
    "pref_rows": f"""
      SELECT pair_index, is_test, y, list_append(list(d ORDER BY f), 1.0::DOUBLE) AS x FROM (
        SELECT pair_index, is_test, y, list_position({STRUCTURAL}, feature) AS f, sum((raw - center) * factor * side) AS d
        FROM ({unpivot_sql('pref_structure', 'pair_index, side, subreddit, is_test, y')}) JOIN pref_scaler USING (subreddit, feature)
        GROUP BY pair_index, is_test, y, feature) GROUP BY pair_index, is_test, y""",
    # Newton steps; each solves its equations by elimination, folded over the columns.
    "newton": f"""
      SELECT 0 AS step, [0.0::DOUBLE FOR i IN range(9)] AS t
      UNION ALL
      SELECT step + 1, [t[i] - list_reduce(list_prepend(m, [[[k::DOUBLE]] FOR k IN range(1, 10)]), lambda a, q:
          [CASE WHEN r = q[1][1] THEN [v / a[q[1][1]::INT][q[1][1]::INT] FOR v IN a[r]]
           ELSE [a[r][c] - a[r][q[1][1]::INT] / a[q[1][1]::INT][q[1][1]::INT] * a[q[1][1]::INT][c] FOR c IN range(1, 11)] END FOR r IN range(1, 10)])[i][10] FOR i IN range(1, 10)]
      FROM (SELECT step, any_value(t) AS t, list(r ORDER BY i) AS m FROM (
        SELECT step, i, any_value(t) AS t, list_append(list(s ORDER BY j), any_value(g)) AS r FROM (
          SELECT n.step, i, j, any_value(n.t) AS t, sum(p * (1 - p) * x[i] * x[j]) + any_value(CASE WHEN i = j AND i < 9 THEN 1 ELSE 0 END) AS s,
            sum((p - y) * x[i]) + any_value(CASE WHEN i < 9 THEN n.t[i] ELSE 0 END) AS g
          FROM newton n CROSS JOIN (SELECT unnest(range(1, 10)) AS i) CROSS JOIN (SELECT unnest(range(1, 10)) AS j)
          JOIN (SELECT x, y, 0 AS one FROM pref_rows WHERE NOT is_test) d ON true
          CROSS JOIN LATERAL (SELECT 1 / (1 + exp(-list_dot_product(d.x, n.t))) AS p)
          WHERE n.step < 12 GROUP BY n.step, i, j) GROUP BY step, i) GROUP BY step)""",
    "held_posts": """
      SELECT id, title, sub AS subreddit, score,
        count(*) OVER (PARTITION BY sub ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (count(*) OVER (PARTITION BY sub))::DOUBLE AS label
      FROM links WHERE nurl NOT IN (SELECT nurl FROM split_pairs WHERE is_test)""",
    "held_terms": terms_sql("held_posts", "subreddit, id"),
    "held_vocab": vocabulary_sql("held_terms", "held_posts", 3, 20000),
    "held_structure": structural_sql("held_posts", "subreddit, id"),
    "held_scaler": scaler_sql("held_structure"),
    "held_model": model_sql("held_vocab", "held_terms", "held_posts", "held_scaler"),
    "asked": """
      SELECT subreddit, title_win AS title FROM split_pairs WHERE is_test UNION SELECT subreddit, title_lose FROM split_pairs WHERE is_test""",
    "asked_terms": terms_sql("asked", "subreddit, title"),
    "asked_structure": structural_sql("asked", "subreddit, title"),
    "asked_cells": cells_sql("asked_terms", "asked_structure", "held_model", "title"),
    "asked_bands": f"SELECT subreddit, title, {BAND} AS band FROM ({predictions_sql('asked_cells', 'subreddit, title')})",
    "study": """
      SELECT CASE WHEN m >= 1 AND m < 2 THEN '<2x' WHEN m >= 2 AND m < 5 THEN '2-5x' WHEN m >= 5 AND m < 20 THEN '5-20x' WHEN m >= 20 AND m < 1e9 THEN '>20x' END AS margin,
        (w.band > l.band)::INT AS pointwise, ((round(list_dot_product(d.x, f.t), 9) > 0) = (p.y = 1))::INT AS pairwise
      FROM (SELECT *, (score_win + 1) / (score_lose + 1)::DOUBLE AS m FROM split_pairs WHERE is_test) p
      JOIN asked_bands w ON w.subreddit = p.subreddit AND w.title = p.title_win JOIN asked_bands l ON l.subreddit = p.subreddit AND l.title = p.title_lose
      JOIN pref_rows d USING (pair_index) JOIN (SELECT t FROM newton ORDER BY step DESC LIMIT 1) f ON true""",
    # label study: matched pairs to fit on, all pairs to judge
    "study_groups": "SELECT sub, nurl, count(*) AS n FROM timed WHERE upvote_ratio IS NOT NULL GROUP BY sub, nurl HAVING count(DISTINCT title) > 1",
    "study_sides": f"""
      SELECT nurl, row_number() OVER (ORDER BY {hash_order('nurl')}) <= ceil(0.25 * count(*) OVER ()) AS is_test FROM (SELECT DISTINCT nurl FROM study_groups)""",
    "study_posts": f"""
      SELECT t.id, t.sub, t.nurl, t.title, t.score::DOUBLE AS score, t.upvote_ratio, t.hour, t.weekend, g.n, s.is_test, {hash_order('t.id', 2)} AS h
      FROM timed t JOIN study_groups g USING (sub, nurl) JOIN study_sides s USING (nurl) WHERE t.upvote_ratio IS NOT NULL""",
    "study_slots": """
      SELECT *, 'all' AS condition, 0 AS slot FROM study_posts WHERE NOT is_test
      UNION ALL SELECT *, 'time_matched', hour // 4 + weekend::INT * 24 FROM study_posts WHERE NOT is_test""",
    "study_next": """
      SELECT *, row_number() OVER w AS place, lead(id) OVER w AS id2, lead(title) OVER w AS title2, lead(score) OVER w AS score2, lead(upvote_ratio) OVER w AS ratio2
      FROM study_slots WINDOW w AS (PARTITION BY condition, sub, nurl, slot, h % CAST(ceil(n / 20000.0) AS BIGINT) ORDER BY h, id)""",
    "study_pairs": """
      SELECT cell, pair_id, title_a, title_b FROM (
        SELECT *, row_number() OVER (PARTITION BY cell ORDER BY h, pair_id) AS nth FROM (
          SELECT condition || '/score' AS cell, h, id || '|' || id2 AS pair_id, CASE WHEN score > score2 THEN title ELSE title2 END AS title_a,
            CASE WHEN score > score2 THEN title2 ELSE title END AS title_b FROM study_next WHERE place % 2 = 1 AND id2 IS NOT NULL AND score <> score2 AND title <> title2
          UNION ALL SELECT condition || '/upvote_ratio', h, id || '|' || id2, CASE WHEN upvote_ratio > ratio2 THEN title ELSE title2 END,
            CASE WHEN upvote_ratio > ratio2 THEN title2 ELSE title END FROM study_next WHERE place % 2 = 1 AND id2 IS NOT NULL AND upvote_ratio <> ratio2 AND title <> title2)) WHERE nth <= 5000""",
    "fit_titles": """
      SELECT cell AS subreddit, pair_id, 1.0::DOUBLE AS side, title_a AS title FROM study_pairs UNION ALL SELECT cell, pair_id, -1.0, title_b FROM study_pairs""",
    "fit_structure": structural_sql("fit_titles", "subreddit, pair_id, side"),
    "fit_scaler": scaler_sql("fit_structure"),
    "fit_rows": f"""
      SELECT subreddit, pair_id, list(d ORDER BY f) AS x FROM (
        SELECT subreddit, pair_id, list_position({STRUCTURAL}, feature) AS f, sum((raw - center) * factor * side) AS d
        FROM ({unpivot_sql('fit_structure', 'subreddit, pair_id, side')}) JOIN fit_scaler USING (subreddit, feature)
        GROUP BY subreddit, pair_id, feature) GROUP BY subreddit, pair_id""",
    "worth_steps": f"""
      SELECT subreddit, 0 AS step, [0.0::DOUBLE FOR i IN range(8)] AS t FROM (SELECT DISTINCT subreddit FROM fit_rows)
      UNION ALL
      SELECT subreddit, step + 1, [t[i] - list_reduce(list_prepend(m, [[[k::DOUBLE]] FOR k IN range(1, 9)]), lambda a, q:
          [CASE WHEN r = q[1][1] THEN [v / a[q[1][1]::INT][q[1][1]::INT] FOR v IN a[r]]
           ELSE [a[r][c] - a[r][q[1][1]::INT] / a[q[1][1]::INT][q[1][1]::INT] * a[q[1][1]::INT][c] FOR c IN range(1, 10)] END FOR r IN range(1, 9)])[i][9] FOR i IN range(1, 9)]
      FROM (SELECT subreddit, step, any_value(t) AS t, list(r ORDER BY i) AS m FROM (
        SELECT subreddit, step, i, any_value(t) AS t, list_append(list(s ORDER BY j), any_value(g)) AS r FROM (
          SELECT n.subreddit, n.step, i, j, any_value(n.t) AS t, sum(p * (1 - p) * x[i] * x[j]) + any_value(CASE WHEN i = j THEN 1 ELSE 0 END) AS s,
            sum((p - 1) * x[i]) + any_value(n.t[i]) AS g
          FROM worth_steps n CROSS JOIN (SELECT unnest(range(1, 9)) AS i) CROSS JOIN (SELECT unnest(range(1, 9)) AS j)
          JOIN fit_rows d ON d.subreddit = n.subreddit
          CROSS JOIN LATERAL (SELECT 1 / (1 + exp(-list_dot_product(d.x, n.t))) AS p)
          WHERE n.step < 12 GROUP BY n.subreddit, n.step, i, j) GROUP BY subreddit, step, i) GROUP BY subreddit, step)""",
    "test_titles": "SELECT DISTINCT title FROM study_posts WHERE is_test",
    "title_structure": structural_sql("test_titles", "title"),
    "worths": f"""
      SELECT s.subreddit AS cell, u.title, round(sum((raw - center) * factor * w.t[list_position({STRUCTURAL}, feature)]), 9) AS x
      FROM ({unpivot_sql('title_structure', 'title')}) u JOIN fit_scaler s USING (feature) JOIN worth_steps w ON w.subreddit = s.subreddit AND w.step = 12
      GROUP BY s.subreddit, u.title""",
    "study_labels": """
      SELECT *, 'score' AS label, score AS y FROM study_posts UNION ALL SELECT *, 'upvote_ratio', upvote_ratio FROM study_posts""",
    "judged_pairs": """
      SELECT c.condition || '/' || a.label AS cell, a.nurl, a.is_test, a.title AS ta, b.title AS tb
      FROM study_labels a JOIN study_labels b ON a.label = b.label AND a.sub = b.sub AND a.nurl = b.nurl AND a.y > b.y AND a.title <> b.title
      JOIN (VALUES ('all'), ('time_matched')) c(condition) ON c.condition = 'all' OR (least(abs(a.hour - b.hour), 24 - abs(a.hour - b.hour)) <= 3 AND a.weekend = b.weekend)""",
    "vectors": """
      SELECT p.id, e.embedding FROM raw_posts p JOIN embeddings e ON printf('%x', e.vec_id) = split_part(p.id, '_', 1)""",
}


def build(select: str, **text: object) -> str:
    """``select`` with the sub-queries it names, in dependency order."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"[a-z_]+", sql):
            if name in _CTES and name not in needed and name != current[-1]:
                current.append(name)
                visit(_CTES[name])
                current.pop()
                if name not in needed:
                    needed.append(name)

    current = [""]
    visit(select)
    if not needed:
        return select
    ctes = ",\n".join(f"{name} AS ({_CTES[name]})" for name in needed)
    for key, value in text.items():
        ctes = ctes.replace("{" + key + "}", str(value))
    return f"WITH {ctes}\n{select}"


def _r(*names: str) -> str:
    return ", ".join(f"round({name}, 6) AS {name}" for name in names)


def all_oracles() -> dict[str, str]:
    strided = """SELECT month FROM (SELECT month, row_number() OVER (ORDER BY month) AS rn FROM (SELECT DISTINCT month FROM {t}))
                 WHERE (rn - 1) % 3 = 0"""
    order_month = "strftime(o_orderdate, '%Y-%m')"
    months = f"(SELECT *, {order_month} AS month FROM orders)"
    files = f"(SELECT {order_month} AS month, {order_month} || '_' || o_orderpriority AS file, o_orderkey FROM orders)"
    quota = f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY month, created_utc NULLS FIRST, id) AS r2 FROM (
        SELECT *, row_number() OVER (PARTITION BY subreddit, month ORDER BY created_utc NULLS FIRST, id) AS r1 FROM {{t}})
        WHERE r1 <= {{cap}}) WHERE r2 <= 200"""
    scan = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY file_order, id) AS place FROM {t}) WHERE place <= 60"
    posts_month = "(SELECT *, strftime(make_timestamp(created_utc * 1000000), '%Y-%m') AS month FROM posts)"
    chosen = f"(SELECT * FROM raw_months WHERE month IN ({strided.format(t='raw_months')}))"
    n_files = f"(SELECT ceil(200.0 / count(*)) FROM ({strided.format(t='raw_months')}))"
    historical = clean_sql(
        f"(SELECT * FROM ({scan.format(t=chosen)}) WHERE subreddit IN {WANTED})", "zero", ", month"
    )
    q50, q90, q10 = (f"quantile_cont({{c}}, {p})" for p in (0.5, 0.9, 0.1))
    margin = "CASE WHEN ctr_lose = 0 THEN 'inf'::DOUBLE ELSE ctr_win / nullif(ctr_lose, 0) END"

    def linear_quantile(values: str, p: float) -> str:
        """Between neighbours of a sorted list; infinite ones stay infinite."""
        at = f"((len({values}) - 1) * {p}::DOUBLE)"
        low, high = f"{values}[floor({at})::INT + 1]", f"{values}[ceil({at})::INT + 1]"
        inside = f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * ({at} - floor({at})) END"
        return f"(SELECT CASE WHEN isinf(q) THEN q ELSE round(q, 6) END FROM (SELECT {inside} AS q))"

    cv = "CASE WHEN avg({x}) <> 0 THEN stddev_pop({x}) / avg({x}) ELSE 0 END"
    char_words = f"SELECT subreddit, id, unnest(string_split({flat('lower(title)')}, ' ')) AS w FROM posts"
    char_grams = " UNION ALL ".join(
        f"""SELECT subreddit, id, substr(w, s, {n}) AS feature FROM (
              SELECT subreddit, id, w, unnest(generate_series(1, length(w) - {n} + 1)) AS s
              FROM (SELECT subreddit, id, ' ' || w || ' ' AS w FROM ({char_words}) WHERE w <> '') WHERE length(w) >= {n})"""
        for n in (3, 4, 5)
    )
    pair_sides = """SELECT pair_index, 1.0 AS side, 'all' AS subreddit, title_a AS title FROM balanced
                    UNION ALL SELECT pair_index, -1.0, 'all', title_b FROM balanced"""
    pair_ctes = f"""
      sides AS ({pair_sides}),
      side_terms AS ({terms_sql('sides', 'pair_index, side, subreddit')}),
      side_structure AS ({structural_sql('sides', 'pair_index, side, subreddit')}),
      side_vocab AS ({vocabulary_sql('side_terms', 'sides', 2, 3000)}),
      side_scaler AS ({scaler_sql('side_structure')})"""
    pair_cells = f"""
      SELECT pair_index, kind, feature, round(sum(value * side), 6) AS value FROM (
        SELECT pair_index, side, 't' AS kind, feature, weight AS value
        FROM ({weights_sql('side_terms', 'side_vocab', 'pair_index, side, subreddit')})
        UNION ALL
        SELECT pair_index, side, 's', feature, (raw - center) * factor
        FROM ({unpivot_sql('side_structure', 'pair_index, side, subreddit')}) JOIN side_scaler USING (subreddit, feature))
      GROUP BY pair_index, kind, feature"""
    scaled = f"""SELECT subreddit, id, feature, (raw - center) * factor AS value
                 FROM ({unpivot_sql('structure', 'subreddit, id')}) JOIN scaler USING (subreddit, feature)"""
    mean = ", ".join(
        f"avg({c})" for c in ("n_train", "n_test", "rho_naive", "rho_model", "top10_model", "top10_random")
    )

    structure_values = f"""SELECT subreddit, id, feature, (raw - center) * factor AS v
      FROM ({unpivot_sql('train_structure', 'subreddit, id')}) JOIN scaler USING (subreddit, feature)"""
    few_values = f"""SELECT subreddit, id, 's:' || feature AS feature, v FROM ({structure_values})
      UNION ALL SELECT subreddit, id, 't:' || feature, weight FROM ({weights_sql('train_terms', f"({vocabulary_sql('train_terms', 'train', 3, 12)})", 'subreddit, id')})"""

    def recursive(select: str) -> str:
        return build(select).replace("WITH", "WITH RECURSIVE", 1)

    def fitted(labelled: str, values: str, alphas: tuple[float, ...], folds: int, select: str, more: str = "") -> str:
        """``select`` over ridge models of ``values``, the features of ``labelled``."""
        start = build(f"SELECT 0 AS cut_here, {labelled} {values} {more} {select}").split("SELECT 0 AS cut_here")[0].rstrip()
        extra = "," + more if more else ""
        return f"{start.replace('WITH', 'WITH RECURSIVE', 1)}, values_ AS ({values}), {ridge_sql('values_', labelled, alphas, folds)}{extra} {select}"

    oracles = {
        "clean_posts": build("SELECT * FROM posts"),
        "clean_posts_historical": build(f"SELECT * FROM ({clean_sql('raw_posts', 'zero')})"),
        "community_filter": build(f"SELECT * FROM posts WHERE subreddit IN {WANTED}"),
        "month_stride_scan": f"""SELECT month, o_orderkey, o_custkey, o_orderpriority FROM {months}
                                 WHERE month IN ({strided.format(t=months)})""",
        "first_file_per_month": f"""SELECT month, file, o_orderkey FROM {files}
          WHERE month IN ({strided.format(t=files)}) AND file IN (SELECT min(file) FROM {files} GROUP BY month)""",
        "latest_per_community": build(f"""SELECT {CLEAN} FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY created_utc DESC, id) AS rn
          FROM posts WHERE created_utc < 946684800) WHERE rn <= 100"""),
        "latest_links": build("""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY created_utc DESC, id) AS rn
          FROM full_links) WHERE rn <= 100"""),
        "two_level_quota": build(f"SELECT {CLEAN}, month FROM ({quota.format(t=posts_month, cap=3)})"),
        "scan_bound": build(f"SELECT id, month, subreddit FROM ({scan.format(t='raw_months')})"),
        "historical_sample": build(f"SELECT {CLEAN} FROM ({quota.format(t=f'({historical})', cap=n_files)})"),
        "recent_sample": build(f"""SELECT {CLEAN} FROM (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY created_utc DESC, id) AS rn
          FROM posts WHERE created_utc < 946684800 AND subreddit IN {WANTED}) WHERE rn <= 100"""),
        "dedupe_posts": build("SELECT *, 1 AS pull FROM posts"),
        "norm_urls": build("SELECT page_id, url, nurl FROM pages JOIN nurls USING (url)"),
        "external_links": build("SELECT * FROM full_links"),
        "ab_click_rates": build(f"SELECT clickability_test_id, eyecatcher_id, headline, {_r('impressions', 'ctr')} FROM rates"),
        "ab_csv_round_trip": build("SELECT * REPLACE (CAST(clickability_test_id AS VARCHAR) AS clickability_test_id) FROM variants"),
        "parquet_round_trip": build("SELECT * FROM posts"),
        "rated_links": build("SELECT * REPLACE (score::DOUBLE AS score, num_comments::DOUBLE AS num_comments) FROM links"),
        "posting_times": build("SELECT id, created_utc, hour, weekend FROM timed"),
        "draft_lines": build(f"""SELECT doc_id AS request_id, line_no AS position, source AS subreddit, {STRIPPED_LINE} AS title FROM (
          SELECT doc_id, source, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
          FROM (SELECT doc_id, source, string_split_regex(text, '{LINE_END}') AS parts FROM documents)) WHERE {STRIPPED_LINE} <> ''"""),
        "community_profile": build(f"""SELECT subreddit, count(*) AS n_rows, round({q50.format(c='score')}, 6) AS median_score,
          CAST(floor({q90.format(c='score')}) AS BIGINT) AS p90_score, max(score) AS max_score FROM posts GROUP BY subreddit"""),
        "rows_per_year": build("SELECT year, count(*) AS n_rows FROM posts GROUP BY year"),
        "hash_sample": build(f"SELECT * FROM posts ORDER BY {hash_order('CAST(id AS VARCHAR)')}, id LIMIT 5"),
        "table_summary": build("""SELECT count(*) AS n_rows, count(DISTINCT subreddit) AS n_communities, min(year) AS first_year, max(year) AS last_year FROM posts"""),
        "variant_summary": build(f"""SELECT count(*) AS n_rows, count(DISTINCT clickability_test_id) AS n_tests,
          CAST(floor({q50.format(c='impressions')}) AS BIGINT) AS median_impressions, CAST(floor({q10.format(c='impressions')}) AS BIGINT) AS p10_impressions FROM variants"""),
        "ab_pair_summary": build(f"""SELECT n_pairs, n_groups, {linear_quantile('m', 0.5)} AS median_margin, {linear_quantile('m', 0.9)} AS p90_margin FROM (
          SELECT count(*) AS n_pairs, count(DISTINCT group_id) AS n_groups, list({margin} ORDER BY {margin}) AS m FROM ab)"""),
        "ratio_summary": build(f"""SELECT count(*) AS n_rows, round({q50.format(c='upvote_ratio')}, 6) AS median_ratio,
          round({q10.format(c='upvote_ratio')}, 6) AS p10_ratio FROM links WHERE upvote_ratio IS NOT NULL"""),
        "repost_groups_per_community": build("SELECT sub, count(*) AS n_groups FROM groups GROUP BY sub"),
        "pairs_per_community": build("SELECT subreddit, count(*) AS n_pairs FROM reposts GROUP BY subreddit"),
        "repost_groups": build("SELECT * REPLACE (round(ratio, 6) AS ratio) FROM groups"),
        "noise_floor": build("""SELECT count(*) AS n_groups, round(avg((ratio >= 5)::INT), 6) AS share_5x,
          round((SELECT ratio FROM (SELECT ratio, row_number() OVER (ORDER BY ratio) AS rn, count(*) OVER () AS n FROM groups) WHERE rn = n // 2 + 1), 6) AS median_ratio FROM groups"""),
        "top_posts_per_group": build("""SELECT sub, nurl, place, score, title FROM (
          SELECT *, row_number() OVER (PARTITION BY sub, nurl ORDER BY score DESC, id) AS place FROM links)
          JOIN (SELECT sub, nurl FROM groups WHERE n_titles >= 3) USING (sub, nurl) WHERE place <= 4"""),
        "repost_pairs": build("SELECT * FROM reposts"),
        "ab_pairs": build(f"SELECT title_win, title_lose, {_r('ctr_win', 'ctr_lose')}, group_id, source FROM ab"),
        "dual_label_pairs": build("""SELECT sub, nurl, ta, tb, round(sa, 6) AS sa, round(sb, 6) AS sb, round(ua, 6) AS ua, round(ub, 6) AS ub,
          time_matched, round(sratio, 6) AS sratio, count(*) AS n_pairs FROM dual GROUP BY sub, nurl, ta, tb, sa, sb, ua, ub, time_matched, sratio, ha, hb, wa, wb"""),
        "balanced_pairs": build("SELECT pair_index, nurl, title_a, title_b, y FROM balanced"),
        "symmetric_examples": build("""SELECT group_id, title_win AS title_a, title_lose AS title_b, 1 AS y FROM ab
          UNION ALL SELECT group_id, title_lose, title_win, 0 FROM ab"""),
        "pair_viability": build("""SELECT sub, count(DISTINCT nurl) AS n_groups, count(*) AS n_pairs,
          count(DISTINCT nurl) >= 5 AND count(*) >= 60 AS viable FROM dual GROUP BY sub"""),
        "decisive_reposts": build("SELECT * FROM reposts WHERE (score_win + 1) / (score_lose + 1)::DOUBLE >= 5"),
        "decisive_ab": build(f"SELECT title_win, title_lose, {_r('ctr_win', 'ctr_lose')}, group_id, source FROM ab WHERE ctr_win >= 1.5 * ctr_lose"),
        "within_group_cv": build(f"""SELECT round(median(s), 6) AS cv_score, round(median(u), 6) AS cv_ratio, round(median(c), 6) AS cv_comments FROM (
          SELECT {cv.format(x='(score + 1)')} AS s, {cv.format(x='(upvote_ratio + 0.01)')} AS u, {cv.format(x='(num_comments + 1)')} AS c
          FROM links GROUP BY sub, nurl HAVING count(DISTINCT title) >= 2)"""),
        "winner_agreement": build("""SELECT count(*) AS n_groups, round(avg((s = u)::INT), 6) AS agreement FROM (
          SELECT arg_max(title, (score, id)) AS s, arg_min(title, (-upvote_ratio, id)) AS u FROM links GROUP BY sub, nurl HAVING count(DISTINCT title) >= 2)"""),
        "time_matched_noise": build("""SELECT count(*) AS n_all, round(median(sratio), 6) AS median_all,
          count(*) FILTER (time_matched) AS n_matched, round(median(sratio) FILTER (time_matched), 6) AS median_matched FROM dual"""),
        "stratified_split": build("SELECT id, subreddit, year, is_test FROM split"),
        "group_split": build(f"""SELECT r.*, g.is_test FROM reposts r JOIN (
          SELECT nurl, row_number() OVER (ORDER BY {hash_order('nurl')}) <= ceil(0.25 * count(*) OVER ()) AS is_test FROM (SELECT DISTINCT nurl FROM reposts)) g USING (nurl)"""),
        "ecdf_table": build("""SELECT subreddit, year AS era, score, CAST(sum(count(*)) OVER (PARTITION BY subreddit, year ORDER BY score) AS BIGINT) AS cum_n,
            CAST(sum(count(*)) OVER (PARTITION BY subreddit, year) AS BIGINT) AS n FROM split WHERE NOT is_test GROUP BY subreddit, year, score
          UNION ALL SELECT subreddit, NULL, score, CAST(sum(count(*)) OVER (PARTITION BY subreddit ORDER BY score) AS BIGINT),
            CAST(sum(count(*)) OVER (PARTITION BY subreddit) AS BIGINT) FROM split WHERE NOT is_test GROUP BY subreddit, score"""),
        "era_percentile": build("SELECT id, subreddit, year, score, is_test, round(label, 6) AS label FROM labelled"),
        "structural_features": build(f"SELECT id, {_r(*STRUCTURAL)} FROM structure"),
        "title_terms": build("SELECT * FROM terms"),
        "char_terms": build(f"SELECT subreddit, feature, count(*) AS tf, count(DISTINCT id) AS df FROM ({char_grams}) GROUP BY subreddit, feature"),
        "vocabulary": build(f"SELECT subreddit, feature, tf, df, round(idf, 6) AS idf FROM ({vocabulary_sql('train_terms', 'train', 3, 20000)})"),
        "tfidf": build(f"SELECT subreddit, id, feature, round(weight, 6) AS weight FROM ({weights_sql('terms', 'vocab', 'subreddit, id')})"),
        "ridge_structural": fitted("train", structure_values, (10.0,), 0, "SELECT subreddit, 's' AS kind, feature, round(coef, 4) AS coef FROM weight_"
          " UNION ALL SELECT subreddit, 'i', '(intercept)', round(intercept, 4) FROM base_"),
        "ridge_few_terms": fitted("train", few_values, (10.0,), 0, "SELECT subreddit, feature[1] AS kind, feature[3:] AS feature, round(coef, 4) AS coef FROM weight_"
          " UNION ALL SELECT subreddit, 'i', '(intercept)', round(intercept, 4) FROM base_"),
        "loo_alpha": fitted("train", structure_values, ALPHAS, 3, f"""SELECT subreddit, o.alpha AS loo_alpha, round(o.error, 4) AS loo_error, f.alpha AS fold_alpha, round(f.error, 4) AS fold_error,
          o.alpha = f.alpha AS same FROM ({left_out_choice_sql('values_', 3)}) o JOIN ({fold_choice_sql('values_', 3)}) f USING (subreddit)"""),
        "ridge_structural_evaluation": fitted("train", structure_values, ALPHAS, 3, f"""SELECT subreddit, {_r('n_train', 'n_test', 'rho_naive', 'rho_model', 'top10_model', 'top10_random')}, alpha FROM (
          SELECT * FROM trained_rows UNION ALL SELECT 'MEAN', {mean}, avg(alpha) FROM trained_rows)""", f"""
          chosen AS ({fold_choice_sql('values_', 3)}),
          test_values AS (SELECT subreddit, id, feature, (raw - center) * factor AS v FROM ({unpivot_sql('test_structure', 'subreddit, id')}) JOIN scaler USING (subreddit, feature)),
          guesses AS (SELECT v.subreddit, v.id, any_value(c.alpha) AS alpha, round(any_value(b.intercept) + sum(v.v * w.coef), 7) AS prediction
            FROM test_values v JOIN chosen c USING (subreddit) JOIN weight_ w ON w.subreddit = v.subreddit AND w.feature = v.feature AND w.alpha = c.alpha AND w.sys = 3
            JOIN base_ b ON b.subreddit = v.subreddit AND b.alpha = c.alpha AND b.sys = 3 GROUP BY v.subreddit, v.id),
          judged_rows AS (SELECT g.*, t.label, s.n_words FROM guesses g JOIN test t USING (subreddit, id) JOIN structure s USING (subreddit, id)),
          trained_rows AS (SELECT subreddit, n_train::DOUBLE AS n_train, n_test::DOUBLE AS n_test, rho_naive, rho_model, top10_model, top10_random, alpha
            FROM (SELECT subreddit, count(*) AS n_train FROM train GROUP BY subreddit) JOIN ({top_decile_sql('judged_rows')}) USING (subreddit)
            JOIN (SELECT subreddit, alpha FROM chosen) USING (subreddit)
            LEFT JOIN ({spearman_sql('judged_rows', 'n_words', 'label', 'rho_naive')}) USING (subreddit)
            LEFT JOIN ({spearman_sql('judged_rows', 'prediction', 'label', 'rho_model')}) USING (subreddit))"""),
        "ridge_model": build("SELECT subreddit, kind, feature, true AS optimal FROM model"),
        "preference_coefficients": recursive(f"""SELECT 's' AS kind, names[i] AS feature, round(t[i], 4) AS coef FROM (
          SELECT t, {STRUCTURAL} AS names, unnest(range(1, 9)) AS i FROM newton WHERE step = 12) UNION ALL SELECT 'i', '(intercept)', round(t[9], 4) FROM newton WHERE step = 12"""),
        "preference_structural": recursive("""SELECT coalesce(margin, 'all') AS margin, count(*) AS pairs, round(avg(pointwise), 6) AS pointwise_accuracy,
          round(avg(pairwise), 6) AS pairwise_accuracy, 0.5::DOUBLE AS chance, round(avg(pairwise) - avg(pointwise), 6) AS delta
          FROM study GROUP BY ROLLUP (margin) HAVING grouping(margin) = 1 OR margin IS NOT NULL"""),
        "matched_pairs": build("SELECT * FROM study_pairs"),
        "label_study_structural": recursive("""SELECT string_split(cell, '/')[1] AS condition, string_split(cell, '/')[2] AS label,
          CASE WHEN n_groups >= 5 AND all_pairs >= 60 AND n > 0 THEN round(hits / n, 6) END AS accuracy, n FROM (
          SELECT p.cell, count(DISTINCT nurl) AS n_groups, count(*) AS all_pairs, count(*) FILTER (is_test) AS n, count(*) FILTER (is_test AND a.x > b.x) AS hits
          FROM judged_pairs p LEFT JOIN worths a ON a.cell = p.cell AND a.title = p.ta LEFT JOIN worths b ON b.cell = p.cell AND b.title = p.tb GROUP BY p.cell)"""),
        "scaled_structural": build("SELECT subreddit, id, " + ", ".join(
            f"round(max(CASE WHEN feature = '{n}' THEN value END), 6) AS {n}" for n in STRUCTURAL
        ) + f" FROM ({scaled}) GROUP BY subreddit, id"),
        "assembled_features": build(f"""SELECT subreddit, id, kind, count(*) AS n_cells, round(sum(value), 6) AS total FROM (
          SELECT subreddit, id, 't' AS kind, weight AS value FROM ({weights_sql('terms', 'vocab', 'subreddit, id')})
          UNION ALL SELECT subreddit, id, 's', value FROM ({scaled})
          UNION ALL SELECT subreddit, id, 'i', 1.0 FROM posts) GROUP BY subreddit, id, kind"""),
        "pair_differences": build("SELECT * FROM balanced").rsplit("SELECT * FROM balanced", 1)[0].rstrip() + f", {pair_ctes} {pair_cells}",
        "embedding_lookup": build("""SELECT subreddit, count(*) AS n_posts, count(embedding) AS n_vectors, CAST(max(len(embedding)) AS INTEGER) AS dims,
          count(*) = count(embedding) AS complete FROM posts LEFT JOIN vectors USING (id) GROUP BY subreddit"""),
        "embedding_features": build(f"""SELECT subreddit, id, kind, count(*) AS n_cells, round(sum(value), 6) AS total FROM (
          SELECT p.subreddit, p.id, 'e' AS kind, unnest(v.embedding)::DOUBLE AS value FROM posts p JOIN vectors v USING (id)
          UNION ALL SELECT s.subreddit, s.id, 's', s.value FROM ({scaled}) s) GROUP BY subreddit, id, kind"""),
        "fixed_model": build(f"SELECT subreddit, kind, feature, {_r('center', 'factor', 'coef')} FROM model"),
        "fixed_predictions": build("SELECT subreddit, id, round(prediction, 6) AS prediction FROM predicted"),
        "spearman_naive": build(f"""SELECT subreddit, round(rho_naive, 6) AS rho_naive FROM (
          {spearman_sql('(SELECT t.subreddit, t.label, s.n_words FROM test t JOIN structure s USING (id))', 'n_words', 'label', 'rho_naive')})"""),
        "spearman_model": build(f"""SELECT subreddit, round(rho_model, 6) AS rho_model FROM ({spearman_sql('predicted', 'prediction', 'label', 'rho_model')})"""),
        "top_decile": build(f"SELECT subreddit, n_test, k, {_r('top10_model', 'top10_random')} FROM ({top_decile_sql('predicted')})"),
        "eval_table": build(f"""SELECT subreddit, {_r('n_train', 'n_test', 'rho_naive', 'rho_model', 'top10_model', 'top10_random')} FROM (
          SELECT subreddit, n_train::DOUBLE AS n_train, n_test::DOUBLE AS n_test, rho_naive, rho_model, top10_model, top10_random FROM evaluation
          UNION ALL SELECT 'MEAN', {mean} FROM evaluation)"""),
        "model_comparison": build(f"""SELECT subreddit, {_r('rho_naive', 'rho_model', 'delta')} FROM (
          SELECT subreddit, rho_naive, rho_model, rho_model - rho_naive AS delta FROM evaluation
          UNION ALL SELECT 'MEAN', avg(rho_naive), avg(rho_model), avg(rho_model - rho_naive) FROM evaluation)"""),
        "model_tables": build(f"""SELECT subreddit, n_train, n_model, n_ecdf FROM (SELECT subreddit, count(*) AS n_train FROM train GROUP BY subreddit)
          JOIN (SELECT subreddit, count(*) AS n_model FROM model GROUP BY subreddit) USING (subreddit)
          JOIN (SELECT subreddit, count(DISTINCT (year, score)) + count(DISTINCT score) AS n_ecdf FROM train GROUP BY subreddit) USING (subreddit)
          WHERE subreddit IN {WANTED}"""),
        "trained_communities": build("SELECT DISTINCT subreddit FROM train"),
        "stored_scores": fitted("train", structure_values, ALPHAS, 3, f"""SELECT request_id, position, subreddit, CASE WHEN prediction IS NOT NULL THEN round({BAND}, 4) END AS band,
          CASE WHEN prediction IS NULL THEN 'no model for ' || subreddit END AS error FROM drafts LEFT JOIN guesses USING (request_id, position)""", f"""
          chosen AS ({fold_choice_sql('values_', 3)}),
          guesses AS (SELECT v.request_id, v.position, any_value(b.intercept) + sum((v.raw - s.center) * s.factor * w.coef) AS prediction
            FROM ({unpivot_sql('draft_structure', 'request_id, position, subreddit')}) v JOIN scaler s USING (subreddit, feature) JOIN chosen c USING (subreddit)
            JOIN weight_ w ON w.subreddit = v.subreddit AND w.feature = v.feature AND w.alpha = c.alpha AND w.sys = 3
            JOIN base_ b ON b.subreddit = v.subreddit AND b.alpha = c.alpha AND b.sys = 3 GROUP BY v.request_id, v.position)"""),
        "retrained_community": fitted("train", structure_values, ALPHAS, 3, f"""SELECT subreddit, count(*) + 1 AS n_features,
          CASE WHEN subreddit = 'src0' THEN 3.0 ELSE any_value(alpha) END AS alpha FROM ({fold_choice_sql('values_', 3)}) JOIN numbered USING (subreddit) GROUP BY subreddit"""),
        "unknown_communities": build("""SELECT DISTINCT sub AS subreddit, 'no model for ' || sub || '; trained: ' ||
          coalesce((SELECT string_agg(subreddit, ', ' ORDER BY subreddit) FROM modelled), '(none trained yet)') AS error
          FROM links WHERE sub NOT IN (SELECT subreddit FROM modelled)"""),
        "community_overlap": build("SELECT DISTINCT subreddit, subreddit IN (SELECT subreddit FROM modelled) AS modelled FROM reposts"),
        "modelled_pairs": build("SELECT * FROM reposts WHERE subreddit IN (SELECT subreddit FROM modelled)"),
        "pair_accuracy": build("""SELECT subreddit, count(*) AS pairs, round(avg((band_win > band_lose)::INT), 6) AS accuracy,
          CAST(sum((band_win = band_lose)::INT) AS BIGINT) AS ties FROM judged GROUP BY ROLLUP (subreddit)"""),
        "margin_accuracy": build("""SELECT margin, count(*) AS pairs, round(avg((band_win > band_lose)::INT), 6) AS accuracy
          FROM judged WHERE margin IS NOT NULL GROUP BY margin"""),
        "order_symmetric_accuracy": """SELECT count(*) AS pairs, round(avg((wl > lw)::INT), 6) AS accuracy FROM (SELECT
          (CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || 'wl'), 1, 8) AS BIGINT) % 1000) / 1000.0 AS wl,
          (CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || 'lw'), 1, 8) AS BIGINT) % 1000) / 1000.0 AS lw FROM part)""",
        "score_titles": build("SELECT * REPLACE (round(band, 6) AS band) FROM scored"),
        "verdicts": build(f"SELECT {verdict_sql('score % 101')} AS verdict, count(*) AS n_rows FROM posts GROUP BY 1"),
        "rank_drafts": build("SELECT * EXCLUDE (title) REPLACE (round(band, 6) AS band) FROM ranked"),
        "strongest_draft": build("""SELECT request_id, subreddit, position, title, round(band, 6) AS band, verdict FROM scored
          QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY band DESC, position) = 1"""),
        "explain": build("""SELECT request_id, position, direction, k, label, round(contribution, 6) AS contribution FROM reasons WHERE k <= 5"""),
        "explanation_text": build("SELECT request_id, position, boosted_by, hurt_by FROM reason_text", k=3),
        "confidence": build("SELECT subreddit, round(rho, 6) AS rho, level, note FROM trust"),
        "ranked_report": build("""SELECT r.request_id, r.position, r.subreddit, r.title, round(r.band, 6) AS band, r.verdict, r.error, r.status, t.boosted_by, t.hurt_by,
          r.rank, c.level, c.note FROM ranked r JOIN reason_text t USING (request_id, position) LEFT JOIN trust c ON c.subreddit = r.subreddit""", k=5),
    }
    return oracles
