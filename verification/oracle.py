"""DuckDB SQL giving the result each registered query must have.

The text expressions use the plain lexicon form (one bounded alternative per phrase); the
derived forum is built by SQL from the same given tables. The fixed values (the phrases, the
gap's length, the class of blanks and which phrases have slots) are taken from the package, so
this side cannot notice if one of them is wrong or lost; sentences typed by hand in the tests do.
"""

from __future__ import annotations

from forum_signals.functions.lexicon import MAX_GAP, PHRASES
from forum_signals.functions.text import UNICODE_SPACE
from verification.phrases import SPLICED
from verification.phrases import TEST_SETTINGS as S
from verification.queries import GAP_SLOT, MIN_SUPPORT, WORD_SLOT

CATS = [f"cat_{name}" for name in PHRASES]
FLAGS = ["has_miscomm", *CATS]
WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pattern(phrases) -> str:
    filled = (p.replace("{word}", WORD).replace("{gap}", f".{{1,{MAX_GAP}}}?") for p in phrases)
    return lit("(?i)" + "|".join(rf"\b{p}\b" for p in filled))


def found(column: str, phrases) -> str:
    return f"regexp_matches({column}, {pattern(phrases)})"


def hash_number(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def phrase(key: str) -> str:
    options = ", ".join(lit(p) for p in SPLICED)
    return f"coalesce(([{options}])[({hash_number(key)} % {2 * len(SPLICED)}) + 1], '')"


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%g')"


ENTITIES = ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), \
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")


def decoded(column: str) -> str:
    # A page title may be cut inside an entity; names without ";" are decoded as well.
    names = "|".join(e.strip("&;") for e, _ in ENTITIES if "#" not in e)
    column = f"regexp_replace({column}, '&({names})([^;A-Za-z0-9]|$)', '&\\1;\\2', 'g')"
    for entity, char in ENTITIES:
        column = f"replace({column}, {lit(entity)}, {lit(char)})"
    return column


def without_blocks(text: str) -> str:
    return f"regexp_replace({text}, '(?is)<pre><code>.*?</code></pre>', ' ', 'g')"


def without_spans(text: str) -> str:
    return f"regexp_replace({text}, '(?is)<code>.*?</code>', ' ', 'g')"


def without_tags(text: str) -> str:
    return f"regexp_replace({text}, '(?s)<.*?>', ' ', 'g')"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, {lit(UNICODE_SPACE + '+')}, ' ', 'g'))"


def prose(body: str) -> str:
    return collapsed(without_tags(without_spans(without_blocks(decoded(f"coalesce({body}, '')")))))


def comma(parts) -> str:
    return ", ".join(parts)


BLANK_REPLY = "NULL::VARCHAR AS Title, NULL::VARCHAR AS Tags"
COUNTS = "0::INTEGER AS AnswerCount, 0::INTEGER AS ViewCount"
KEY_LINE = "'a:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"
LINE_ID = "1000000000000000000 + (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey"

CTES: dict[str, str] = {
    "f_openings": "SELECT conv_id AS opening, text AS Title FROM conversations WHERE turn = 0 AND role = 'user'",
    "f_question_posts": f"""
        SELECT o_orderkey * 10 AS Id, 1::TINYINT AS PostTypeId, NULL::BIGINT AS ParentId,
               '<p>how do i ' || o_orderpriority || '</p>' AS Body, Title,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN '<' || lower(c_mktsegment) || '><status-'
                    || lower(o_orderstatus) || '><nation-' || c_nationkey || '>' END AS Tags,
               {iso('o_orderdate')} AS CreationDate, floor(o_totalprice / 1000)::INTEGER AS Score,
               c_nationkey::INTEGER AS AnswerCount, floor(o_totalprice)::INTEGER AS ViewCount
        FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN f_openings ON opening = o_orderkey % (SELECT max(conv_id) + 1 FROM conversations)""",
    "f_first_lines": f"SELECT l_orderkey * 10 + l_linenumber AS line, min({LINE_ID}) AS first_line FROM lineitem GROUP BY 1",
    "f_posts": f"""
        SELECT * FROM f_question_posts
        UNION ALL BY NAME
        SELECT {LINE_ID} AS Id, 2::TINYINT AS PostTypeId,
               l_orderkey * 10 AS ParentId, '<p>' || p_name || ' &amp; ' || p_type || ' List&lt;which one&gt; '
               || {phrase(KEY_LINE)} || '</p><pre><code>how do i</code></pre>' AS Body, {BLANK_REPLY},
               {iso('l_shipdate')} AS CreationDate, floor(l_quantity)::INTEGER AS Score, {COUNTS}
        FROM lineitem JOIN part ON l_partkey = p_partkey
        UNION ALL BY NAME
        SELECT 4000000000000 + doc_id AS Id, 2::TINYINT AS PostTypeId, doc_id * 10 AS ParentId,
               '<div>' || text || ' ' || {phrase("'d:' || doc_id")} || '</div>' AS Body, {BLANK_REPLY},
               NULL::VARCHAR AS CreationDate, n_chars::INTEGER AS Score, {COUNTS}
        FROM documents
        UNION ALL BY NAME
        SELECT 5000000000000 + page_id AS Id, 2::TINYINT AS PostTypeId,
               CASE WHEN url LIKE 'http:%' THEN NULL WHEN url LIKE '%.org/%' THEN 9000000000000 + page_id
                    ELSE page_id * 10 END AS ParentId,
               html || '<p>' || {phrase("'p:' || page_id")} || '</p>' AS Body, {BLANK_REPLY},
               NULL::VARCHAR AS CreationDate, 0::INTEGER AS Score, {COUNTS}
        FROM pages
        UNION ALL BY NAME
        SELECT 2000000000000 + s_suppkey AS Id, 4::TINYINT AS PostTypeId, NULL::BIGINT AS ParentId, s_name AS Body,
               {BLANK_REPLY}, NULL::VARCHAR AS CreationDate, 0::INTEGER AS Score, {COUNTS}
        FROM supplier""",
    "f_comments": f"""
        SELECT event_id AS Id,
               CASE WHEN event_type IN ('view', 'signup') THEN event_id * 10
                    WHEN event_type = 'error' THEN 2000000000000 + user_id
                    ELSE coalesce(first_line, 1000000000000000000 + event_id * 10 + 1 + user_id % 7) END AS PostId,
               concat_ws(' ', event_type, props, {phrase("'c:' || event_id")}) AS Text,
               {iso('ts')} AS CreationDate, floor(value)::INTEGER AS Score
        FROM events LEFT JOIN f_first_lines ON line = event_id * 10 + 1 + user_id % 7
        UNION ALL
        SELECT 1000000000000 + conv_id * 1000 + turn,
               CASE WHEN role = 'user' THEN conv_id * 10 WHEN role = 'assistant' THEN 4000000000000 + conv_id
                    ELSE 2000000000000 + conv_id END,
               concat_ws(' ', text, {phrase("'t:' || conv_id || ':' || turn")}), NULL, turn::INTEGER
        FROM conversations""",
    "f_questions": """
        SELECT Id AS question_id, Title AS title, Tags AS raw_tags, Body AS body, CreationDate AS created_at,
               Score AS score, AnswerCount AS answer_count, ViewCount AS view_count
        FROM f_posts WHERE PostTypeId = 1""",
    "f_answers": """
        SELECT Id AS answer_id, ParentId AS question_id, Body AS body, CreationDate AS created_at, Score AS score
        FROM f_posts WHERE PostTypeId = 2""",
    "f_roots": """
        SELECT Id AS post_id, CASE WHEN PostTypeId = 1 THEN Id WHEN PostTypeId = 2 THEN ParentId END AS question_id
        FROM f_posts""",
    "f_enriched": """
        SELECT c.Id AS comment_id, c.PostId AS post_id, r.question_id, c.Text AS text, c.CreationDate AS created_at,
               c.Score AS score
        FROM f_comments c JOIN f_roots r ON c.PostId = r.post_id""",
    "f_prose": f"SELECT answer_id, question_id, {prose('body')} AS t FROM f_answers",
    "f_answer_cats": f"""
        SELECT answer_id, question_id, {comma(f"{found('t', p)} AS cat_{n}" for n, p in PHRASES.items())} FROM f_prose""",
    "f_comment_cats": f"""
        SELECT comment_id, question_id,
               {comma(f"{found("coalesce(text, '')", p)} AS cat_{n}" for n, p in PHRASES.items())}
        FROM f_enriched WHERE question_id IS NOT NULL""",
    "f_answers_flagged": f"SELECT *, {' OR '.join(CATS)} AS has_miscomm FROM f_answer_cats",
    "f_comments_flagged": f"SELECT *, {' OR '.join(CATS)} AS has_miscomm FROM f_comment_cats",
    "f_texts": f"""
        SELECT question_id, {comma(FLAGS)} FROM f_answers_flagged
        UNION ALL SELECT question_id, {comma(FLAGS)} FROM f_comments_flagged""",
    "f_miscomm": f"SELECT question_id, {comma(f'bool_or({c}) AS {c}' for c in FLAGS)} FROM f_texts GROUP BY question_id",
    "f_all_tags": """
        SELECT question_id, unnest(regexp_extract_all(raw_tags, '<([^>]+)>', 1)) AS tag FROM f_questions""",
    "f_top": f"SELECT tag, count(*) AS n_questions FROM f_all_tags GROUP BY tag ORDER BY 2 DESC, 1 LIMIT {S.top_n}",
    "f_tags": "SELECT question_id, tag FROM f_all_tags WHERE tag IN (SELECT tag FROM f_top)",
    "f_named_tags": f"""
        SELECT ({hash_number('tag')} % 1000000007)::INTEGER AS Id, tag AS TagName, count(*)::INTEGER AS "Count"
        FROM f_all_tags GROUP BY tag""",
    "f_tagged": "SELECT * FROM f_tags JOIN f_miscomm USING (question_id)",
    "f_counts": f"""
        SELECT tag AS topic, count(*) AS n_total, {comma(f'sum({c}::INTEGER)::BIGINT AS {c}' for c in FLAGS)}
        FROM f_tagged GROUP BY tag HAVING count(*) >= {S.min_questions}""",
    "f_contingency": """
        SELECT topic, has_miscomm AS n_miscomm, n_total - has_miscomm AS n_no_miscomm, n_total FROM f_counts""",
    "f_by_category": " UNION ALL ".join(
        f"SELECT topic, '{n}' AS category, cat_{n} AS n_miscomm, n_total - cat_{n} AS n_no_miscomm, n_total FROM f_counts"
        for n in PHRASES
    ),
    "f_global": """
        SELECT count(*) AS total_questions, sum(has_miscomm::INTEGER)::BIGINT AS total_miscomm,
               avg(has_miscomm::INTEGER) AS global_miscomm_rate FROM f_miscomm""",
    "f_global_category": " UNION ALL ".join(
        f"SELECT '{n}' AS category, count(*) AS total_questions, sum(cat_{n}::INTEGER)::BIGINT AS total_miscomm, "
        f"avg(cat_{n}::INTEGER) AS global_miscomm_rate FROM f_miscomm"
        for n in PHRASES
    ),
    "f_words": """
        SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents""",
    "f_norms": f"""
        SELECT w AS token, CASE WHEN {hash_number('w')} % 5 <> 0
               THEN 1 + ({hash_number('w')} // 7) % 401 / 100 ELSE 1 + {hash_number('w')} % 401 / 100 END AS score
        FROM f_words""",
    "f_titled": "SELECT tag, question_id, title FROM f_tags JOIN f_questions USING (question_id) WHERE title IS NOT NULL",
    "f_sample": f"""
        SELECT tag, question_id, title FROM f_titled QUALIFY row_number() OVER (
            PARTITION BY tag ORDER BY md5('{S.seed}|' || tag || '|' || question_id), question_id) <= {S.sample_size}""",
    "f_sample_tokens": "SELECT tag, unnest(regexp_extract_all(lower(title), '[a-z]+')) AS token FROM f_sample",
    "f_concreteness": f"""
        SELECT k.tag AS topic, coalesce(n.n_sampled, 0) AS n_sampled, coalesce(m.n_words_matched, 0) AS n_words_matched,
               m.concreteness_score
        FROM (SELECT tag FROM f_tags GROUP BY tag HAVING count(*) >= {S.min_questions}) k
        LEFT JOIN (SELECT tag, count(*) AS n_sampled FROM f_sample GROUP BY tag) n ON n.tag = k.tag
        LEFT JOIN (SELECT tag, count(*) AS n_words_matched, avg(score) AS concreteness_score
                   FROM f_sample_tokens JOIN f_norms USING (token) GROUP BY tag) m ON m.tag = k.tag""",
    "f_draws": f"""
        SELECT t.tag, s.sample_size::INTEGER AS sample_size, r.run::INTEGER AS run
        FROM (SELECT tag FROM f_tags GROUP BY tag HAVING count(*) >= {S.min_questions}
              ORDER BY count(*) DESC, tag LIMIT {S.stability_tags}) t,
             (SELECT unnest({list(S.stability_sizes)}) AS sample_size) s,
             (SELECT unnest(range(1, {S.stability_runs + 1})) AS run) r""",
    "f_drawn": f"""
        SELECT tag, sample_size, run, title FROM f_draws JOIN f_titled USING (tag) QUALIFY row_number() OVER (
            PARTITION BY tag, sample_size, run
            ORDER BY md5('{S.seed}|' || sample_size || '|' || run || '|' || tag || '|' || question_id), question_id
        ) <= sample_size""",
    "f_drawn_tokens": """
        SELECT tag, sample_size, run, unnest(regexp_extract_all(lower(title), '[a-z]+')) AS token FROM f_drawn""",
    "f_stability": """
        SELECT d.tag, d.sample_size, d.run, coalesce(m.n, 0) AS n_words_matched, m.score AS concreteness_score
        FROM f_draws d LEFT JOIN (
            SELECT tag, sample_size, run, count(*) AS n, avg(score) AS score
            FROM f_drawn_tokens JOIN f_norms USING (token) GROUP BY ALL) m
        ON m.tag = d.tag AND m.sample_size = d.sample_size AND m.run = d.run""",
}


def erf_series(x: str) -> str:
    """erf for x >= 0 by its all-positive series; beyond 6 it is 1 to every printed digit."""
    term = (
        f"exp(n * ln(2) + (2 * n + 1) * ln(greatest({x}, 1e-12))"
        f" - (lgamma(2 * n + 3) - (n + 1) * ln(2) - lgamma(n + 2)) - ({x}) * ({x}))"
    )
    return f"CASE WHEN {x} > 6 THEN 1.0 ELSE 2 / sqrt(pi()) * list_sum(list_transform(range(0, 300), lambda n: {term})) END"


def two_sided(z: str) -> str:
    return f"(1 - {erf_series(f'abs({z}) / sqrt(2)')})"


def chi_tail(x: str, df: str) -> str:
    """Upper chi-square tail as 1 minus the all-positive series of the lower one."""
    a, h = f"({df} / 2.0)", f"({x} / 2.0)"
    term = f"exp(({a} + n) * ln({h}) - {h} - lgamma({a} + n + 1))"
    return f"greatest(0, 1 - list_sum(list_transform(range(0, 3000), lambda n: {term})))"


H: dict[str, str] = {
    "h_cells": """
        SELECT 'overall' AS category, topic, n_miscomm, n_no_miscomm, n_total FROM f_contingency
        UNION ALL SELECT category, topic, n_miscomm, n_no_miscomm, n_total FROM f_by_category""",
    "h_totals": "SELECT category, sum(n_miscomm) AS a, sum(n_no_miscomm) AS b, sum(n_total) AS n, count(*) AS r FROM h_cells GROUP BY category",
    "h_chi": """
        SELECT category, any_value(r) AS r, any_value(n) AS n,
               sum(pow(n_miscomm - n_total * (a / n), 2) / (n_total * (a / n))
                   + pow(n_no_miscomm - n_total * (b / n), 2) / (n_total * (b / n))) AS statistic
        FROM h_cells JOIN h_totals USING (category) GROUP BY category""",
    "h_tests": f"""
        SELECT category, 'chi_square' AS test, statistic, (r - 1)::INTEGER AS df,
               {chi_tail('statistic', '(r - 1)')} AS p_value, sqrt(statistic / n) AS cramers_v FROM h_chi""",
    "h_profile": """
        SELECT sum(pow(n_miscomm - r * c / t, 2) / (r * c / t)) AS chi2, any_value(t) AS n,
               count(DISTINCT topic)::INTEGER AS n_topics, count(DISTINCT category)::INTEGER AS n_cats
        FROM (SELECT *, sum(n_miscomm) OVER (PARTITION BY topic) AS r, sum(n_miscomm) OVER (PARTITION BY category) AS c,
                     sum(n_miscomm) OVER () AS t FROM f_by_category)""",
    "h_against": """
        SELECT 'overall' AS category, total_miscomm AS a0, total_questions AS n0 FROM f_global
        UNION ALL SELECT category, total_miscomm, total_questions FROM f_global_category""",
    "h_z": """
        SELECT *, (p - p0) / sqrt((a0 + n_miscomm) / (n0 + n_total) * (1 - (a0 + n_miscomm) / (n0 + n_total))
                                  * (1 / n0 + 1 / n_total)) AS z,
               1.959963984540054 * sqrt(p * (1 - p) / n_total + p0 * (1 - p0) / n0) AS half
        FROM (SELECT *, n_miscomm / n_total AS p, a0 / n0 AS p0 FROM h_cells JOIN h_against USING (category))""",
    "h_p": f"SELECT *, {two_sided('z')} AS p_value, row_number() OVER (PARTITION BY category ORDER BY abs(z) DESC) AS i FROM h_z",
    "h_pairwise": f"""
        SELECT *, p_adj < {S.alpha} AS significant,
               CASE WHEN p_adj >= {S.alpha} THEN 'not_significant' WHEN p > p0 THEN 'above_baseline'
                    ELSE 'below_baseline' END AS direction
        FROM (SELECT *, min(least(1, p_value * m / i)) OVER (
                  PARTITION BY category ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_adj
              FROM (SELECT *, count(*) OVER (PARTITION BY category) AS m FROM h_p))""",
    "h_base": "SELECT topic AS t0, n_miscomm AS a0, n_no_miscomm AS b0 FROM f_contingency ORDER BY n_total DESC, topic LIMIT 1",
    "h_odds": """
        SELECT *, ln(odds_ratio) / std_error AS statistic FROM (
            SELECT topic = t0 AS intercept, CASE WHEN topic = t0 THEN '(Intercept)' ELSE 'topic' || topic END AS term,
                   n_miscomm AS a, n_no_miscomm AS b, a0, b0,
                   CASE WHEN topic = t0 THEN a0 / b0 ELSE (n_miscomm * b0) / (n_no_miscomm * a0) END AS odds_ratio,
                   CASE WHEN topic = t0 THEN sqrt(1 / a0 + 1 / b0)
                        ELSE sqrt(1 / n_miscomm + 1 / n_no_miscomm + 1 / a0 + 1 / b0) END AS std_error
            FROM f_contingency, h_base)""",
    "h_odds_p": f"SELECT *, {two_sided('statistic')} AS p_value FROM h_odds",
    "h_ranks": """
        SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx,
               rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry
        FROM (SELECT c.concreteness_score AS x, k.has_miscomm / k.n_total AS y FROM f_concreteness c
              JOIN f_counts k ON k.topic = c.topic WHERE c.concreteness_score IS NOT NULL)""",
    "h_rho": "SELECT corr(rx, ry) AS rho, count(*)::INTEGER AS n FROM h_ranks",
}

# Limits of the odds ratios: bisection of the profile deviance, 80 halvings per limit.
DEVIANCE = """
    2 * (CASE WHEN a0 > 0 THEN a0 * ln(a0 / ((a0 + b0) * p0)) ELSE 0 END
       + CASE WHEN b0 > 0 THEN b0 * ln(b0 / ((a0 + b0) * (1 - p0))) ELSE 0 END
       + CASE WHEN NOT intercept THEN a * ln(a / ((a + b) * p1)) + b * ln(b / ((a + b) * (1 - p1))) ELSE 0 END)"""
H["h_limits"] = f"""
    SELECT term, intercept, a::DOUBLE AS a, b::DOUBLE AS b, a0::DOUBLE AS a0, b0::DOUBLE AS b0, sign::DOUBLE AS sign,
           ln(odds_ratio) AS centre, 0.0::DOUBLE AS inside, 12 * std_error AS outside, 0 AS i
    FROM h_odds, (VALUES (-1), (1)) v(sign)
    UNION ALL
    SELECT term, intercept, a, b, a0, b0, sign, centre, CASE WHEN dev < 3.841458820694124 THEN middle ELSE inside END,
           CASE WHEN dev < 3.841458820694124 THEN outside ELSE middle END, i + 1
    FROM (SELECT *, {DEVIANCE} AS dev FROM (
        SELECT *, u / (1 + u) AS p0, u * r / (1 + u * r) AS p1 FROM (
            SELECT *, CASE WHEN intercept THEN r
                           WHEN lin > 0 THEN 2 * s / (lin + sqrt(lin * lin + 4 * quad * s))
                           ELSE (sqrt(lin * lin + 4 * quad * s) - lin) / (2 * quad) END AS u FROM (
                SELECT *, r * (a + b + a0 + b0 - s) AS quad, (a0 + b0) + (a + b) * r - s * (1 + r) AS lin FROM (
                    SELECT *, (inside + outside) / 2 AS middle, a + a0 AS s,
                           exp(centre + sign * (inside + outside) / 2) AS r
                    FROM h_limits WHERE i < 80)))))"""
CTES.update(H)


def sql(final: str) -> str:
    """The final SELECT with the derived tables it needs, in order of definition."""
    needed: set[str] = set()
    pending = [final]
    while pending:
        body = pending.pop()
        for name in CTES:
            if name not in needed and f"{name} " in body.replace("\n", " ").replace(",", " ").replace(")", " ") + " ":
                needed.add(name)
                pending.append(CTES[name])
    listed = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    return f"WITH RECURSIVE {listed}\n{final}" if listed else final


def r9(*columns: str) -> str:
    return comma(f"round({c}, 9) AS {c}" for c in columns)


def digest(expression: str) -> str:
    return f"md5({expression}) AS digest"


def body_digest(fn) -> str:
    return f"SELECT answer_id, length(t)::INTEGER AS n, md5(t) AS digest FROM (SELECT answer_id, {fn} AS t FROM f_answers)"


def place(order: str) -> str:
    return f"(row_number() OVER (ORDER BY {order}))::INTEGER AS place"


def row_digest(*columns: str) -> str:
    shown = comma(f"coalesce({c}::VARCHAR, '~')" for c in columns)
    return f"md5(concat_ws('|', {shown})) AS digest"


def log_tail(x: str, df: str) -> str:
    """log10 of the upper chi-square tail: the finite sum for whole and half numbers, scaled by its largest term."""
    h, odd = f"({x} / 2.0)", f"({df} % 2)"
    terms = f"list_transform(range(0, ({df}) // 2), lambda n: (n + {odd} / 2.0) * ln({h}) - lgamma(n + 1 + {odd} / 2.0))"
    # erfc of the root, by its continued fraction, belongs to odd numbers
    fraction = f"list_reduce(list_concat([sqrt({h})], list_transform(range(200, 0, -1), lambda k: k::DOUBLE)), lambda acc, k: sqrt({h}) + k / 2 / acc)"
    logs = f"list_concat({terms}, CASE WHEN {odd} = 1 THEN [-0.5 * ln(pi()) - ln({fraction})] ELSE [] END)"
    return f"(list_max({logs}) + ln(list_sum(list_transform({logs}, lambda t: exp(t - list_max({logs}))))) - {h}) / ln(10)"


RATE = "n_total AS n_questions, n_miscomm, round(n_miscomm / n_total, 9) AS miscomm_rate"
CELLS = "n_miscomm, n_no_miscomm, n_total"
CORRELATION_P = f"""
    SELECT 'tags' AS track, round(rho, 9) AS rho, round(least(1, 2 * greatest(0, CASE WHEN s > mid
               THEN (1 - sgn * erf) / 2 + u / exp(x * x / 2) ELSE (1 + sgn * erf) / 2 - u / exp(x * x / 2) END)), 9) AS p_value,
           n AS n_topics
    FROM (SELECT *, sign(x) AS sgn, {erf_series('abs(x) / sqrt(2)')} AS erf,
                 x / n * (0.2274 + (0.2531 + 0.1745 / n) / n + x * x * (-0.0758 + (0.1033 + 0.3932 / n) / n
                   - x * x / n * (0.0879 + 0.0151 / n - x * x * (0.0072 - 0.0831 / n
                   + x * x / n * (0.0131 - 0.00046 * x * x))))) AS u
          FROM (SELECT *, (6 * (arg - 1) / n / (n * n - 1) - 1) * sqrt(n - 1) AS x
                FROM (SELECT *, CASE WHEN s > mid THEN round(s) ELSE round(s) + 2 END AS arg
                      FROM (SELECT rho, n::DOUBLE AS d, n, (n::DOUBLE ** 3 - n) / 6 AS mid,
                                   (n::DOUBLE ** 3 - n) / 6 * (1 - rho) AS s FROM h_rho))))"""
CORRELATION_P = CORRELATION_P.replace("(n * n - 1)", "(d * d - 1)")

ORACLE: dict[str, str] = {
    "a1_scan_dump_rows": "SELECT Id, PostTypeId, ParentId, md5(Body) AS digest, Title, Tags, CreationDate, Score FROM f_posts",
    "a2_attributes_to_columns": """
        SELECT Id, PostId, Text, CreationDate, Score FROM f_comments
        UNION ALL SELECT Id::BIGINT, NULL, TagName, NULL, "Count" FROM f_named_tags""",
    "a3_safe_int": """
        SELECT event_id, TRY_CAST(v AS INTEGER) AS as_int, coalesce(TRY_CAST(v AS BIGINT), 0) AS as_bigint_or_zero,
               coalesce(TRY_CAST(v AS TINYINT), 0)::TINYINT AS as_tinyint_or_zero
        FROM (SELECT event_id, CASE event_type WHEN 'view' THEN user_id::VARCHAR WHEN 'click' THEN user_id::VARCHAR
                     WHEN 'error' THEN NULL WHEN 'signup' THEN NULL ELSE (event_id * 1000003)::VARCHAR END AS v FROM events)""",
    "a4_enforced_schema": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS data_type, count({c}) AS n_present FROM f_posts"
        for c, k in {
            "Id": "bigint", "PostTypeId": "tinyint", "ParentId": "bigint", "Body": "string", "Title": "string",
            "Tags": "string", "CreationDate": "string", "Score": "int", "AnswerCount": "int", "ViewCount": "int",
        }.items()
    ),
    "a5_pick_dump_files": """
        SELECT 'posts' AS table_name, count(*) AS n_rows FROM f_posts
        UNION ALL SELECT 'comments', count(*) FROM f_comments UNION ALL SELECT 'tags', count(*) FROM f_named_tags""",
    "a6_parquet_sink": "SELECT * FROM f_comments",
    "a7_parquet_source": """
        SELECT PostTypeId, count(*) AS n_posts, count(ParentId) AS n_parents, sum(Score)::BIGINT AS total_score
        FROM f_posts GROUP BY PostTypeId""",
    "a8_create_or_replace_table": "SELECT question_id AS id, raw_tags FROM f_questions",
    "a9_named_views": """
        SELECT q.question_id, count(a.answer_id) AS n_answers, max(a.score) AS best_score FROM f_questions q
        LEFT JOIN f_answers a ON a.question_id = q.question_id GROUP BY q.question_id""",
    "a10_csv_report": f"SELECT topic, {RATE}, {place('n_miscomm / n_total DESC, topic')} FROM f_contingency",
    "a11_word_norms": "SELECT token, round(score, 9) AS score FROM f_norms",
    "a12_discover_categories": "SELECT 'cat_' || category AS column_name, total_miscomm AS n_flagged FROM f_global_category",
    "a13_row_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows FROM {table}"
        for name, table in {
            "posts": "f_posts", "comments": "f_comments", "tags": "f_named_tags", "questions": "f_questions",
            "answers": "f_answers", "comments_enriched": "f_enriched", "question_tags": "f_tags",
        }.items()
    ),
    "b1_questions": "SELECT * FROM f_questions",
    "b2_answers": "SELECT * FROM f_answers",
    "b3_root_question": "SELECT * FROM f_roots",
    "b4_comments_with_root": "SELECT comment_id, question_id FROM f_enriched WHERE question_id IS NOT NULL",
    "b5_titled_questions": "SELECT question_id, title FROM f_questions WHERE title IS NOT NULL",
    "b6_flags_as_numbers": """
        SELECT question_id, has_miscomm::INTEGER AS flagged, (NOT has_miscomm)::INTEGER AS not_flagged FROM f_miscomm""",
    "b7_minimum_support": f"SELECT tag, count(*) AS n_questions FROM f_all_tags GROUP BY tag HAVING count(*) >= {MIN_SUPPORT}",
    "b8_flagged_only": "SELECT answer_id, question_id FROM f_answers_flagged WHERE cat_epistemic",
    "c1_comments_with_posts": "SELECT * FROM f_enriched",
    "c2_top_tag_pairs": "SELECT * FROM f_tags",
    "c3_tags_with_flags": f"SELECT question_id, tag, {comma(FLAGS)} FROM f_tagged",
    "c4_tags_with_titles": "SELECT question_id, tag, md5(title) AS digest FROM f_titled",
    "c5_token_norms": """
        SELECT token, n, round(score, 9) AS score FROM (
            SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(title), '[a-z]+')) AS token
            FROM f_questions) GROUP BY token) JOIN f_norms USING (token)""",
    "d1_question_flags": f"SELECT question_id, {comma(FLAGS)} FROM f_miscomm",
    "d2_flag_prevalence": """
        SELECT 'has_miscomm' AS signal, total_questions AS n_questions, total_miscomm AS n_flagged,
               round(global_miscomm_rate * 100, 9) AS pct FROM f_global
        UNION ALL SELECT category, total_questions, total_miscomm, round(global_miscomm_rate * 100, 9) FROM f_global_category""",
    "d3_tag_counts": "SELECT tag, count(*) AS n_questions FROM f_tags GROUP BY tag",
    "d4_distinct_tags": "SELECT count(DISTINCT tag) AS n_tags FROM f_all_tags",
    "d5_rate_per_tag": f"SELECT topic, {RATE} FROM f_contingency",
    "d6_rate_per_tag_category": f"SELECT topic, category, {RATE} FROM f_by_category",
    "d7_global_summary": """
        SELECT total_questions, (SELECT count(*) FROM f_answers) AS total_answers,
               (SELECT count(*) FROM f_comments) AS total_comments, (SELECT count(*) FROM f_named_tags) AS total_tags,
               total_miscomm, round(global_miscomm_rate, 9) AS global_miscomm_rate FROM f_global""",
    "d8_global_by_category": """
        SELECT category, total_questions, total_miscomm, round(global_miscomm_rate, 9) AS global_miscomm_rate
        FROM f_global_category""",
    "d9_contingency": f"SELECT topic, {CELLS} FROM f_contingency",
    "d10_contingency_by_category": f"SELECT topic, category, {CELLS} FROM f_by_category",
    "d11_concreteness_per_tag": f"SELECT topic, n_sampled, n_words_matched, {r9('concreteness_score')} FROM f_concreteness",
    "d12_stability_summary": """
        SELECT tag, sample_size, round(avg(concreteness_score), 9) AS mean, round(stddev_samp(concreteness_score), 9) AS std
        FROM f_stability WHERE concreteness_score IS NOT NULL GROUP BY tag, sample_size""",
    "d13_score_range": """
        SELECT round(min(concreteness_score), 9) AS min_score, round(max(concreteness_score), 9) AS max_score,
               round(avg(concreteness_score), 9) AS mean_score FROM f_concreteness""",
    "e1_top_tags": "SELECT tag, n_questions FROM f_top",
    "e2_top_supported_tags": f"""
        SELECT tag, count(*) AS n_questions FROM f_tags GROUP BY tag HAVING count(*) >= {S.min_questions}
        ORDER BY 2 DESC, 1 LIMIT {S.stability_tags}""",
    "e3_title_sample": "SELECT tag, question_id, md5(title) AS digest FROM f_sample",
    "e4_repeated_samples": f"SELECT tag, sample_size, run, n_words_matched, {r9('concreteness_score')} FROM f_stability",
    "e5_ordered_outputs": f"""
        SELECT 'rates' AS report, topic, NULL AS category, {place('n_miscomm / n_total DESC, topic')} FROM f_contingency
        UNION ALL SELECT 'sizes', topic, NULL, {place('n_total DESC, topic')} FROM f_contingency
        UNION ALL SELECT 'rates_by_category', topic, category,
            {place(f"list_position({list(PHRASES)}, category), topic")} FROM f_by_category
        UNION ALL SELECT 'categories', NULL, category, {place(f"list_position({list(PHRASES)}, category)")}
            FROM f_global_category""",
    "f1_union_flags": """
        SELECT question_id, count(*) AS n_texts, count(*) FILTER (has_miscomm) AS n_flagged FROM f_texts GROUP BY question_id""",
    "f2_stack_categories": "SELECT topic, category, n_miscomm FROM f_by_category",
    "g1_unescape_entities": body_digest(decoded("body")),
    "g2_drop_code_blocks": body_digest(without_blocks("body")),
    "g3_drop_code_spans": body_digest(without_spans("body")),
    "g4_strip_tags": body_digest(without_tags("body")),
    "g5_collapse_whitespace": body_digest(collapsed("body")),
    "g6_html_to_text": "SELECT answer_id, t AS prose FROM f_prose",
    "g7_detect_categories": f"""
        SELECT Id, {comma(f"{found('Text', p)} AS cat_{n}" for n, p in PHRASES.items())} FROM f_comments""",
    "g8_contains_miscomm": f"SELECT Id, {' OR '.join(found('Text', p) for p in PHRASES.values())} AS has_miscomm FROM f_comments",
    "g9_flag_answers": "SELECT * FROM f_answers_flagged",
    "g10_flag_comments": "SELECT * FROM f_comments_flagged",
    "g11_slot_patterns": f"""
        SELECT answer_id, {found('t', WORD_SLOT)} AS word_slot, {found('t', GAP_SLOT)} AS gap_slot FROM f_prose""",
    "g12_parse_tags": """
        SELECT question_id, len(t)::INTEGER AS n_tags, array_to_string(t, '|') AS tags FROM (
            SELECT question_id, coalesce(regexp_extract_all(raw_tags, '<([^>]+)>', 1), []) AS t FROM f_questions)""",
    "g13_explode_tags": "SELECT question_id, tag FROM f_all_tags",
    "g14_tokenize": """
        SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS digest
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents)""",
    "g15_score_titles": """
        SELECT tag, count(*) AS n_words_matched, round(avg(score), 9) AS concreteness_score
        FROM (SELECT tag, unnest(regexp_extract_all(lower(title), '[a-z]+')) AS token FROM f_titled)
        JOIN f_norms USING (token) GROUP BY tag""",
    "h1_descriptive": f"""
        SELECT topic, {CELLS}, round(p, 9) AS miscomm_rate, round(p - 1.96 * sqrt(p * (1 - p) / n_total), 9) AS ci_lower,
               round(p + 1.96 * sqrt(p * (1 - p) / n_total), 9) AS ci_upper
        FROM (SELECT *, n_miscomm / n_total AS p FROM f_contingency)""",
    "h2_global_test": f"SELECT test, df, {r9('statistic', 'p_value', 'cramers_v')} FROM h_tests WHERE category = 'overall'",
    "h3_test_per_category": f"""
        SELECT category, test, df, {r9('statistic', 'p_value', 'cramers_v')} FROM h_tests WHERE category <> 'overall'""",
    "h4_profile_test": f"""
        SELECT 'tags' AS track, round(chi2, 9) AS chi2, df, round({chi_tail('chi2', 'df')}, 9) AS p_value,
               round(sqrt(chi2 / (n * least(n_topics - 1, n_cats - 1))), 9) AS cramers_v, n_topics, n_cats
        FROM (SELECT *, ((n_topics - 1) * (n_cats - 1))::INTEGER AS df FROM h_profile)""",
    "h5_pairwise_test": f"""
        SELECT topic, {CELLS}, round(p, 9) AS estimate, round(z, 9) AS z, round(p_value, 9) AS p_value,
               round(p - p0 - half, 9) AS ci_lower, round(p - p0 + half, 9) AS ci_upper
        FROM h_pairwise WHERE category = 'overall'""",
    "h6_adjusted_p": f"SELECT topic, {r9('p_value', 'p_adj')} FROM h_pairwise WHERE category = 'overall'",
    "h7_direction": "SELECT topic, significant, direction FROM h_pairwise WHERE category = 'overall'",
    "h8_odds_ratios": f"""
        SELECT term, {r9('odds_ratio', 'std_error', 'statistic', 'p_value', 'p_adj')}
        FROM (SELECT *, min(least(1, p_value * m / i)) OVER (
                  ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_adj
              FROM (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY abs(statistic) DESC) AS i FROM h_odds_p))""",
    "h9_profile_limits": """
        SELECT term, round(exp(centre - max(outside) FILTER (sign < 0)), 8) AS conf_low,
               round(exp(centre + max(outside) FILTER (sign > 0)), 8) AS conf_high
        FROM h_limits WHERE i = 80 GROUP BY term, centre""",
    "h10_rank_correlation": "SELECT 'tags' AS track, round(rho, 9) AS rho, n AS n_topics FROM h_rho",
    "h11_rank_correlation_p": CORRELATION_P,
    "h12_chi_square_tail": f"""
        SELECT category, df, round({log_tail('statistic', 'df')}, 6) AS log10_p FROM h_tests WHERE category <> 'overall'
        UNION ALL SELECT 'all', df, round({log_tail('chi2', 'df')}, 6)
        FROM (SELECT *, ((n_topics - 1) * (n_cats - 1))::INTEGER AS df FROM h_profile)
        UNION ALL SELECT 'times ' || k, df, round({log_tail('statistic * k', 'df')}, 6)
        FROM h_tests, (SELECT unnest([10, 100, 1000]) AS k) WHERE category = 'overall'""",
    "h13_pairwise_by_category": f"""
        SELECT category, topic, {CELLS}, round(p, 9) AS estimate, round(z, 9) AS z, round(p_value, 9) AS p_value,
               round(p - p0 - half, 9) AS ci_lower, round(p - p0 + half, 9) AS ci_upper, round(p_adj, 9) AS p_adj,
               significant, direction FROM h_pairwise WHERE category <> 'overall'""",
}
POST_COLUMNS = ("PostTypeId", "ParentId", "Body", "Title", "Tags", "CreationDate", "Score", "AnswerCount", "ViewCount")
ORACLE["k1_ingest"] = f"""
    SELECT 'posts' AS table_name, Id, {row_digest(*POST_COLUMNS)} FROM f_posts
    UNION ALL SELECT 'comments', Id, {row_digest('PostId', 'Text', 'CreationDate', 'Score')} FROM f_comments
    UNION ALL SELECT 'tags', Id::BIGINT, {row_digest('TagName', '"Count"')} FROM f_named_tags"""
ORACLE["k2_model"] = f"""
    SELECT 'questions' AS table_name, question_id AS id,
           {row_digest('title', 'raw_tags', 'body', 'created_at', 'score', 'answer_count', 'view_count')} FROM f_questions
    UNION ALL SELECT 'answers', answer_id, {row_digest('question_id', 'body', 'created_at', 'score')} FROM f_answers
    UNION ALL SELECT 'comments_enriched', comment_id,
           {row_digest('post_id', 'question_id', 'text', 'created_at', 'score')} FROM f_enriched"""
ORACLE["k3_detect"] = ORACLE["d1_question_flags"]
ORACLE["k4_topics"] = f"""
    SELECT 'question_tags' AS source, question_id, tag, NULL AS n_questions, NULL AS place FROM f_tags
    UNION ALL SELECT 'tag_counts', NULL, tag, n_questions, {place('n_questions DESC, tag')}
    FROM (SELECT tag, count(*) AS n_questions FROM f_tags GROUP BY tag)"""
ORACLE["k5_rates"] = f"""
    SELECT 'track_a_tags' AS report, * FROM ({ORACLE['d5_rate_per_tag']})
    UNION ALL BY NAME SELECT 'track_a_tags_by_category' AS report, * FROM ({ORACLE['d6_rate_per_tag_category']})
    UNION ALL BY NAME SELECT 'global_summary_by_category' AS report, * FROM ({ORACLE['d8_global_by_category']})
    UNION ALL BY NAME SELECT 'global_summary' AS report, * FROM ({ORACLE['d7_global_summary']})"""
ORACLE["k6_contingency"] = f"""
    SELECT 'contingency_tags' AS report, * FROM ({ORACLE['d9_contingency']})
    UNION ALL BY NAME SELECT 'contingency_tags_by_category' AS report, * FROM ({ORACLE['d10_contingency_by_category']})"""
ORACLE["k7_concreteness"] = f"SELECT *, {place('topic')} FROM ({ORACLE['d11_concreteness_per_tag']})"
ORACLE["k8_stability"] = f"SELECT *, {place('tag, sample_size, run')} FROM ({ORACLE['e4_repeated_samples']})"
ORACLE["k9_statistics"] = f"""
    SELECT 'stats_tags_descriptive' AS report, * FROM ({ORACLE['h1_descriptive']})
    UNION ALL BY NAME SELECT 'stats_tags_global_test' AS report, * FROM ({ORACLE['h2_global_test']})
    UNION ALL BY NAME SELECT 'stats_tags_by_category_global_test' AS report, * FROM ({ORACLE['h3_test_per_category']})
    UNION ALL BY NAME SELECT 'stats_tags_profile_test' AS report, * FROM ({ORACLE['h4_profile_test']})
    UNION ALL BY NAME SELECT 'stats_tags_pairwise' AS report, topic, {CELLS}, round(p, 9) AS estimate,
        round(p_value, 9) AS p_value, round(p - p0 - half, 9) AS ci_lower, round(p - p0 + half, 9) AS ci_upper,
        round(p_adj, 9) AS p_adj, significant, direction FROM h_pairwise WHERE category = 'overall'
    UNION ALL BY NAME SELECT 'stats_tags_pairwise_by_category' AS report, * EXCLUDE (z)
        FROM ({ORACLE['h13_pairwise_by_category']})
    UNION ALL BY NAME SELECT 'stats_tags_logistic' AS report, * FROM ({ORACLE['h8_odds_ratios']})
        JOIN ({ORACLE['h9_profile_limits']}) USING (term)
    UNION ALL BY NAME SELECT 'stats_tags_abstractness' AS report, * FROM ({ORACLE['h11_rank_correlation_p']})"""

ORACLE = {name: sql(final) for name, final in ORACLE.items()}
