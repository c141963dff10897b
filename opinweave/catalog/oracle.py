"""SQL that says the same as each registered query, for an independent engine (DuckDB)."""

from __future__ import annotations

from ..functions import lexicons as lex
from ..operators.features import default_stop_words
from ..plans.reports import THEME_SENTIMENT_ORDER
from .inputs import PROBE_EMOTIONS

SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
BENGALI = r"\x{0980}-\x{09FF}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)


def text_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def clean(c: str) -> str:
    no_url = f"regexp_replace({c}, 'http[^{SPACE}]+|www[^{SPACE}]+', '', 'g')"
    kept = f"regexp_replace({no_url}, '[^{WORD}{SPACE}{BENGALI}@#!?]', ' ', 'g')"
    flat = f"trim(regexp_replace({kept}, '[{SPACE}]+', ' ', 'g'))"
    blank = f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g')) = ''"
    return f"CASE WHEN {c} IS NULL OR {blank} THEN '' WHEN {flat} = '' THEN ' ' ELSE {flat} END"


def n_words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{SPACE}]+'))"


def space_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[^{SPACE}]+')"


def english(c: str) -> str:
    """Tokens of raw text by the same splitting rules."""
    t = f"lower({c})"
    for pattern, by in (
        (r"\.\.\.", " ... "),
        (r"([;@#$%&?!(){}<>\[\]\"«»“”‘’„`]|--)", r" \1 "),
        (r"([:,])([^\p{Nd}])", r" \1 \2"),
        (r"([:,])$", r" \1 "),
        (f"(\\.+)([{SPACE}]|$)", r" \1 "),
        (f"[{SPACE}]+", " "),
        (r"$", " "),
        ("([^' ])('s|'m|'d|'ll|'re|'ve|n't|') ", r"\1 \2 "),
    ):
        if pattern == "$":
            t = f"({t} || ' ')"
        else:
            t = f"regexp_replace({t}, {q(pattern)}, {q(by)}, 'g')"
    return f"list_filter(string_split({t}, ' '), lambda w: regexp_full_match(w, '\\p{{L}}+'))"


def report_tokens(c: str, stop) -> str:
    """Splits first and takes the double words apart afterwards."""
    double = " ".join(f"WHEN {q(k)} THEN {text_list(v)}" for k, v in lex.SPLIT_WORDS.items())
    parts = f"regexp_extract_all(lower({c}), '[^ @#!?]+')"
    # a double word is taken apart wherever it stands between non-word characters
    flat = f"flatten(list_transform({parts}, lambda t: CASE t {double} ELSE [t] END))"
    return (
        f"list_filter({flat}, lambda t: regexp_full_match(t, '\\p{{L}}{{3,}}') "
        f"AND NOT list_contains({text_list(sorted(stop))}, t))"
    )


def bin_case(c: str) -> str:
    return (
        f"CASE WHEN {c} < 0 THEN NULL WHEN {c} <= CAST(0.3 AS DOUBLE) THEN 'Low' "
        f"WHEN {c} <= CAST(0.7 AS DOUBLE) THEN 'Medium' WHEN {c} <= 1 THEN 'High' END"
    )


def theme_score(t: str) -> str:
    hits = lambda kws: f"len(list_filter(string_split(lower({kws}), ' '), lambda k: contains(lower({t}), k)))"
    return (
        f"2 * {hits('theme')} + 3 * {hits('subtheme')} "
        f"+ CASE WHEN contains(lower({t}), lower(subtheme)) THEN 5 ELSE 0 END"
    )


def points(t: str, rel: str) -> str:
    """Keyword points per row of ``rel`` (id, text column ``t``)."""
    word_list = f"list_distinct(regexp_extract_all(lower({t}), '[{WORD}]+'))"
    return f"""
      SELECT id, n, CAST(coalesce(sum(CASE WHEN polarity = 0 AND hit THEN pts END), 0) AS DOUBLE) AS neg0,
             CAST(coalesce(sum(CASE WHEN polarity = 2 AND hit THEN pts END), 0) AS DOUBLE) AS pos0
      FROM (
        SELECT id, n, polarity,
          CASE kind WHEN 'phrase' THEN 2 * weight ELSE weight END AS pts,
          CASE kind WHEN 'word' THEN list_contains(ws, term)
                    WHEN 'phrase' THEN contains(low, term) ELSE contains(raw, term) END AS hit
        FROM (SELECT id, {t} AS raw, lower({t}) AS low, {word_list} AS ws, {n_words(t)} AS n FROM {rel}) r
        CROSS JOIN lexicon)
      GROUP BY id, n"""


def bonus(rel: str) -> str:
    extra = "CASE WHEN n > 20 THEN n * CAST(0.1 AS DOUBLE) ELSE 0 END"
    return (
        f"SELECT id, neg0 + CASE WHEN neg0 > pos0 THEN {extra} ELSE 0 END AS neg, "
        f"pos0 + CASE WHEN pos0 > neg0 THEN {extra} ELSE 0 END AS pos FROM {rel}"
    )


SENTIMENT_CASE = (
    "CASE WHEN neg > 0 AND pos > 0 THEN CASE WHEN neg / pos > 2 THEN 0 WHEN neg / pos < 0.5 THEN 2 ELSE 1 END "
    "WHEN neg >= 3 THEN 0 WHEN pos >= 3 THEN 2 ELSE 1 END"
)
LABEL_CASE = "CASE {} WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END"

_lexicon_rows = [
    (polarity, k, w, "phrase" if " " in k else "word")
    for polarity, table in ((0, lex.NEGATIVE_KEYWORDS), (2, lex.POSITIVE_KEYWORDS))
    for k, w in table.items()
] + [
    (polarity, e, lex.EMOJI_WEIGHT, "emoji")
    for polarity, signs in ((0, lex.NEGATIVE_EMOJI), (2, lex.POSITIVE_EMOJI))
    for e in signs
]
_emotion_rows = [
    (i, emotion, k, float(w))
    for i, (emotion, group) in enumerate(PROBE_EMOTIONS.items())
    for k, w in group.items()
]
_stop = text_list(default_stop_words())

# name -> SQL of a common table expression; references to other names are found by text
CTE = {
    "r": "SELECT doc_id AS id, source AS app, text AS content FROM documents",
    "c": f"SELECT id, app, content, {clean('content')} AS cleaned_text FROM r",
    "themes": "SELECT * FROM (VALUES "
    + values([(i, t, s) for i, (t, s) in enumerate(lex.THEME_PAIRS)])
    + ") t(ord, theme, subtheme)",
    "ts": f"SELECT id, ord, theme, subtheme, score FROM (SELECT id, ord, theme, subtheme, {theme_score('cleaned_text')} AS score "
    "FROM c CROSS JOIN themes) WHERE score > 0",
    "th": "SELECT c.id, c.app, c.content, c.cleaned_text, b.theme, b.subtheme FROM c LEFT JOIN "
    "(SELECT * FROM ts QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1) b ON b.id = c.id",
    "lexicon": "SELECT * FROM (VALUES " + values(_lexicon_rows) + ") t(polarity, term, weight, kind)",
    "pt": points("cleaned_text", "c"),
    "ls": bonus("pt"),
    "sn": f"SELECT c.id, c.app, c.content, c.cleaned_text, code AS sentiment, {LABEL_CASE.format('code')} AS sentiment_label "
    f"FROM c JOIN (SELECT id, {SENTIMENT_CASE} AS code FROM ls) k ON k.id = c.id",
    "thsn": "SELECT th.*, sn.sentiment, sn.sentiment_label FROM th JOIN sn ON sn.id = th.id",
    "emolex": "SELECT * FROM (VALUES " + values(_emotion_rows) + ") t(rnk, emotion, term, weight)",
    "emonames": "SELECT * FROM (VALUES " + values(list(enumerate(PROBE_EMOTIONS))) + ") t(rnk, emotion)",
    "emohits": f"SELECT id, emotion, sum(weight) AS w FROM (SELECT id, unnest(list_distinct(regexp_extract_all(lower(cleaned_text), '[{WORD}]+'))) AS term FROM c) "
    "JOIN emolex USING (term) GROUP BY id, emotion",
    "logits": "SELECT c.id, n.rnk, n.emotion, coalesce(h.w, 0) AS logit FROM c CROSS JOIN emonames n "
    "LEFT JOIN emohits h ON h.id = c.id AND h.emotion = n.emotion",
    "emop": "SELECT id, rnk, emotion, e / sum(e) OVER (PARTITION BY id) AS p FROM "
    "(SELECT id, rnk, emotion, exp(logit - max(logit) OVER (PARTITION BY id)) AS e FROM logits)",
    "em": "SELECT c.id, c.app, c.content, c.cleaned_text, t.emotion, t.p AS emotion_confidence FROM c JOIN "
    "(SELECT * FROM emop QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, rnk) = 1) t ON t.id = c.id",
    "them": "SELECT em.*, th.theme, th.subtheme FROM em JOIN th ON th.id = em.id",
    "tx": f"SELECT id, app, cleaned_text, toxicity_score, {bin_case('toxicity_score')} AS toxicity_category FROM "
    "(SELECT c.id, app, cleaned_text, neg / (neg + pos + 4) AS toxicity_score FROM c JOIN ls ON ls.id = c.id)",
    "thtx": "SELECT tx.*, th.theme, th.subtheme FROM tx JOIN th ON th.id = tx.id WHERE th.theme IS NOT NULL",
    "lr": "SELECT c.id, c.app, c.content, c.cleaned_text, quality, toxic, "
    "CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS y FROM c JOIN labels ON doc_id = c.id",
    "pr": f"SELECT lr.id, y, sn.sentiment AS keywords, CASE WHEN length(lr.content) > 1000 THEN 0 ELSE 2 END AS length, "
    f"CASE WHEN {n_words('lr.cleaned_text')} % 4 = 3 THEN -1 ELSE {n_words('lr.cleaned_text')} % 4 END AS words "
    "FROM lr JOIN sn ON sn.id = lr.id",
    "lp": "SELECT id, y, 'keywords' AS scorer, keywords AS yhat FROM pr UNION ALL SELECT id, y, 'length', length FROM pr "
    "UNION ALL SELECT id, y, 'words', words FROM pr",
    "valid": "SELECT * FROM lp WHERE yhat <> -1",
    "cells": "SELECT s.scorer, a.k AS actual, b.k AS predicted, count(v.id) AS n FROM (SELECT DISTINCT scorer FROM valid) s "
    "CROSS JOIN (VALUES (0), (1), (2)) a(k) CROSS JOIN (VALUES (0), (1), (2)) b(k) "
    "LEFT JOIN valid v ON v.scorer = s.scorer AND v.y = a.k AND v.yhat = b.k GROUP BY ALL",
    "perclass": "SELECT scorer, k, sum(CASE WHEN actual = k THEN n END) AS support, sum(CASE WHEN predicted = k THEN n END) AS said, "
    "sum(CASE WHEN actual = k AND predicted = k THEN n END) AS hit FROM cells CROSS JOIN (VALUES (0), (1), (2)) t(k) GROUP BY scorer, k",
    "prf": "SELECT *, CASE WHEN said > 0 THEN hit / CAST(said AS DOUBLE) ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / CAST(support AS DOUBLE) ELSE 0 END AS rc FROM perclass",
    "mt0": "SELECT scorer, 100.0::DOUBLE * sum(hit) / sum(support) AS accuracy, 100.0::DOUBLE * sum(p * support) / sum(support) AS precision, "
    "100.0::DOUBLE * sum(rc * support) / sum(support) AS recall, "
    "100.0::DOUBLE * sum(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END * support) / sum(support) AS f1 FROM prf GROUP BY scorer",
    "mt": "SELECT scorer, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM mt0",
    "vocab": f"SELECT word FROM (SELECT unnest(list_distinct({english('text')})) AS word FROM documents WHERE lang = 'en') GROUP BY word HAVING count(*) >= 2",
    "et": f"SELECT doc_id AS id, unnest({english('text')}) AS word FROM documents WHERE NOT regexp_matches(text, '[{BENGALI}]')",
    "eng": "SELECT id FROM et LEFT JOIN vocab USING (word) GROUP BY id HAVING CAST(count(vocab.word) AS DOUBLE) / count(*) >= CAST(0.8 AS DOUBLE)",
    "tok": f"SELECT id, unnest({space_tokens('cleaned_text')}) AS word FROM c",
    "grams0": f"SELECT id, list_filter(regexp_extract_all(lower(cleaned_text), '[{WORD}]+'), lambda t: length(t) >= 2 AND NOT list_contains({_stop}, t)) AS w FROM c",
    "grams": "SELECT id, unnest(w) AS term FROM grams0 UNION ALL SELECT id, w[i] || ' ' || w[i + 1] FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM grams0)",
    "tfv": "SELECT term, count(*) AS cf, count(DISTINCT id) AS df FROM grams GROUP BY term "
    "HAVING count(DISTINCT id) >= 2 AND count(DISTINCT id) <= CAST(0.95 AS DOUBLE) * (SELECT count(*) FROM c) ORDER BY cf DESC, term LIMIT 100",
    "idf": "SELECT *, ln((1 + (SELECT count(*) FROM c)) / CAST(1 + df AS DOUBLE)) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS pos FROM tfv",
    "split_y": "SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5(id || ':42'), id) AS rn FROM lr",
    "vsplit": "SELECT vec_id, embedding, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) AS rn FROM embeddings",
    "vlong": "SELECT vec_id, rn, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM vsplit",
    "emlong": "SELECT vec_id, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "firsts": f"SELECT word, min([id, pos]) AS first_at FROM (SELECT id, unnest({space_tokens('cleaned_text')}) AS word, unnest(range({n_words('cleaned_text')})) AS pos FROM c) GROUP BY word",
    "seqvoc": "SELECT word, row_number() OVER (ORDER BY first_at) + 1 AS idx FROM firsts QUALIFY idx <= 9999",
}


def quota(labels_from: str, key: str, total: str) -> str:
    """Largest-remainder quotas per label."""
    return (
        f"SELECT {key}, n, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, {key}) <= total - sum(fl) OVER () THEN 1 ELSE 0 END AS quota "
        f"FROM (SELECT {key}, n, total, CAST(floor(CAST(total AS DOUBLE) * n / whole) AS BIGINT) AS fl, "
        f"CAST(total AS DOUBLE) * n / whole - floor(CAST(total AS DOUBLE) * n / whole) AS rest FROM "
        f"(SELECT {key}, n, sum(n) OVER () AS whole, {total} AS total FROM (SELECT {key}, count(*) AS n FROM {labels_from} GROUP BY {key})))"
    )


CTE["quota_y"] = quota("lr", "y", "CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n) OVER ()) AS BIGINT)")
CTE["marked_y"] = "SELECT id, s.y, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM split_y s JOIN quota_y q ON q.y = s.y"
CTE["grams_tr"] = "SELECT g.* FROM grams g JOIN marked_y m ON m.id = g.id WHERE m.split = 'train'"
CTE["n_tr"] = "SELECT count(*) AS n FROM marked_y WHERE split = 'train'"
CTE["tfv_tr"] = (
    "SELECT term, count(*) AS cf, count(DISTINCT id) AS df FROM grams_tr GROUP BY term HAVING count(DISTINCT id) >= 2 "
    "AND count(DISTINCT id) <= CAST(0.95 AS DOUBLE) * (SELECT n FROM n_tr) ORDER BY cf DESC, term LIMIT 100"
)
CTE["idf_tr"] = (
    "SELECT *, ln((1 + (SELECT n FROM n_tr)) / CAST(1 + df AS DOUBLE)) + 1 AS idf, row_number() OVER (ORDER BY term) - 1 AS pos FROM tfv_tr"
)
CTE["quota_v"] = quota("embeddings", "label", "CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n) OVER ()) AS BIGINT)")
CTE["vmarked"] = "SELECT vec_id, pos, v, rn > quota AS train FROM vlong l JOIN quota_v q ON q.label = l.label"
CTE["vstats"] = (
    "SELECT pos, avg(v) AS m, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM vmarked WHERE train GROUP BY pos"
)
CTE["lab"] = "SELECT doc_id AS id, quality AS y FROM labels"
CTE["quota_s"] = quota("lab", "y", "least(1024, sum(n) OVER ())")
CTE["ranked_s"] = "SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5(id || ':42'), id) - 1 AS place FROM lab"
CTE["draws"] = (
    "SELECT y, draw, (draw * 2654435761 + 42) % n AS place FROM "
    "(SELECT y, n, unnest(range(CAST(quota AS BIGINT))) AS draw FROM quota_s)"
)


def _names_in(sql: str) -> list[str]:
    import re

    found = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)\b", sql))
    return [n for n in CTE if n in found]


def with_ctes(sql: str) -> str:
    """The statement with the common table expressions it needs, in order."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for n in _names_in(CTE[name]):
            if n != name:
                add(n)
        needed.append(name)

    for n in _names_in(sql):
        add(n)
    # tables that several others read are computed once
    heads = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in needed]
    return (f"WITH {', '.join(heads)} " if heads else "") + sql


def _pct_columns(rows: str, row: str, label: str, labels) -> str:
    cols = ", ".join(
        f"round(100.0::DOUBLE * count(*) FILTER ({label} = {q(v)}) / count(*), 6) AS \"{v}\"" for v in labels
    )
    return f"SELECT {row}, {cols} FROM {rows} WHERE {row} IS NOT NULL AND {label} IN ({', '.join(map(q, labels))}) GROUP BY {row}"


def _count_columns(rows: str, row: str, label: str, labels) -> str:
    cols = ", ".join(f"count(*) FILTER ({label} = {q(v)}) AS \"{v}\"" for v in labels)
    return f"SELECT {row}, {cols} FROM {rows} WHERE {row} IS NOT NULL AND {label} IS NOT NULL GROUP BY {row}"


def _distribution(rows: str, label: str) -> str:
    return (
        f"SELECT {label}, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct FROM (SELECT {label}, count(*) AS n FROM {rows} GROUP BY {label}) "
        f"QUALIFY {label} IS NOT NULL"
    )


def _class_case(table: dict) -> str:
    return "CASE label " + " ".join(f"WHEN {k} THEN {v}" for k, v in table.items()) + " ELSE -1 END"


def _top_terms(rows: str, group: str, stop) -> str:
    return (
        f"SELECT {group}, term, n, rank, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY {group}), 6) AS weight FROM "
        f"(SELECT {group}, term, n, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, term) AS rank FROM "
        f"(SELECT {group}, term, count(*) AS n FROM (SELECT {group}, unnest({report_tokens('cleaned_text', stop)}) AS term FROM {rows} WHERE {group} IS NOT NULL) GROUP BY {group}, term)) "
        "WHERE rank <= 100"
    )


def _raw_theme() -> str:
    return (
        "SELECT r.id, b.theme, b.subtheme FROM r LEFT JOIN (SELECT * FROM (SELECT id, ord, theme, subtheme, "
        f"{theme_score('content')} AS score FROM r CROSS JOIN themes) WHERE score > 0 "
        "QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1) b ON b.id = r.id"
    )


_scaled_by = "SELECT vec_id, pos, round({}, 6) + 0.0 AS value FROM (SELECT m.vec_id, m.pos, m.v, s.* EXCLUDE (pos) FROM vmarked m JOIN vstats s ON s.pos = m.pos)"
_cos = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_doubles = "list_transform(embedding, lambda v: CAST(v AS DOUBLE))"


def _mean_vector(where: str) -> str:
    return f"(SELECT list(m ORDER BY pos) FROM (SELECT pos, avg(v) AS m FROM emlong WHERE {where} GROUP BY pos))"


def _similarity(centre: str) -> str:
    return f"SELECT vec_id, {_cos.format(a='e', b='centre')} AS similarity FROM (SELECT vec_id, {_doubles} AS e, {centre} AS centre FROM embeddings)"


BODY = {
    "theme_sentiment": _pct_columns("thsn", "theme", "sentiment_label", THEME_SENTIMENT_ORDER),
    "scan_review_files": "SELECT origin, content, count(*) AS n FROM (SELECT 'documents' AS origin, text AS content FROM documents UNION ALL SELECT 'conversations', text FROM conversations) WHERE content <> '' GROUP BY ALL",
    "scan_reviews": "SELECT source AS app, text AS content, doc_id, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, NULL::BIGINT AS item_id FROM documents "
    "UNION ALL SELECT 'conversations', text, NULL, conv_id, turn, NULL FROM conversations UNION ALL SELECT 'benchmark', text, NULL, NULL, NULL, item_id FROM benchmark",
    "resolve_text_column": "SELECT conv_id, turn, text AS content FROM conversations",
    "tag_source": "SELECT doc_id, source AS app FROM documents",
    "drop_missing_text": "SELECT doc_id, CASE WHEN lang = 'es' THEN ' NA' ELSE text END AS content FROM documents WHERE text IS NOT NULL AND lang <> 'de'",
    "scan_themes": "SELECT r_name AS theme, string_agg(n_name, '|' ORDER BY n_nationkey) AS subthemes, count(*) AS n_subthemes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "first_available_source": "SELECT id, sentiment_label FROM sn",
    "ingest_landing": "SELECT text AS content FROM documents",
    "write_results": "SELECT app, content, cleaned_text, emotion, round(emotion_confidence, 6) AS emotion_confidence FROM em",
    "write_negative_by_app": "SELECT id, content, app FROM sn WHERE sentiment = 0",
    "write_filtered": "SELECT r.id, content, true AS is_english, app FROM r SEMI JOIN eng ON eng.id = r.id",
    "clean_text": "SELECT id, cleaned_text FROM c",
    "clean_text_pages": f"SELECT page_id, {clean('html')} AS cleaned_text FROM pages",
    "has_bengali": f"SELECT id, regexp_matches(content, '[{BENGALI}]') AS bengali FROM r",
    "tokenize_words": f"SELECT id, array_to_string({report_tokens('cleaned_text', lex.stopwords())}, ' ') AS tokens FROM c",
    "word_count": f"SELECT id, {n_words('cleaned_text')} AS n_cleaned, {n_words('content')} AS n_raw FROM c",
    "label_decode": f"SELECT vec_id, coalesce({LABEL_CASE.format('label')}, 'Unknown') AS name FROM embeddings",
    "label_remap": f"SELECT vec_id, {_class_case(lex.FIVE_STAR_CLASSES)} AS five, {_class_case(lex.THREE_CLASSES)} AS three, {_class_case(lex.TWO_CLASSES)} AS two FROM embeddings",
    "argmax_map": "SELECT id, emotion AS label, round(emotion_confidence, 6) AS score FROM em",
    "softmax": "SELECT vec_id, round(max(CASE WHEN pos = 1 THEN p END), 6) AS p1, round(max(p), 6) AS top FROM (SELECT vec_id, pos, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM "
    "(SELECT vec_id, pos, exp(10 * v - max(10 * v) OVER (PARTITION BY vec_id)) AS e FROM emlong)) GROUP BY vec_id",
    "cosine_similarity": f"SELECT vec_id, round(similarity, 6) AS similarity FROM ({_similarity(_mean_vector('true'))})",
    "l2_normalize": "SELECT vec_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) + 0.0 AS value FROM emlong",
    "safe_name": f"SELECT page_id, replace(trim(regexp_replace(url, '[^{WORD}{SPACE}-]', '', 'g')), ' ', '_') AS name, translate(lower(url), ' -/', '___') AS file_name FROM pages",
    "bin_score": f"SELECT event_id, {bin_case('s')} AS category FROM (SELECT event_id, value / 20 AS s FROM events)",
    "format_pct": "SELECT app, round_even(n * 100.0::DOUBLE / sum(n) OVER (), 1) AS pct FROM (SELECT app, count(*) AS n FROM r GROUP BY app)",
    "key_concat": "SELECT p_partkey, p_brand || ' (' || p_type || ')' AS key FROM part",
    "filter_english": "SELECT id FROM eng",
    "filter_english_joined": "SELECT id FROM eng",
    "filter_label": "SELECT id, app FROM sn WHERE sentiment = 0",
    "filter_notnull": "SELECT id, theme, sentiment FROM thsn WHERE theme IS NOT NULL",
    "filter_in_set": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')",
    "filter_valid_prediction": "SELECT id, y, words FROM pr WHERE words <> -1",
    "filter_nonblank": "SELECT id FROM c WHERE trim(cleaned_text) <> ''",
    "filter_threshold": "SELECT * FROM mt WHERE accuracy >= 20",
    "theme_scores": "SELECT id, ord, theme, subtheme, score FROM ts",
    "theme_classify": "SELECT id, theme, subtheme FROM th",
    "theme_classify_raw": _raw_theme(),
    "lexicon_scores": "SELECT id, round(neg, 6) AS negative_score, round(pos, 6) AS positive_score FROM ls",
    "lexicon_sentiment": "SELECT id, sentiment FROM sn",
    "lexicon_sentiment_raw": f"SELECT id, {SENTIMENT_CASE} AS sentiment FROM ({bonus('(' + points('content', 'r') + ')')})",
    "coalesce_labels": "SELECT sn.id, coalesce(quality * 2, sentiment) AS ground_truth FROM sn LEFT JOIN labels ON doc_id = sn.id",
    "score_emotion": "SELECT em.id, em.emotion, round(emotion_confidence, 6) AS emotion_confidence, p.emotion AS label, round(p.p, 6) AS p FROM em JOIN emop p ON p.id = em.id",
    "score_toxicity_keywords": "SELECT id, round(toxicity_score, 6) AS toxicity_score, toxicity_category FROM tx",
    "attach_labels": f"SELECT c.id, l.sentiment_label FROM c LEFT JOIN (SELECT DISTINCT cleaned_text, {LABEL_CASE.format('y')} AS sentiment_label FROM lr) l ON l.cleaned_text = c.cleaned_text",
    "theme_cross": "SELECT ord, theme, subtheme, count(*) AS n, CAST(sum(score) AS BIGINT) AS points FROM ts GROUP BY ord, theme, subtheme",
    "vocab_lookup": "SELECT word, count(*) AS n FROM tok SEMI JOIN vocab USING (word) GROUP BY word",
    "stopword_removal": f"SELECT id, count(*) AS n FROM tok WHERE NOT list_contains({text_list(sorted(lex.stopwords()))}, word) GROUP BY id",
    "lookup_map": "SELECT id, emotion, CASE emotion " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in lex.EMOTION_COLOURS.items() if k != "neutral") + f" ELSE {q(lex.OTHER_COLOUR)} END AS colour FROM em",
    "label_distribution": _distribution("th", "theme"),
    "label_distribution_ordered": "SELECT sentiment_label AS label, n, round(100.0::DOUBLE * n / sum(n) OVER (), 6) AS pct FROM (SELECT sentiment_label, count(*) AS n FROM sn GROUP BY sentiment_label)",
    "crosstab_counts": _count_columns("sn", "app", "sentiment_label", ["Negative", "Neutral", "Positive"]),
    "crosstab_row_pct": _pct_columns("em", "app", "emotion", lex.EMOTIONS),
    "crosstab_toxicity_pct": _pct_columns("thtx", "theme", "toxicity_category", ["Low", "Medium", "High"]),
    "crosstab_theme_counts": _count_columns("them", "theme", "emotion", lex.EMOTIONS),
    "per_group_distribution": "SELECT app, emotion, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY app), 6) AS pct FROM (SELECT app, emotion, count(*) AS n FROM em GROUP BY app, emotion)",
    "summary_stats": "SELECT round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value), 6) AS max, round(min(value), 6) AS min FROM events",
    "group_mean_desc": "SELECT app, round(avg(toxicity_score), 6) AS mean FROM tx GROUP BY app",
    "group_mean_count": "SELECT subtheme, round(avg(toxicity_score), 6) AS mean, count(toxicity_score) AS n FROM thtx GROUP BY subtheme",
    "avg_confidence_by_label": "SELECT emotion, round(avg(emotion_confidence), 6) AS mean FROM em GROUP BY emotion",
    "bin_counts": "SELECT ord, b.category, count(e.event_id) AS n, round(100.0::DOUBLE * count(e.event_id) / (SELECT count(*) FROM events), 6) AS pct FROM (VALUES (0, 'Low'), (1, 'Medium'), (2, 'High')) b(ord, category) "
    f"LEFT JOIN (SELECT event_id, {bin_case('value / 20')} AS category FROM events) e ON e.category = b.category GROUP BY ord, b.category",
    "histogram_by_label": "SELECT event_type, bin, round(a + bin * w, 6) AS lo, round(a + (bin + 1) * w, 6) AS hi, count(slot) AS n FROM "
    "(SELECT g.event_type, a, w, bin FROM (SELECT event_type, min(value) AS a, (max(value) - min(value)) / 20 AS w FROM events GROUP BY event_type) g CROSS JOIN (SELECT unnest(range(20)) AS bin)) s "
    "LEFT JOIN (SELECT event_type AS et, least(CAST(floor((value - a) / w) AS BIGINT), 19) AS slot FROM events JOIN (SELECT event_type, min(value) AS a, (max(value) - min(value)) / 20 AS w FROM events GROUP BY event_type) USING (event_type)) v "
    "ON v.et = s.event_type AND v.slot = s.bin GROUP BY event_type, bin, a, w",
    "term_frequency": f"SELECT theme, term, count(*) AS n FROM (SELECT theme, unnest({report_tokens('cleaned_text', lex.stopwords('theme'))}) AS term FROM th WHERE theme IS NOT NULL) GROUP BY theme, term",
    "distinct_values": "SELECT DISTINCT subtheme FROM th WHERE subtheme IS NOT NULL",
    "count_distinct": "SELECT count(DISTINCT app) AS n_app, count(DISTINCT theme) AS n_theme, count(DISTINCT emotion) AS n_emotion FROM them",
    "coverage": "SELECT count(theme) AS classified, count(*) AS total, round(CAST(count(theme) AS DOUBLE) / count(*), 6) AS share FROM th",
    "negative_rate": "SELECT count(*) FILTER (sentiment = 0) AS negative, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (sentiment = 0) / count(*), 6) AS pct FROM sn",
    "confusion_matrix": "SELECT scorer, actual, predicted, n, CASE WHEN sum(n) OVER w > 0 THEN round(CAST(n AS DOUBLE) / sum(n) OVER w, 6) ELSE 0 END AS share FROM cells WINDOW w AS (PARTITION BY scorer, actual)",
    "classification_metrics": "SELECT * FROM mt",
    "lenient_binary_accuracy": "SELECT scorer, round(100.0::DOUBLE * avg(CASE WHEN y = 1 THEN 1 WHEN y = yhat THEN 1 ELSE 0 END), 6) AS accuracy FROM valid GROUP BY scorer",
    "vector_mean": "SELECT label, pos, round(avg(v), 6) + 0.0 AS value FROM emlong GROUP BY label, pos",
    "percentile_thresholds": "SELECT count(*) AS n_rows, round(quantile_cont(l_extendedprice, 0.3), 6) AS p30, round(quantile_cont(l_extendedprice, 0.7), 6) AS p70 FROM lineitem",
    "sort_desc": "SELECT app, CAST(sum(length(content)) AS BIGINT) AS total FROM r GROUP BY app ORDER BY total DESC, app",
    "top_k": "SELECT subtheme, round(avg(toxicity_score), 6) AS mean, count(*) AS n FROM thtx GROUP BY subtheme ORDER BY avg(toxicity_score) DESC, subtheme LIMIT 10",
    "top_terms_per_group": _top_terms("sn", "sentiment_label", lex.stopwords()),
    "top_terms_per_theme": _top_terms("th", "theme", lex.stopwords("theme")),
    "argmax_row": "SELECT * FROM mt ORDER BY accuracy DESC, scorer LIMIT 1",
    "sort_by_key": "SELECT theme, count(*) AS count FROM th WHERE theme IS NOT NULL GROUP BY theme ORDER BY theme",
    "union_all": "SELECT doc_id, text, lang, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, NULL::VARCHAR AS role, NULL::BIGINT AS item_id FROM documents "
    "UNION ALL SELECT NULL, text, NULL, conv_id, turn, role, NULL FROM conversations UNION ALL SELECT NULL, text, NULL, NULL, NULL, NULL, item_id FROM benchmark",
    "distinct_rows": "SELECT DISTINCT cleaned_text, sentiment_label FROM sn",
    "set_union": f"SELECT unnest({space_tokens('text')}) AS word FROM benchmark UNION SELECT unnest({space_tokens('text')}) FROM conversations",
    "stratified_split": "SELECT id, y, split FROM marked_y",
    "tfidf_vocabulary": "SELECT term, cf, df, round(idf, 6) AS idf FROM idf",
    "tfidf_features": "SELECT id, pos, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS value FROM (SELECT g.id, i.pos, count(*) * any_value(i.idf) AS w FROM grams g JOIN idf_tr i ON i.term = g.term JOIN marked_y m ON m.id = g.id WHERE m.split = 'test' GROUP BY g.id, i.pos)",
    "standard_scale": _scaled_by.format("(v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END"),
    "minmax_scale": _scaled_by.format("(v - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END"),
    "word_company": "SELECT a, b, n, round(ln(n * total / (of_a * of_b)), 6) AS ppmi FROM (SELECT a, b, n, CAST(sum(n) OVER () AS DOUBLE) AS total, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS of_a, CAST(sum(n) OVER (PARTITION BY b) AS DOUBLE) AS of_b FROM "
    f"(WITH said AS (SELECT id, unnest({space_tokens('cleaned_text')}) AS w, unnest(range({n_words('cleaned_text')})) AS pos FROM c), often AS (SELECT w FROM said GROUP BY w HAVING count(*) >= 5), "
    "near AS (SELECT l.w AS a, r.w AS b FROM said l CROSS JOIN (VALUES (1), (2), (3), (4)) d(k) JOIN said r ON r.id = l.id AND r.pos = l.pos + d.k) "
    "SELECT a, b, count(*) AS n FROM (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) WHERE a IN (SELECT w FROM often) AND b IN (SELECT w FROM often) GROUP BY a, b)) WHERE ln(n * total / (of_a * of_b)) > 0",
    "build_vocabulary": "SELECT word, idx FROM seqvoc",
    "encode_sequences": "SELECT c.id, array_to_string(list_concat(coalesce(ids, []), list_transform(range(256 - len(coalesce(ids, []))), lambda z: 0)), ' ') AS ids FROM c LEFT JOIN "
    f"(SELECT id, list(coalesce(idx, 1) ORDER BY pos) AS ids FROM (SELECT id, unnest({space_tokens('cleaned_text')}) AS word, unnest(range({n_words('cleaned_text')})) AS pos FROM c) LEFT JOIN seqvoc USING (word) WHERE pos < 256 GROUP BY id) t ON t.id = c.id",
    "stratified_sample": "SELECT id, d.y, draw FROM draws d JOIN ranked_s k ON k.y = d.y AND k.place = d.place",
    "single_class_guard": "SELECT count(DISTINCT y) AS n_classes, count(DISTINCT CASE WHEN split = 'train' THEN y END) AS n_train_classes, count(DISTINCT y) > 1 AS stratify, count(DISTINCT CASE WHEN split = 'train' THEN y END) < 2 AS skip_multi_class, count(DISTINCT y) = 1 AS meaningless FROM marked_y",
    "cluster_label_rule": "SELECT label, round(ns, 6) AS neg_sim, round(ps, 6) AS pos_sim, CASE WHEN ns > ps AND ns > 0.3 THEN 0 WHEN ps > ns AND ps > 0.3 THEN 2 ELSE 1 END AS pseudo_label FROM "
    f"(SELECT label, {_cos.format(a='cen', b='ng')} AS ns, {_cos.format(a='cen', b='po')} AS ps FROM (SELECT label, list(m ORDER BY pos) AS cen, "
    f"{_mean_vector('label IN (0, 1)')} AS ng, {_mean_vector('label IN (2, 3)')} AS po FROM (SELECT label, pos, avg(v) AS m FROM emlong GROUP BY label, pos) GROUP BY label))",
    "similarity_pseudo_labels": "SELECT vec_id, round(similarity, 6) AS similarity, CASE WHEN similarity >= quantile_cont(similarity, 0.7) OVER () THEN 2 WHEN similarity <= quantile_cont(similarity, 0.3) OVER () THEN 0 ELSE 1 END AS pseudo_label FROM "
    f"({_similarity(_mean_vector('label = 2'))})",
    "scorer_comparison": "SELECT m.scorer, CASE WHEN m.scorer = 'length' THEN len_acc ELSE accuracy END AS accuracy, precision, recall, f1 FROM mt m JOIN "
    "(SELECT scorer, round(100.0::DOUBLE * avg(CASE WHEN y = 1 OR y = yhat THEN 1 ELSE 0 END), 6) AS len_acc FROM valid GROUP BY scorer) v ON v.scorer = m.scorer",
    "leaderboard": "SELECT *, row_number() OVER (ORDER BY accuracy DESC, scorer) AS rank, accuracy >= 30 AS highlight, row_number() OVER (ORDER BY accuracy DESC, scorer) = 1 AS best FROM mt",
    "metric_long_form": "SELECT scorer, 'accuracy' AS metric, accuracy AS value FROM mt UNION ALL SELECT scorer, 'precision', precision FROM mt UNION ALL SELECT scorer, 'recall', recall FROM mt UNION ALL SELECT scorer, 'f1', f1 FROM mt",
    "incremental_scoring": "SELECT thsn.id, theme, subtheme, sentiment, round(toxicity_score, 6) AS toxicity_score FROM thsn JOIN tx ON tx.id = thsn.id",
}

# A tree of two levels: each step counts the classes on both sides of every cut of every node.
_NODE_CUTS = (
    "SELECT node, j, v, t0, t1, t2, l0, l1, l2, t0 - l0 AS r0, t1 - l1 AS r1, t2 - l2 AS r2 FROM (SELECT node, j, v, "
    + ", ".join(f"CAST(sum(c{k}) OVER w AS DOUBLE) AS l{k}, CAST(sum(c{k}) OVER (PARTITION BY node, j) AS DOUBLE) AS t{k}" for k in range(3))
    + " FROM (SELECT node, j, f[j] AS v, "
    + ", ".join(f"count(*) FILTER (WHERE y = {k}) AS c{k}" for k in range(3))
    + " FROM {0} CROSS JOIN (VALUES (1), (2), (3)) u(j) GROUP BY ALL) WINDOW w AS (PARTITION BY node, j ORDER BY v))"
)
_SIDE = "({0}0 + {0}1 + {0}2)"
_NODE_GAIN = " + ".join(f"l{k} * l{k} / {_SIDE.format('l')} + r{k} * r{k} / {_SIDE.format('r')}" for k in range(3))
_NODE_WHOLE = f"(t0 * t0 + t1 * t1 + t2 * t2) / {_SIDE.format('t')}"
_NODE_BEST = (
    f"SELECT node, j, v FROM (SELECT *, {_NODE_GAIN} AS gain, {_NODE_WHOLE} AS whole FROM ({_NODE_CUTS}) "
    f"WHERE {_SIDE.format('l')} >= 2 AND {_SIDE.format('r')} >= 2 AND {_SIDE.format('t')} >= 5) "
    "QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, j, v) = 1 AND gain - whole > 1e-9::DOUBLE * (1 + whole)"
)
_NODE_STEP = (
    "SELECT n.id, n.y, n.f, CASE WHEN b.j IS NULL THEN n.node WHEN n.f[b.j] <= b.v THEN 2 * n.node ELSE 2 * n.node + 1 END AS node "
    "FROM {0} n LEFT JOIN ({1}) b ON b.node = n.node"
)
BODY["shallow_tree"] = (
    "WITH n0 AS (SELECT id, y, f, 1 AS node FROM (SELECT l.doc_id AS id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS y, "
    "[coalesce(list_position(['de', 'en', 'es', 'fr'], lang), 0), coalesce(floor(log2(n_chars + 1)), 0), l.doc_id % 7] AS f "
    "FROM labels l JOIN documents d ON d.doc_id = l.doc_id)), "
    f"n1 AS ({_NODE_STEP.format('n0', _NODE_BEST.format('n0'))}), n2 AS ({_NODE_STEP.format('n1', _NODE_BEST.format('n1'))}), "
    "said AS (SELECT node, y AS yhat FROM n2 GROUP BY node, y QUALIFY row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, y) = 1) "
    "SELECT id, y, yhat FROM n2 JOIN said ON said.node = n2.node"
)

# Letters of the cleaned text as counts; class and letter frequencies with one added to each.
_LETTERS = "abcdefghijklmnop"
_letter_rows = (
    "SELECT m.id, m.split, lr.y, "
    + ", ".join(f"length(lr.cleaned_text) - length(replace(lr.cleaned_text, '{a}', '')) AS c{i}" for i, a in enumerate(_LETTERS))
    + " FROM marked_y m JOIN lr ON lr.id = m.id"
)
BODY["naive_bayes_letters"] = (
    f"SELECT * FROM (WITH lettered AS ({_letter_rows}), long AS (SELECT id, split, y, j, CAST([{', '.join(f'c{i}' for i in range(len(_LETTERS)))}][j + 1] AS DOUBLE) AS n "
    f"FROM lettered CROSS JOIN range({len(_LETTERS)}) u(j)), "
    "weight AS (SELECT y AS k, j, ln(sum(n) + 1) - ln(sum(sum(n)) OVER (PARTITION BY y) + " + str(len(_LETTERS)) + ") AS w FROM long WHERE split = 'train' GROUP BY y, j), "
    "prior AS (SELECT y AS k, ln(count(*) + 1) - ln(sum(count(*)) OVER () + count(*) OVER ()) AS p FROM lettered WHERE split = 'train' GROUP BY y), "
    "scored AS (SELECT id, l.y, w.k, any_value(p) + sum(n * w) AS s FROM long l JOIN weight w ON w.j = l.j JOIN prior ON prior.k = w.k WHERE split = 'test' GROUP BY id, l.y, w.k) "
    "SELECT id, y, k AS yhat FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, k) = 1)"
)
_words_of = n_words("cleaned_text")
BODY["score_failing_batches"] = (
    f"SELECT id, CASE WHEN w % 7 IN (3, 5) THEN -1 ELSE w % 2 END AS class_idx, "
    f"CASE WHEN w % 7 IN (3, 5) THEN -1 WHEN w % 2 = 0 THEN 0 ELSE 2 END AS sentiment, CASE WHEN w % 5 = 2 THEN CAST(0 AS DOUBLE) ELSE round(CAST(1 AS DOUBLE) / (1 + w), 6) END AS toxicity_score "
    f"FROM (SELECT id, {_words_of} AS w FROM c)"
)
BODY["kmeans_step"] = (
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), "
    "near AS (SELECT e.vec_id, e.x, CAST(c.vec_id AS INTEGER) AS cluster FROM e JOIN e c ON c.vec_id < 3 "
    "QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY list_sum(list_transform(range(1, len(e.x) + 1), lambda i: (e.x[i] - c.x[i]) * (e.x[i] - c.x[i]))), c.vec_id) = 1), "
    "long AS (SELECT cluster, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS v FROM near) "
    "SELECT cluster, count(*) AS n, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) + 0.0 AS value FROM long GROUP BY cluster, pos"
)
BODY["filter_english_shipped"] = BODY["filter_english"]
BODY["write_utf8_sig"] = "SELECT id, app, cleaned_text, true AS marked FROM c"

ORACLE = {name: with_ctes(sql) for name, sql in BODY.items()}
