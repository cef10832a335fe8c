"""The same queries in plain SQL, for checking."""

from __future__ import annotations

from ..functions.text import ENGLISH_STOP_WORDS
from .queries import BOOST, K, POINT, REPEATED, SEVERAL, SMALL_BOOST, TERMS, WHITELIST

WORD = r"[\p{L}\p{N}]+"


def _strings(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = f"[{_strings(ENGLISH_STOP_WORDS)}]"

TOKENS = f"tok AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS tokens FROM documents)"
LENGTHS = "lens AS (SELECT doc_id, CAST(len(tokens) AS BIGINT) AS dl FROM tok)"
TF = """tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf
               FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY doc_id, term)"""
STATS = """stats AS (SELECT CAST(count(*) FILTER (dl > 0) AS BIGINT) AS n_docs,
                            CAST(sum(dl) AS BIGINT) AS sum_ttf,
                            CAST(sum(dl) AS DOUBLE) / count(*) FILTER (dl > 0) AS avgdl FROM lens)"""
DF = "dfs AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term)"
BASE = ",\n".join([TOKENS, LENGTHS, TF, STATS, DF])

QUANTIZED = """CASE WHEN dl < 40 THEN dl
    ELSE 24 + (((dl - 24) >> (length(bin(dl - 24)) - 4)) << (length(bin(dl - 24)) - 4)) END"""
IDF = "ln(1 + (n_docs - df + 0.5) / (df + 0.5))"


def _parts(length: str = QUANTIZED) -> str:
    """One row per posting with every factor of its partial score."""
    norm = f"(1.2 * (0.25 + 0.75 * ({length}) / avgdl))"
    return f"""parts AS (
    SELECT doc_id, term, tf, df, dl, {IDF} AS idf, {norm} AS norm,
           {IDF} * 2.2 * tf / (tf + {norm}) AS partial
    FROM tf JOIN dfs USING (term) JOIN lens USING (doc_id), stats)"""


def _queries(by_id: dict[int, list[str]]) -> str:
    rows = ", ".join(f"(CAST({i} AS BIGINT), '{t}')" for i, terms in by_id.items() for t in terms)
    return f"q AS (SELECT * FROM (VALUES {rows}) v(query_id, term))"


BATCH = f"""q AS (SELECT DISTINCT query_id, term FROM (
    SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM benchmark))"""

TURNS = f"""q AS (SELECT DISTINCT query_id, term FROM (
    SELECT concat_ws('-', conv_id, turn) AS query_id,
           unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM conversations))"""

SCORES = """scores AS (SELECT query_id, doc_id, sum(partial) AS score
                       FROM q JOIN parts USING (term) GROUP BY query_id, doc_id)"""
RANKED = """ranked AS MATERIALIZED (SELECT query_id, row_number() OVER (
    PARTITION BY query_id ORDER BY CAST(score AS FLOAT) DESC, doc_id) AS rank, doc_id, score FROM scores)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def _retrieval(queries: str, tail: str, parts: str | None = None, *extra: str) -> str:
    return _with(BASE, parts or _parts(), queries, *extra, SCORES, RANKED) + "\n" + tail


TOP = f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= {K}"
SINGLE = _queries({0: TERMS})
REPEAT = _queries({0: REPEATED})
IDS = "ids AS (SELECT CAST(unnest([{}]) AS BIGINT) AS query_id)"

TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
DESC = r"""trim(regexp_replace(regexp_replace(
    regexp_replace(html, '(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>', ' ', 'g'),
    '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""
PAGES = f"pg AS (SELECT page_id, {TITLE} AS title, {DESC} AS \"desc\" FROM pages)"

# Standard word breaking without look-around: a private-use mark is set before
# every joining character (twice, as neighbouring matches overlap).
MARK = "\ue000"
_JOIN_L = r"'(\p{L})([''‘’․.:·‧])(\p{L})', '\1" + MARK + r"\2\3', 'g'"
_JOIN_D = r"'(\p{Nd})([''‘’․.,;])(\p{Nd})', '\1" + MARK + r"\2\3', 'g'"
_MARKED = "lower(text)"
for _rule in (_JOIN_L, _JOIN_L, _JOIN_D, _JOIN_D):
    _MARKED = f"regexp_replace({_MARKED}, {_rule})"
_S = r"[\p{L}\p{Nd}\p{Nl}]"
_R = r"[\p{L}\p{Nd}\p{Nl}\p{M}\p{Cf}_]"
STANDARD = f"_*{_S}{_R}*(?:{MARK}.{_S}{_R}*)*"

POINTS = "SELECT vec_id AS doc_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"
DIST = f"""dist AS (SELECT doc_id, sqrt((x - ({POINT[0]}::DOUBLE)) * (x - ({POINT[0]}::DOUBLE))
    + (y - ({POINT[1]}::DOUBLE)) * (y - ({POINT[1]}::DOUBLE))) AS dist FROM ({POINTS}))"""

JOINED = "SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, coalesce(array_to_string(tokens, ' '), '') AS tokens"
OFFSETS = """offs AS (SELECT term, df, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id,
    CAST(sum(df) OVER (ORDER BY term) - df AS BIGINT) AS "start",
    CAST(sum(df) OVER (ORDER BY term) AS BIGINT) AS "end" FROM dfs)"""

ORACLE: dict[str, str] = {
    "scan_limit": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 41",
    "csv_roundtrip": """SELECT md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars,
        count(*) AS copies FROM documents GROUP BY text""",
    "abstracts_roundtrip": _with(PAGES)
    + """ SELECT replace(title, 'Wikipedia: ', '') AS title, "desc", count(*) AS copies
        FROM (SELECT title, "desc" FROM pg
              UNION ALL SELECT 'more of ' || title, 'again ' || "desc" FROM pg WHERE page_id % 2 = 0)
        WHERE length("desc") > 15 GROUP BY 1, 2""",
    "csv_numbered": """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, md5(text) AS text_md5,
        CAST(length(text) AS BIGINT) AS n_chars FROM documents""",
    "abstracts_carry": _with(PAGES)
    + """ SELECT coalesce(title, '') AS title, "desc" FROM (
            SELECT last_value(CASE WHEN page_id % 3 = 1 THEN replace(title, 'Wikipedia: ', '') END IGNORE NULLS)
                       OVER (ORDER BY page_id) AS title,
                   page_id || ' ' || "desc" AS "desc" FROM pg)
        WHERE length("desc") > 15""",
    "xml_abstracts": _with(PAGES)
    + """ SELECT trim(replace(title, 'Wikipedia: ', '')) AS title, "desc", count(*) AS copies
        FROM pg WHERE length("desc") > 15 GROUP BY 1, 2""",
    "extract_title_desc": _with(PAGES) + ' SELECT page_id, title, "desc" FROM pg',
    "strip_title": """SELECT page_id, replace(replace(replace(
        regexp_extract(html, '(?is)<title[^>]*>.*?</title>', 0), '<title>', ''), '</title>', ''),
        'Wikipedia: ', '') AS title FROM pages""",
    "filter_min_length": _with(PAGES) + " SELECT page_id, title FROM pg WHERE length(title) > 50",
    "assign_doc_ids": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents",
    "segment_offsets": """SELECT source, n_docs,
        CAST(sum(n_docs) OVER (ORDER BY source) - n_docs AS BIGINT) AS base
        FROM (SELECT source, count(*) AS n_docs FROM documents GROUP BY source)""",
    "tokenize": _with(TOKENS) + f" {JOINED} FROM tok",
    "tokenize_stopwords": _with(TOKENS)
    + f" {JOINED} FROM (SELECT doc_id, [t for t in tokens if NOT list_contains({STOP}, t)] AS tokens FROM tok)",
    "tokenize_standard": f"""{JOINED} FROM (
        SELECT doc_id, [replace(t, '{MARK}', '') for t in regexp_extract_all({_MARKED}, '{STANDARD}')
            if NOT list_contains({STOP}, replace(t, '{MARK}', ''))] AS tokens FROM documents)""",
    "term_freq": _with(TOKENS, TF) + " SELECT doc_id, term, tf FROM tf",
    "multi_field_df": _with(PAGES)
    + f""", f AS (SELECT page_id, 'title' AS field, title AS text FROM pg
            UNION ALL SELECT page_id, 'body', "desc" FROM pg)
        SELECT field, term, count(DISTINCT page_id) AS df FROM (
            SELECT field, page_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM f)
        GROUP BY field, term""",
    "doc_length": _with(TOKENS, LENGTHS) + " SELECT doc_id, dl FROM lens",
    "length_quantized": _with(TOKENS, LENGTHS) + f" SELECT doc_id, dl, CAST({QUANTIZED} AS BIGINT) AS len FROM lens",
    "collection_stats": _with(TOKENS, LENGTHS, STATS)
    + " SELECT n_docs, sum_ttf, round(avgdl, 6) AS avgdl FROM stats",
    "doc_freq": _with(TOKENS, TF, DF) + " SELECT term, df FROM dfs",
    "idf": _with(BASE) + f" SELECT term, df, round({IDF}, 6) AS idf FROM dfs, stats",
    "length_norm": _with(BASE)
    + f" SELECT doc_id, round(1.2 * (0.25 + 0.75 * ({QUANTIZED}) / avgdl), 6) AS norm FROM lens, stats",
    "impacts": _with(BASE, _parts()) + " SELECT term, doc_id, round(partial, 6) AS partial FROM parts",
    "posting_lists": _with(TOKENS, TF)
    + " SELECT term, count(*) AS df, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM tf GROUP BY term",
    "term_dictionary": _with(TOKENS, TF, DF, OFFSETS) + " SELECT term, term_id, df FROM offs",
    "term_offsets": _with(TOKENS, TF, DF, OFFSETS) + ' SELECT term, "start", "end" FROM offs',
    "index_summary": _with(TOKENS, TF, DF)
    + """ SELECT (SELECT count(*) FROM documents) AS total_docs, count(*) AS n_terms,
        CAST(sum(df) AS BIGINT) AS n_postings FROM dfs""",
    "impact_sample": _with(BASE, _parts())
    + " SELECT term, doc_id, round(partial, 6) AS partial FROM parts ORDER BY term, doc_id LIMIT 20",
    "merge_segments": _with(TOKENS, TF)
    + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ttf FROM tf GROUP BY term",
    "incremental_equals_full": _retrieval(BATCH, TOP),
    "append_after_merge": _with(TOKENS, TF, DF) + " SELECT term, df FROM dfs",
    "stream_into_built_index": _with(TOKENS, TF, DF) + " SELECT term, df FROM dfs",
    "stream_ingest": _with(TOKENS, TF, DF) + " SELECT term, df FROM dfs",
    "index_roundtrip": _with(BASE, _parts(), OFFSETS)
    + """, agg AS (SELECT term, count(*) AS n, round(sum(partial), 4) AS total FROM parts GROUP BY term)
        SELECT term, df, term_id, "start", "end", n, total FROM offs JOIN agg USING (term)""",
    "resolve_terms": _with(BASE, SINGLE)
    + f" SELECT query_id, term, CAST(1 AS DOUBLE) AS boost, df, round({IDF}, 6) AS idf FROM q JOIN dfs USING (term), stats",
    "gather_postings": _with(BASE, _parts(), SINGLE)
    + " SELECT query_id, term, doc_id, tf, round(partial, 6) AS partial FROM q JOIN parts USING (term)",
    "bm25_topk": _retrieval(SINGLE, TOP),
    "bm25_topk_scan": _retrieval(SINGLE, TOP),
    "bm25_topk_batch": _retrieval(BATCH, TOP),
    "bm25_topk_blocks": _retrieval(TURNS, TOP),
    "bm25_all": _retrieval(
        SINGLE, "SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked"
    ),
    "bm25_scores": _retrieval(SINGLE, "SELECT doc_id, round(score, 6) AS score FROM scores"),
    "bm25_whitelist": _retrieval(
        SINGLE.replace("v(query_id, term))", f"v(query_id, term) WHERE term IN ({_strings(WHITELIST)}))"),
        TOP,
    ),
    "bm25_accept_docs": _with(
        BASE,
        _parts(),
        SINGLE,
        """scores AS (SELECT query_id, doc_id, sum(partial) AS score FROM q JOIN parts USING (term)
            WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY query_id, doc_id)""",
        RANKED,
    )
    + "\n"
    + TOP,
    "bm25_repeat_terms": _retrieval(REPEAT, TOP),
    "bm25_distinct_terms": _retrieval(REPEAT.replace("SELECT *", "SELECT DISTINCT *"), TOP),
    "bm25_boost": _with(
        BASE,
        _parts(),
        REPEAT,
        f"""scores AS (SELECT query_id, doc_id, sum({BOOST} * partial) AS score
            FROM q JOIN parts USING (term) GROUP BY query_id, doc_id)""",
        RANKED,
    )
    + "\n"
    + TOP,
    "bm25_small_boost": _with(
        BASE,
        _parts(),
        SINGLE,
        f"""scores AS (SELECT query_id, doc_id, sum({SMALL_BOOST}::DOUBLE * partial) AS score
            FROM q JOIN parts USING (term) GROUP BY query_id, doc_id)""",
        RANKED,
    )
    + f" SELECT query_id, rank, doc_id, round(score * 1e7, 6) AS score FROM ranked WHERE rank <= {K}",
    "bm25_no_norms": _retrieval(SINGLE, TOP, _parts("1")),
    "total_hits": _retrieval(
        _queries(SEVERAL),
        """SELECT query_id, count(doc_id) AS total_hits, round(max(score), 6) AS max_score
           FROM ids LEFT JOIN scores USING (query_id) GROUP BY query_id""",
        None,
        IDS.format("0, 1, 2, 3, 4"),
    ),
    "total_hits_blocks": _retrieval(
        TURNS,
        """SELECT query_id, count(doc_id) AS total_hits, round(max(score), 6) AS max_score
           FROM ids LEFT JOIN scores USING (query_id) GROUP BY query_id""",
        None,
        "ids AS (SELECT concat_ws('-', conv_id, turn) AS query_id FROM conversations)",
    ),
    "match_only_blocks": _with(TOKENS, TF, BATCH) + " SELECT DISTINCT query_id, doc_id FROM q JOIN tf USING (term)",
    "candidate_size": _with(TOKENS, TF, DF, _queries({**SEVERAL, 5: REPEATED}), IDS.format("0, 1, 2, 3, 4, 5"))
    + """ SELECT query_id, CAST(coalesce(sum(df), 0) AS BIGINT) AS candidates
          FROM ids LEFT JOIN q USING (query_id) LEFT JOIN dfs USING (term) GROUP BY query_id""",
    "match_only": _with(TOKENS, TF, _queries(SEVERAL)) + " SELECT DISTINCT query_id, doc_id FROM q JOIN tf USING (term)",
    "explain_topk": _with(
        BASE,
        BATCH,
        _parts().replace("parts AS (", "parts AS MATERIALIZED (", 1).replace("stats)", "stats WHERE term IN (SELECT term FROM q))"),
        SCORES.replace("scores AS", "scores AS MATERIALIZED", 1),
        RANKED,
    )
    + f""" SELECT query_id, doc_id, term, tf, df, round(idf, 6) AS idf, dl, round(norm, 6) AS norm,
                   round(partial, 6) AS partial
            FROM q JOIN parts USING (term) JOIN (SELECT query_id, doc_id FROM ranked WHERE rank <= {K})
            USING (query_id, doc_id)""",
    "score_all_docs": _retrieval(
        SINGLE,
        "SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN scores USING (doc_id)",
    ),
    "compare_rankings": _with(
        BASE,
        _parts(),
        _parts("dl").replace("parts AS", "parts2 AS", 1),
        BATCH,
        SCORES,
        SCORES.replace("scores AS", "scores2 AS", 1).replace("JOIN parts", "JOIN parts2"),
        RANKED,
        RANKED.replace("ranked AS MATERIALIZED", "ranked2 AS", 1).replace("FROM scores", "FROM scores2"),
    )
    + f""" SELECT query_id, doc_id, coalesce(a.rank, 0) AS left_rank, coalesce(b.rank, 0) AS right_rank,
            round(a.score, 6) AS left_score, round(b.score, 6) AS right_score,
            coalesce(b.rank - a.rank, 0) AS rank_delta
        FROM (SELECT * FROM ranked WHERE rank <= {K}) a
        FULL JOIN (SELECT * FROM ranked2 WHERE rank <= {K}) b USING (query_id, doc_id)""",
    "geo_distance": _with(DIST) + " SELECT doc_id, round(dist, 6) AS dist FROM dist",
    "geo_nearest": _with(DIST)
    + """ SELECT row_number() OVER (ORDER BY dist, doc_id) AS rank, doc_id, round(dist, 6) AS dist FROM dist""",
    "geo_topk": _with(DIST) + f" SELECT doc_id, round(dist, 6) AS dist FROM dist ORDER BY dist, doc_id LIMIT {K}",
}
ORACLE["csv_split"] = ORACLE["csv_numbered"]
ORACLE["bm25_topk_scan"] = ORACLE["bm25_topk"]
