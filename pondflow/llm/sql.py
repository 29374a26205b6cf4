"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from pondflow.llm.chat import END
from pondflow.llm.secret_scan import BASE, CANDIDATE, COPIED_OWNERS, KINDS, LEAST_DISTINCT, MOST_OWNERS, PLACEHOLDER, SIGN


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    parts = []
    for kind, (pattern, group, least) in {**BASE, "owned": CANDIDATE}.items():
        p = _quoted(pattern)
        parts.append(f"""SELECT doc_id, source, '{kind}' AS kind, {KINDS.index(kind)} AS rnk, {least} AS least,
            string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v
            FROM docs WHERE regexp_matches(t, {_quoted(SIGN[kind])})""")
    return f"""
    WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
    found AS ({' UNION ALL '.join(parts)}),
    each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
    placed AS (SELECT doc_id, source, kind, rnk, least, v[i] AS val, length(m[i]) AS size,
        list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS a FROM each),
    spans AS (SELECT doc_id, source, kind, rnk, val, a::BIGINT AS a, (a + size)::BIGINT AS b FROM placed WHERE length(val) >= least),
    base AS (SELECT * FROM spans WHERE kind <> 'owned'),
    kept AS (SELECT * FROM base UNION ALL
        SELECT * FROM spans s WHERE kind = 'owned' AND length(regexp_replace(val, '[^0-9]', '', 'g')) >= 3
            AND length(regexp_replace(val, '[^A-Za-z]', '', 'g')) >= 3
            AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = s.doc_id AND x.a < s.b AND x.b > s.a)),
    owners AS (SELECT val, count(DISTINCT source) AS owners FROM kept GROUP BY val),
    marked AS (SELECT kept.*, owners >= {COPIED_OWNERS} AS copied,
        owners <= {MOST_OWNERS} AND len(list_distinct(string_split(val, ''))) >= {LEAST_DISTINCT}
        AND NOT regexp_matches(val, {_quoted(PLACEHOLDER)}) AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Za-z]') AS live
        FROM kept JOIN owners USING (val)),
    final AS (SELECT *, kind || ':' || a || ':' || b AS span FROM marked WHERE kind <> 'owned' OR live)
    SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        sha256(coalesce(string_agg(span, ',' ORDER BY a, rnk) FILTER (kind <> 'owned'), '')) AS base_sha256,
        coalesce(string_agg(span, ',' ORDER BY a, rnk), '') AS spans, count(*) FILTER (kind = 'owned') AS n_owned,
        count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
    FROM docs d LEFT JOIN final f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""


JACCARD = r"""
    WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM grams a JOIN grams b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * o >= 80 * (x.n + y.n - o)),
    edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
    reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT v, c FROM reach JOIN edges ON u = doc_id)
    SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(c) AS component_id
    FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id"""

EXACT = """
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM docs"""

CHAT = rf"""
    WITH talks AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
        len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) + 2 AS tokens FROM talks),
    b AS (SELECT *, n = 1 AND role = 'system' AS sys, sum(tokens) OVER (PARTITION BY conv_id ORDER BY n) - tokens AS start,
        first_value(CASE WHEN n = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n) AS kept FROM a),
    c AS (SELECT *, greatest(1, floor((512 - 128 - kept) / 2)) AS stride FROM b),
    d AS (SELECT *, floor(start / stride) AS step FROM c),
    e AS (SELECT *, step IS DISTINCT FROM lag(step) OVER (PARTITION BY conv_id ORDER BY n) AS fresh FROM d),
    f AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY conv_id ORDER BY n) - 1 AS w,
        min(CASE WHEN fresh THEN start END) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM e),
    g AS (SELECT *, CASE WHEN sys THEN max(w) OVER (PARTITION BY conv_id) WHEN start >= nxt - least(128, stride) THEN 1 ELSE 0 END AS again FROM f)
    SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum((6 + length(replace(replace(replace(replace(replace(role, '\', '\s'), '<', '\l'), '#', '\h'), ':', '\c'), chr(10), '\n'))
            + length(replace(replace(replace(text, '\', '\s'), '<', '\l'), '#', '\h')) + {len(END)}) * (1 + again))::BIGINT AS formatted_chars
    FROM g GROUP BY conv_id"""

def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit over its bytes."""
    step = "CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
    eight = f"list_reduce(list_prepend(xor(c, b), [0::BIGINT,0,0,0,0,0,0,0]), lambda r, z: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda y: ascii(y)::BIGINT)), lambda c, b: {eight}), 4294967295)"


TRIE = f"""
    WITH talks AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32('conv_id::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM talks)),
    rebuilt AS (SELECT i.conv_id, 0 AS part, t.n, role, text FROM ids i JOIN talks t ON t.conv_id = i.base AND t.n <= h
        UNION ALL SELECT i.conv_id, 1, t.n, role, text FROM ids i JOIN talks t ON t.conv_id = i.conv_id AND t.n > h),
    line AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
        string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY part, n) OVER (w ROWS UNBOUNDED PRECEDING) AS key FROM rebuilt
        WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)),
    lens AS (SELECT i.conv_id, coalesce(max(depth), 0) AS len FROM ids i LEFT JOIN line l ON l.conv_id = i.conv_id GROUP BY 1),
    every AS (SELECT conv_id, depth, key, chars FROM line UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
    nodes AS (SELECT key, any_value(depth) AS depth, min(e.conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
        coalesce(string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id) FILTER (len = depth), '') AS ends FROM every e JOIN lens USING (conv_id) GROUP BY key),
    up AS (SELECT *, CASE WHEN depth > 0 THEN key[1:64 * (depth - 1)] END AS above FROM nodes),
    kids AS (SELECT above, count(*) AS k FROM up GROUP BY above),
    weighed AS (SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k, 0) AS n_children, (n.n_convs - 1) * n.chars AS own, coalesce(k, 0) = 0 AS leaf
        FROM up n LEFT JOIN nodes p ON p.key = n.above LEFT JOIN kids ON kids.above = n.key),
    reps AS (SELECT conv_id, depth, own, leaf FROM weighed),
    below AS (SELECT e.key, coalesce(sum(r.own), 0) AS saved, count(*) FILTER (r.leaf) AS leaves
        FROM every e JOIN reps r ON r.conv_id = e.conv_id AND r.depth >= e.depth GROUP BY e.key)
    SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
    FROM weighed JOIN below USING (key)"""

PHRASES = r"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
    words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    grams AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 5) t(k) WHERE len(w) >= k),
    f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
    cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS j FROM cand),
    scored AS (SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score FROM cuts c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    lens AS (SELECT lang, a, w, unnest(range(2, k)) AS m FROM cand WHERE k > 2),
    inside AS (SELECT lang, a, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM lens)),
    longer AS (SELECT lang, phrase, max(a) AS b FROM inside GROUP BY ALL),
    free AS (SELECT l.* FROM lowest l LEFT JOIN longer g ON g.lang = l.lang AND g.phrase = l.phrase WHERE b IS NULL OR 100 * b < 80 * a),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
    SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN totals USING (lang) WHERE rank <= 2000"""

ORACLE: dict[str, str] = {
    "op1_secret_scans": _secrets(),
    "op2_ngram_jaccard_join": JACCARD,
    "op3_exact_dedup": EXACT,
    "op9_chat_formatting": CHAT,
    "op12_prefix_trie": TRIE,
    "op13_phrase_collocations": PHRASES,
}
