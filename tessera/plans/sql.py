"""The queries' equivalents in DuckDB SQL."""

from __future__ import annotations

from tessera.plans.queries import TERMS, TYPOS, WORDS


def tokens(table: str, text: str, key: str, name: str = "post", where: str = "true") -> str:
    """CTE ``name(text, key, token, pos)``: distinct tokens of each text and key with their places."""
    return f"""{name}_ids AS (SELECT DISTINCT coalesce({text}, '') AS text, coalesce(CAST({key} AS VARCHAR), '') AS key FROM {table} WHERE {where}),
    {name}_words AS (SELECT text, key, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT text, key, regexp_split_to_array(text, '[^\\p{{L}}\\d]+') AS w FROM {name}_ids)),
    {name} AS (SELECT text, key, lower(word) AS token, row_number() OVER (PARTITION BY text, key ORDER BY min(i)) - 1 AS pos FROM {name}_words WHERE word <> '' GROUP BY text, key, lower(word))"""


def raw(vocab: str, name: str = "raw", bag: float = 4.0, grams: int = 4) -> str:
    """CTE ``name(token, feature, w)`` of the features of ``vocab(token)`` before accumulation."""
    return f"""{name} AS (
    SELECT token, 'A_' || left(token, 1) AS feature, 1.0::DOUBLE AS w FROM {vocab}
    UNION ALL SELECT token, 'G_' || left(token, 1) || '_' || length(token) || '_' || right(token, 1), 1.0 FROM {vocab} WHERE length(token) > 1
    UNION ALL SELECT token, 'P_' || left(token, i), i FROM (SELECT token, unnest(generate_series(1, least(length(token), 8))) AS i FROM {vocab})
    UNION ALL SELECT token, 'F_' || left(token, 1) || '_' || array_to_string(list_sort(string_split(substr(token, 2, i - 1), '')), ''), i FROM (SELECT token, unnest(generate_series(2, least(length(token), 8))) AS i FROM {vocab})
    UNION ALL SELECT token, substr(token, i, 1) || substr(token, i + 2, 1), 1.0 FROM (SELECT token, unnest(generate_series(1, length(token) - 2)) AS i FROM {vocab})
    UNION ALL SELECT token, 'CB_' || c, {bag} FROM (SELECT DISTINCT token, unnest(string_split(token, '')) AS c FROM {vocab}) WHERE {bag} > 0
    UNION ALL SELECT token, substr(token, i, n), n FROM (SELECT token, n, unnest(generate_series(1, length(token) - n + 1)) AS i FROM {vocab}, (SELECT unnest(generate_series(2, {grams})) AS n)))"""


def vectors(vocab: str, name: str, **settings) -> str:
    return f"""{raw(vocab, name + "_raw", **settings)},
    {name}_sum AS (SELECT token, feature, sum(w) AS w FROM {name}_raw GROUP BY token, feature),
    {name} AS (SELECT token, feature, w / sqrt(sum(w * w) OVER (PARTITION BY token)) AS w FROM {name}_sum)"""


def asked(texts: dict[str, str]) -> str:
    return "asked(query_id, query) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in texts.items()) + ")"


def steps(source: tuple[str, str, str], asked_: str, k: int = 10, slack: int = 5, bonus: float = 0.5, **settings) -> str:
    """The CTEs of a search, up to ``ranked(query_id, rank, text, key, tokens, score)``."""
    return f"""WITH {tokens(*source)},
    sizes AS (SELECT text, key, count(*) AS n_tokens, string_agg(token, ' ' ORDER BY pos) AS tokens FROM post GROUP BY text, key),
    vocab AS (SELECT DISTINCT token FROM post),
    {asked_},
    asked_words AS (SELECT query_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT query_id, regexp_split_to_array(query, '[^\\p{{L}}\\d]+') AS w FROM asked)),
    asked_order AS (SELECT query_id, lower(word) AS qtoken, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS r FROM asked_words WHERE word <> '' GROUP BY query_id, lower(word)),
    terms AS (SELECT query_id, qtoken, count(*) OVER (PARTITION BY query_id) AS n FROM asked_order WHERE r <= 5),
    qvocab AS (SELECT DISTINCT qtoken AS token FROM terms),
    {vectors("vocab", "v", **settings)},
    {vectors("qvocab", "q", **settings)},
    cosines AS (SELECT q.token AS qtoken, v.token, round(sum(q.w * v.w), 9) AS cos FROM q JOIN v USING (feature) GROUP BY q.token, v.token),
    every AS (SELECT q.token AS qtoken, v.token, coalesce(cos, 0.0) AS cos FROM qvocab q CROSS JOIN vocab v LEFT JOIN cosines c ON c.qtoken = q.token AND c.token = v.token),
    best AS (SELECT * FROM (SELECT qtoken, token, cos, row_number() OVER (PARTITION BY qtoken ORDER BY cos DESC, token) AS rank FROM every) WHERE rank <= {k}),
    ranges AS (SELECT query_id, text, key, min(pos) AS lo, max(pos) AS hi FROM terms JOIN best USING (qtoken) JOIN post USING (token) GROUP BY query_id, text, key),
    inside AS (SELECT DISTINCT query_id, token FROM ranges JOIN post USING (text, key) WHERE pos BETWEEN lo - {slack} AND hi + {slack}),
    scored AS (SELECT query_id, token, qtoken, cos FROM terms JOIN cosines USING (qtoken) JOIN inside USING (query_id, token) WHERE cos > 0),
    matches AS (SELECT query_id, text, key, qtoken, cos, pos FROM (
        SELECT query_id, text, key, qtoken, cos, pos, row_number() OVER (PARTITION BY query_id, text, key, qtoken ORDER BY cos DESC, pos) AS r FROM ranges JOIN post USING (text, key) JOIN scored USING (query_id, token)) WHERE r = 1),
    gaps AS (SELECT *, greatest(pos - lag(pos) OVER (PARTITION BY query_id, text, key ORDER BY pos) - 1, 0) AS gap FROM matches),
    per_doc AS (SELECT query_id, text, key, count(*) AS m, sum(1 / greatest(cos, 1e-6)) AS parts, max(cos) AS only_cos,
        sum(CASE WHEN g IS NULL THEN 0 WHEN (g + 1) % 32 = 31 THEN -1 / pow(2, 31) ELSE 1 / pow(2, (g + 1) % 32) END) AS decay FROM (
            SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, text, key ORDER BY pos) = 1 THEN NULL ELSE gap END AS g FROM gaps) GROUP BY query_id, text, key),
    candidates AS (SELECT query_id, text, key, n, n_tokens, tokens, coalesce(m, 0) AS m, coalesce(parts, 0.0) AS parts, coalesce(only_cos, 0.0) AS only_cos, coalesce(decay, 0.0) AS decay
        FROM ranges JOIN (SELECT DISTINCT query_id, n FROM terms) USING (query_id) JOIN sizes USING (text, key) LEFT JOIN per_doc USING (query_id, text, key)),
    scores AS (SELECT query_id, text, key, tokens, round(least(greatest(
        (CASE WHEN n = 1 THEN only_cos ELSE n / (parts + (n - m) * 1e6) END)
        * (1 - {bonus} * (1 - CASE WHEN m >= 2 THEN decay / ((m - 1) * 0.5) WHEN m = 1 AND n > 1 THEN 0 ELSE 1 END))
        * greatest(0.5, 1 - 0.1 * log10(greatest(n_tokens, 1)::DOUBLE)), 0), 1), 6) AS score FROM candidates),
    once AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, left(text, 64), left(key, 64)) AS copy FROM scores),
    ranked AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, left(text, 64), left(key, 64)) AS rank, text, key, tokens, score FROM once WHERE copy = 1) WHERE rank <= {k})
    """


def word_tiers(pairs: str) -> str:
    """CTE ``tiered(a, b, tiers)`` of the words ``pairs(a, b)``, for WITH RECURSIVE: one character of ``a`` after the other; taken ones turn to NULL."""
    taken = lambda of, value: f"list_transform(range(1, len({of}) + 1), lambda k: CASE WHEN n >= 2 AND k >= {'i' if of == 'q' else 'j'} AND k < {'i' if of == 'q' else 'j'} + n THEN {value} ELSE {of}[k] END)"
    return f"""lists AS (SELECT a, b, string_split(lower(a), '') AS q, string_split(lower(b), '') AS t FROM (SELECT DISTINCT a, b FROM {pairs})),
    placed AS (SELECT a, b, 1 AS i,
        list_transform(range(1, len(q) + 1), lambda k: CASE WHEN k <= len(t) AND q[k] = t[k] THEN NULL ELSE q[k] END) AS q,
        list_transform(range(1, len(t) + 1), lambda k: CASE WHEN k <= len(q) AND q[k] = t[k] THEN NULL ELSE t[k] END) AS t,
        list_transform(range(1, len(t) + 1), lambda k: CASE WHEN k <= len(q) AND q[k] = t[k] THEN 0 ELSE -1 END) AS tiers FROM lists),
    blocks AS (SELECT * FROM placed UNION ALL
        SELECT a, b, i + 1, {taken('q', 'NULL')}, {taken('t', 'NULL')}, {taken('tiers', '1')}
        FROM (SELECT *, list_max(runs) AS n, list_position(runs, list_max(runs)) AS j FROM (SELECT *, list_transform(range(1, len(t) + 1), lambda j: coalesce(
            list_filter(range(0, least(len(q) - i, len(t) - j) + 1), lambda k: q[i + k] IS NULL OR t[j + k] IS NULL OR q[i + k] <> t[j + k])[1], least(len(q) - i, len(t) - j) + 1)) AS runs
            FROM blocks WHERE i <= len(q)))),
    singles AS (SELECT a, b, 1 AS i, q, t, tiers FROM blocks WHERE i = len(q) + 1 UNION ALL
        SELECT a, b, i + 1, q, list_transform(range(1, len(t) + 1), lambda k: CASE WHEN k = j THEN NULL ELSE t[k] END), list_transform(range(1, len(t) + 1), lambda k: CASE WHEN k = j THEN 2 ELSE tiers[k] END)
        FROM (SELECT *, CASE WHEN q[i] IS NULL THEN 0 ELSE coalesce(list_position(t, q[i]), 0) END AS j FROM singles WHERE i <= len(q))),
    tiered AS (SELECT a, b, tiers FROM singles WHERE i = length(a) + 1)"""


def heatmaps(asked_: str, slack: int = 5, bonus: float = 0.5) -> str:
    """The CTEs of a search over parts, then ``chars(query_id, text, i, c, tier)`` of all texts, for queries and texts that aren't both one word."""
    return steps(_PARTS, asked_).replace("WITH ", "WITH RECURSIVE ", 1) + f""", texts AS (SELECT DISTINCT text FROM post),
    letters AS (SELECT text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM texts),
    starts AS (SELECT *, regexp_matches(c, '[\\p{{L}}\\d]') AS word, sum(CASE WHEN regexp_matches(c, '[\\p{{L}}\\d]') THEN 0 ELSE 1 END) OVER (PARTITION BY text ORDER BY i) AS gap FROM letters),
    runs AS (SELECT text, gap, lower(string_agg(c, '' ORDER BY i)) AS token, min(i) AS lo, max(i) AS hi FROM starts WHERE word GROUP BY text, gap),
    there AS (SELECT text, token, arg_min(lo, lo) AS lo, arg_min(hi, lo) AS hi, row_number() OVER (PARTITION BY text ORDER BY min(lo)) - 1 AS place FROM runs GROUP BY text, token),
    both_ AS (SELECT DISTINCT query_id, text FROM (SELECT DISTINCT query_id FROM asked_order) CROSS JOIN texts),
    equal AS (SELECT query_id, text, qtoken, place FROM asked_order JOIN there ON token = qtoken),
    fuzzy AS (SELECT b.query_id, b.text, o.qtoken, row_number() OVER (PARTITION BY b.query_id, b.text ORDER BY o.r) AS f FROM both_ b JOIN asked_order o USING (query_id) ANTI JOIN equal e ON e.query_id = b.query_id AND e.text = b.text AND e.qtoken = o.qtoken),
    free AS (SELECT b.query_id, t.text, t.token, t.place FROM both_ b JOIN there t USING (text) ANTI JOIN asked_order o ON o.query_id = b.query_id AND o.qtoken = t.token),
    options AS (SELECT * FROM (SELECT f.query_id, f.text, f.f, f.qtoken, r.token, c.cos, r.place, row_number() OVER (PARTITION BY f.query_id, f.text, f.f ORDER BY c.cos DESC, r.place) AS o
        FROM fuzzy f JOIN terms USING (query_id, qtoken) JOIN free r ON r.query_id = f.query_id AND r.text = f.text JOIN cosines c ON c.qtoken = f.qtoken AND c.token = r.token WHERE c.cos > 0) WHERE o <= {slack}),
    choices AS (SELECT query_id, text, f, o, qtoken, token, cos, place FROM options UNION ALL SELECT query_id, text, f, 1000, NULL, NULL, NULL, NULL FROM fuzzy),
    assigned AS (SELECT query_id, text, 0 AS f, []::INT[] AS o, []::STRUCT(qtoken VARCHAR, token VARCHAR, cos DOUBLE, place BIGINT)[] AS picks FROM both_ UNION ALL
        SELECT a.query_id, a.text, c.f, list_append(a.o, c.o), CASE WHEN c.token IS NULL THEN a.picks ELSE list_append(a.picks, struct_pack(qtoken := c.qtoken, token := c.token, cos := c.cos, place := c.place)) END
        FROM assigned a JOIN choices c ON c.query_id = a.query_id AND c.text = a.text AND c.f = a.f + 1 WHERE c.token IS NULL OR NOT list_contains(list_transform(a.picks, lambda p: p.token), c.token)),
    whole AS (SELECT a.*, list_sort(list_concat(list_transform(a.picks, lambda p: p.place), coalesce((SELECT list(place) FROM equal e WHERE e.query_id = a.query_id AND e.text = a.text), []))) AS places
        FROM assigned a WHERE f = (SELECT count(*) FROM fuzzy z WHERE z.query_id = a.query_id AND z.text = a.text)),
    valued AS (SELECT *, CASE WHEN len(picks) > 0 THEN len(picks) / list_sum(list_transform(picks, lambda p: 1 / greatest(p.cos, 1e-6))) ELSE 0 END
        * CASE WHEN len(places) > 1 THEN 1 - {bonus} * (1 - list_sum(list_transform(range(2, len(places) + 1), lambda k: 1 / pow(2, greatest(places[k] - places[k - 1] - 1, 0) + 1))) / ((len(places) - 1) * 0.5)) ELSE 1 END AS value FROM whole),
    chosen AS (SELECT query_id, text, picks FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY len(picks) DESC, round(value, 12) DESC, o) AS r FROM valued) WHERE r = 1),
    matched AS (SELECT query_id, text, qtoken, qtoken AS token FROM equal UNION ALL SELECT query_id, text, p.qtoken, p.token FROM (SELECT query_id, text, unnest(picks) AS p FROM chosen)),
    shapes AS (SELECT m.query_id, m.text, t.lo, t.hi, m.qtoken AS a, substr(m.text, t.lo, t.hi - t.lo + 1) AS b FROM matched m JOIN there t USING (text, token)),
    {word_tiers('shapes')},
    marked AS (SELECT query_id, text, lo + k - 1 AS i, tiers[k] AS tier FROM (SELECT s.query_id, s.text, s.lo, w.tiers, unnest(range(1, len(w.tiers) + 1)) AS k FROM shapes s JOIN tiered w USING (a, b))),
    chars AS (SELECT b.query_id, l.text, l.i, l.c, coalesce(m.tier, -1) AS tier FROM both_ b JOIN letters l USING (text) LEFT JOIN marked m USING (query_id, text, i))
    """


_PARTS = ("part", "p_name", "p_partkey")
_RESULT = "SELECT query_id, rank, text, key, tokens, score FROM ranked"
_SINGLE = {"exact": "widget", "typo": "gizom", "letter": "g", "nothing": "???", "blank": "  "}
_PART_VOCAB = f"{tokens(*_PARTS)}, vocab AS (SELECT DISTINCT token FROM post)"

ORACLE_SQL = {
    "tokenize_parts": f"WITH {tokens(*_PARTS)} SELECT p_partkey, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS tokens, count(token) AS n_tokens FROM part LEFT JOIN post ON key = CAST(p_partkey AS VARCHAR) GROUP BY p_partkey",
    "tokenize_documents": f"WITH {tokens('documents', 'text', 'doc_id')} SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS tokens, count(token) AS n_tokens FROM documents LEFT JOIN post ON key = CAST(doc_id AS VARCHAR) GROUP BY doc_id",
    "query_tokenization": f"WITH {tokens('documents', 'text', 'doc_id')} SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (pos < 5), '') AS tokens FROM documents LEFT JOIN post ON key = CAST(doc_id AS VARCHAR) GROUP BY doc_id",
    "doc_identity": "SELECT p_partkey, p_name AS text, CAST(p_partkey AS VARCHAR) AS key, length(p_name) + 1 + length(CAST(p_partkey AS VARCHAR)) AS size FROM part",
    "postings_parts": f"WITH {tokens(*_PARTS)} SELECT token, key, pos FROM post",
    "vocabulary_documents": f"WITH {tokens('documents', 'text', 'doc_id')} SELECT token, count(*) AS n_docs, min(pos) AS first_pos FROM post GROUP BY token",
    "char_features": f"WITH {tokens(*_PARTS)}, {tokens('nation', 'n_name', 'n_nationkey', 'npost')}, vocab AS (SELECT token FROM post UNION SELECT token FROM npost), {vectors('vocab', 'v')} SELECT token, feature, round(w, 9) AS w FROM v",
    "raw_char_features": f"WITH {tokens('part', 'p_type', 'p_partkey')}, vocab AS (SELECT DISTINCT token FROM post), {raw('vocab')} SELECT token, feature, w, count(*) AS times FROM raw GROUP BY token, feature, w",
    "vector_norms": f"WITH {_PART_VOCAB}, {vectors('vocab', 'v')} SELECT token, round(sqrt(sum(w * w)), 9) AS norm, count(*) AS n_features FROM v GROUP BY token",
    "token_similarity": f"WITH {_PART_VOCAB}, {vectors('vocab', 'v')} SELECT x.token AS a, y.token AS b, round(sum(x.w * y.w), 9) AS cos FROM v x JOIN v y USING (feature) GROUP BY x.token, y.token",
    "vocabulary_topk": steps(_PARTS, asked(TYPOS)) + "SELECT qtoken, token, cos, rank FROM best",
    "candidate_windows": steps(_PARTS, asked(TYPOS)) + "SELECT query_id, key, lo, hi FROM ranges",
    "scored_window_tokens": steps(_PARTS, asked(TYPOS)) + "SELECT query_id, token, qtoken, cos FROM scored",
    "best_token_match": steps(_PARTS, asked(TYPOS)) + "SELECT query_id, key, qtoken, cos, pos FROM matches",
    "candidate_scores": steps(_PARTS, asked(WORDS)) + "SELECT query_id, key, score FROM scores",
    "find_single_token": steps(_PARTS, asked(_SINGLE)) + _RESULT,
    "find_multi_word": steps(_PARTS, asked(WORDS)) + _RESULT,
    "find_typos": steps(_PARTS, asked(TYPOS)) + _RESULT,
    "find_multi_query": steps(("nation", "n_name", "n_nationkey"), "asked AS (SELECT DISTINCT p_name AS query_id, p_name AS query FROM part UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TERMS.items()) + "))") + _RESULT,
    "find_customers": steps(("customer", "c_name", "c_custkey"), asked({"number": "customer 000000017", "typo": "custmer 00000099", "cut": "cust"})) + _RESULT,
    "find_documents": steps(("documents", "text", "doc_id"), asked({"en": "th the oution", "de": "der einung", "typo": "licnsed unter", "one": "worthles"})) + "SELECT query_id, rank, key, score FROM ranked",
    "late_dedup_by_key": steps(("part", "p_name", "p_brand"), asked(TYPOS)) + _RESULT,
    "find_with_settings": steps(_PARTS, asked(WORDS), k=3, slack=0, bonus=0.9, bag=0.0, grams=2) + _RESULT,
    "find_stored_items": steps(_PARTS, asked(TYPOS)) + "SELECT query_id, rank, score, p_partkey, p_name, p_brand, p_size FROM ranked JOIN part ON key = CAST(p_partkey AS VARCHAR)",
    "first_write_wins": "SELECT p_name, p_brand, min(p_partkey) AS p_partkey, arg_min(p_size, p_partkey) AS p_size FROM part GROUP BY p_name, p_brand",
    "add_documents": "SELECT p_name, p_brand, coalesce(min(p_partkey) FILTER (p_size <= 25), min(p_partkey)) AS p_partkey FROM part GROUP BY p_name, p_brand",
    "contains_items": "SELECT p_partkey FROM part WHERE (p_name, p_brand) IN (SELECT (p_name, p_brand) FROM part WHERE p_size <= 10)",
    "remove_docs": f"WITH {tokens(*_PARTS, where='p_size <= 10')} SELECT token, count(*) AS n_docs FROM post GROUP BY token",
    "clear_index": f"WITH {tokens(*_PARTS, where='p_size < 5')} SELECT text, key, count(*) AS n_tokens FROM post GROUP BY text, key",
    "index_size": f"""WITH {tokens('documents', 'text', 'doc_id', 'd')}, {tokens('part', 'p_name', 'p_brand', 'p')}
        SELECT 'documents' AS name, (SELECT count(*) FROM d_ids) AS docs, count(*) AS postings, count(DISTINCT token) AS vocabulary FROM d
        UNION ALL SELECT 'parts', (SELECT count(*) FROM p_ids), count(*), count(DISTINCT token) FROM p""",
    "merge_index": "SELECT p_name, p_brand, coalesce(min(p_partkey) FILTER (p_size > 10), min(p_partkey)) AS p_partkey FROM part GROUP BY p_name, p_brand",
    "length_penalties": f"WITH {tokens('documents', 'text', 'doc_id')} SELECT doc_id, round(greatest(0.5, 1 - 0.1 * log10(greatest(count(token), 1)::DOUBLE)), 9) AS penalty FROM documents LEFT JOIN post ON key = CAST(doc_id AS VARCHAR) GROUP BY doc_id",
    "proximity_decay": """WITH c AS (SELECT event_id, unnest(list_sort(list_transform(string_split(props, ''), lambda x: ascii(x)))) AS p, generate_subscripts(string_split(props, ''), 1) AS i FROM events WHERE props IS NOT NULL),
        g AS (SELECT event_id, p, i, p - lag(p) OVER (PARTITION BY event_id ORDER BY i) AS d FROM c),
        t AS (SELECT event_id, count(*) AS m, sum(CASE WHEN d IS NULL THEN 0 WHEN (greatest(d - 1, 0) + 1) % 32 = 31 THEN -1 / pow(2, 31) ELSE 1 / pow(2, (greatest(d - 1, 0) + 1) % 32) END) AS decay FROM g GROUP BY event_id)
        SELECT event_id, round(CASE WHEN m >= 2 THEN decay / ((m - 1) * 0.5) WHEN m = 1 THEN 0 ELSE 1 END, 9) AS near FROM t""",
    "query_token_sets": f"""WITH {tokens(*_PARTS)}, {tokens('part', "p_type || ' small red widget'", 'p_partkey', 'kind')}
        SELECT p_partkey,
            coalesce((SELECT string_agg(token, ' ' ORDER BY token) FROM post WHERE key = CAST(p_partkey AS VARCHAR) AND token IN (SELECT token FROM kind WHERE key = CAST(p_partkey AS VARCHAR))), '') AS shared,
            coalesce((SELECT string_agg(token, ' ' ORDER BY token) FROM post WHERE key = CAST(p_partkey AS VARCHAR) AND token NOT IN (SELECT token FROM kind WHERE key = CAST(p_partkey AS VARCHAR))), '') AS only_name,
            coalesce((SELECT string_agg(token, ' ' ORDER BY token) FROM kind WHERE key = CAST(p_partkey AS VARCHAR) AND token NOT IN (SELECT token FROM post WHERE key = CAST(p_partkey AS VARCHAR))), '') AS only_type
        FROM part""",
    "snapshot_roundtrip": f"WITH {tokens(*_PARTS)} SELECT text, key, string_agg(token, ' ' ORDER BY pos) AS tokens, any_value(p_size) AS p_size FROM post JOIN part ON key = CAST(p_partkey AS VARCHAR) GROUP BY text, key",
    "snapshot_vectors": f"WITH {_PART_VOCAB}, {vectors('vocab', 'v')} SELECT token, feature, round(CAST(CAST(w AS FLOAT) AS DOUBLE), 4) AS w FROM v",
    "snapshot_find": steps(_PARTS, asked(TYPOS)) + "SELECT query_id, rank, text, key, tokens, round(score, 3) AS score FROM ranked",
    "snapshot_self_keyed": "SELECT p_name AS text, p_name AS key, min(p_partkey) AS p_partkey FROM part GROUP BY p_name",
    "find_self_keyed": steps(("part", "p_name", "p_name"), asked(TYPOS)) + _RESULT,
    "tsv_parse": r"""WITH l AS (SELECT rtrim(unnest(string_split(text, chr(10))), chr(13)) AS line FROM documents),
        k AS (SELECT line, regexp_extract(line, '^([^\s,]*)', 1) AS key FROM l),
        t AS (SELECT key, CASE WHEN key = '' THEN '' ELSE trim(substr(line, length(key) + 2), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS title FROM k)
        SELECT key, count(*) AS n, min(title) AS least, max(title) AS most FROM t GROUP BY key""",
    "read_keyed_lines": "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS title FROM part",
    "crawl_files": "SELECT n_nationkey, n_regionkey FROM nation",
    "word_heatmaps": f"WITH RECURSIVE pairs AS (SELECT DISTINCT p_type AS a, p_brand AS b FROM part), {word_tiers('pairs')} SELECT p_partkey, array_to_string(tiers, ',') AS tiers FROM part JOIN tiered ON a = p_type AND b = p_brand",
    "heatmap_parts": heatmaps(asked(TYPOS)) + "SELECT query_id, CAST(p_partkey AS VARCHAR) AS key, tiers FROM part JOIN (SELECT query_id, text, string_agg(CAST(tier AS VARCHAR), ',' ORDER BY i) AS tiers FROM chars GROUP BY query_id, text) ON text = p_name",
    "highlight_parts": heatmaps(asked(TYPOS)) + """SELECT query_id, rank, shown FROM ranked JOIN (
        SELECT query_id, text, string_agg(chr(27) || CASE tier WHEN 0 THEN '[93m' WHEN 1 THEN '[33m' WHEN 2 THEN '[36m' ELSE '[90m' END || c || chr(27) || '[0m', '' ORDER BY i) AS shown FROM chars GROUP BY query_id, text) USING (query_id, text)""",
    "streaming_remove_find": steps(("(SELECT * FROM part WHERE p_name NOT LIKE '%e')", "p_name", "p_name"), asked(TYPOS)) + _RESULT,
    "streaming_index_find": steps(_PARTS, asked(TYPOS)) + _RESULT,
    "streaming_queries": steps(("region", "r_name", "r_regionkey"), "asked AS (SELECT n_nationkey AS query_id, n_name AS query FROM nation)") + _RESULT,
    "streaming_dedup": "SELECT DISTINCT p_name, p_brand FROM part",
}
