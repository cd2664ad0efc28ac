"""What the queries that SQL can express should return, as DuckDB SQL on the same tables."""

from __future__ import annotations

EXACT_TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
    s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

_SIGNS = r"[\[<]\\*(?:/?(?:SYS\]|INST\]|ROLE\])|/?s>)"
CHAT_FORMAT = rf"""WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
    m AS (SELECT *, len(regexp_extract_all(text, '{_SIGNS}')) AS escapes, len(regexp_extract_all(role, '{_SIGNS}')) AS in_role,
        CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 END AS marks FROM t)
    SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(COALESCE(SUM(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
        sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
        CAST(SUM(length(text) + escapes + COALESCE(marks, 17 + length(role) + in_role)) AS BIGINT) AS formatted_chars
    FROM m GROUP BY conv_id"""

_LEAVES = r"(?:\S{1,64}\s*){1,8}|\s+"


# The tree of a text t and of its edited text e, level by level: leaves (l), paragraphs' digests (p) and shown leaves (s), sections (c).
_LEVELS = [
    {f"l{k}": f"list_transform(string_split({t}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{_LEAVES}'), lambda x: sha256(x)))" for k, t in (("t", "t"), ("e", "edited"))},
    {f"p{k}": f"list_transform(l{k}, lambda p: sha256(array_to_string(p, '')))" for k in "te"} | {f"s{k}": f"list_transform(l{k}, lambda p: array_to_string(list_transform(p, lambda x: x[1:8]), ''))" for k in "te"},
    {f"c{k}": f"list_transform(range(0, len(p{k}), 8), lambda i: [sha256(array_to_string(p{k}[i + 1:i + 8], '')), array_to_string(s{k}[i + 1:i + 8], '/')])" for k in "te"},
    {n: f"sha256(array_to_string(list_transform(c{k}, lambda x: x[1]), '')) || ':' || array_to_string(list_transform(c{k}, lambda x: x[1][1:8] || '=' || x[2]), '|')" for n, k in (("fingerprint", "t"), ("edited_fingerprint", "e"))},
    {"next_print": "COALESCE(LEAD(fingerprint) OVER (ORDER BY doc_id DESC), FIRST_VALUE(fingerprint) OVER (ORDER BY doc_id DESC))"},
]
_BOTH, _ONLY = "list_filter({0}, lambda z: list_contains({1}, z))", "list_filter({0}, lambda z: NOT list_contains({1}, z))"
_OPENED, _SHOWN = "flatten(list_transform({0}, lambda z: string_split(z[10:], '/')))", "flatten(list_transform({0}, lambda z: regexp_extract_all(z, '.{{8}}')))"


def _likeness(other: str, k: str) -> list[dict[str, str]]:
    """Levels that compare the fingerprint with another one: sections, the paragraphs of those that one side lacks, the leaves of those."""
    pairs = [(f"a{k}", f"b{k}"), (f"b{k}", f"a{k}")]
    return [
        {f"a{k}": "list_distinct(string_split(fingerprint[66:], '|'))", f"b{k}": f"list_distinct(string_split({other}[66:], '|'))"},
        {f"n{k}": f"len({_SHOWN.format(_OPENED.format(_BOTH.format(*pairs[0])))})"} | {f"{x}p": f"list_distinct({_OPENED.format(_ONLY.format(x, y))})" for x, y in pairs},
        {f"m{k}": f"len({_SHOWN.format(_BOTH.format(f'a{k}p', f'b{k}p'))})"} | {f"{x}l": f"list_distinct({_SHOWN.format(_ONLY.format(f'{x}p', f'{y}p'))})" for x, y in pairs},
        {f"o{k}": f"len({_BOTH.format(f'a{k}l', f'b{k}l')})"},
        {f"near{k}": f"CASE WHEN fingerprint[1:64] = {other}[1:64] THEN 1.0 ELSE CAST(n{k} + m{k} + o{k} AS DOUBLE) / GREATEST(n{k} + m{k} + len(a{k}l) + len(b{k}l) - o{k}, 1) END"},
    ]


def _stepwise(first: str, levels: list[dict[str, str]]) -> str:
    steps = [f"q0 AS ({first})"]
    steps += [f"q{i} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {n}' for n, e in level.items())} FROM q{i - 1})" for i, level in enumerate(levels, 1)]
    return f"WITH {', '.join(steps)} SELECT {{}} FROM q{len(levels)}"


DOCUMENT_FINGERPRINTS = _stepwise(
    "SELECT CAST(doc_id AS BIGINT) AS doc_id, COALESCE(text, '') AS t FROM documents",
    [
        {"nx": "COALESCE(LEAD(t) OVER (ORDER BY doc_id DESC), FIRST_VALUE(t) OVER (ORDER BY doc_id DESC))", "n_chars": "CAST(length(t) AS BIGINT)"},
        {"edited": "t[1:n_chars - n_chars // 3] || nx[1:n_chars // 3]"},
        *_LEVELS,
        *_likeness("edited_fingerprint", "1"),
        *_likeness("next_print", "2"),
    ],
).replace("SELECT {} FROM", "SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint, CAST(near1 AS DOUBLE) AS near_edited, CAST(near2 AS DOUBLE) AS near_next FROM")

_P, _DIFFER = "1 + (CAST({0} + 2 AS HUGEINT) * 1000000000) // ({1} + 2 * v)", "CAST(({0} - {1}) * ({0} - {1}) // ({0} + {1}) AS BIGINT)"
SOURCE_DIVERGENCE = rf"""WITH d AS (SELECT COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, ROW_NUMBER() OVER () AS r, COALESCE(text, '') AS t FROM documents),
    w AS (SELECT lang, source, r, UNNEST(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, COUNT(*) AS lang_n FROM w GROUP BY 1, 2 HAVING COUNT(DISTINCT r) >= 10),
    l AS (SELECT lang, COUNT(*) AS v, CAST(SUM(lang_n) AS BIGINT) AS lang_total FROM k GROUP BY 1),
    c AS (SELECT lang, source, term, COUNT(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
    g AS (SELECT lang, source, COALESCE(v, 0) AS v, lang_total, CAST(COALESCE(total, 0) AS BIGINT) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, SUM(n) AS total FROM c GROUP BY 1, 2) USING (lang, source) LEFT JOIN l USING (lang)),
    p AS MATERIALIZED (SELECT g.lang, g.source, k.term, COALESCE(n, 0) AS n, CAST({_P.format("COALESCE(n, 0)", "total")} AS HUGEINT) AS p, CAST({_P.format("lang_n", "lang_total")} AS HUGEINT) AS q FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    far AS (SELECT a.lang, a.source, b.source AS item, SUM({_DIFFER.format("a.p", "b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(COALESCE(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
    found AS (SELECT lang, source, 'term' AS part, term AS item, {_DIFFER.format("p", "q")} AS value FROM p WHERE n > 0 AND p > q)
    SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
    UNION ALL SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM found QUALIFY rank <= 10"""

SQL = {"op13_source_divergence": SOURCE_DIVERGENCE, "op3_document_fingerprints": DOCUMENT_FINGERPRINTS, "op4_exact_topk": EXACT_TOPK, "op5_chat_format": CHAT_FORMAT}
