"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_NORMAL = f"trim(regexp_replace(regexp_replace({_LOWER.format('l')}, '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"

_ANSWERS = {
    "op2_quality_rules": f"""
        WITH d AS (
            SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents
        ), r AS (
            SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8
        ), g AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM r
        ), repeated AS (
            SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS spot FROM g WHERE n > 1) GROUP BY doc_id
        ), raw AS (
            SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d
        ), dup AS (
            SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM raw WHERE len(regexp_extract_all(l, '{_SPACED}')) > 0 GROUP BY doc_id
        ), held AS (
            SELECT doc_id, source, {_NORMAL} AS line, sum(len(regexp_extract_all(l, '{_SPACED}'))) AS words FROM raw GROUP BY ALL
        ), common AS (
            SELECT source, line FROM held WHERE line <> '' GROUP BY source, line HAVING count(*) > 20
        ), gone AS (
            SELECT doc_id, sum(words)::BIGINT AS n FROM held JOIN common USING (source, line) GROUP BY doc_id
        ), b AS (
            SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
            FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN gone USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * removed_words <= 50 * n_words AS kept, removed_words
        FROM b
    """,
    "op6_line_dedup": f"""
        WITH raw AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL
        ), flat AS (
            SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM raw
        ), worded AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, len(regexp_extract_all(line, '{_SPACED}')) AS words
            FROM flat WHERE len(regexp_extract_all(line, '{_SPACED}')) > 0
        ), docs AS (
            SELECT doc_id, list(md5(line) ORDER BY i) AS ids, list(words ORDER BY i) AS words FROM worded GROUP BY doc_id
        ), starts AS (
            SELECT doc_id, ids, words, unnest(range(1, len(ids) + 1)) AS a FROM docs
        ), runs AS (
            SELECT doc_id, ids, words, a, unnest(range(a, len(ids) + 1)) AS b FROM starts
        ), named AS (
            SELECT doc_id, a, b, md5(array_to_string(ids[a:b], '')) AS run FROM runs WHERE list_sum(words[a:b]) >= 50
        ), ordered AS (
            SELECT doc_id, a, b, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS turn FROM named
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM ordered WHERE turn > 1
        ), dropped AS (
            SELECT worded.doc_id, worded.p FROM worded JOIN gone USING (doc_id, i)
        ), rest AS (
            SELECT flat.doc_id, string_agg(line, chr(10) ORDER BY flat.p) AS t
            FROM flat ANTI JOIN dropped ON flat.doc_id = dropped.doc_id AND flat.p = dropped.p GROUP BY flat.doc_id
        ), n_lines AS (
            SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id
        ), n_gone AS (
            SELECT doc_id, count(*) AS n FROM dropped GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_lines.n, 0) AS n_lines, coalesce(n_gone.n, 0) AS n_deleted,
            CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(rest.t, '')) END AS text_sha256
        FROM documents AS d LEFT JOIN n_lines USING (doc_id) LEFT JOIN n_gone USING (doc_id) LEFT JOIN rest USING (doc_id)
    """,
    "op7_ngram_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT p.a, p.b FROM pairs AS p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b
            WHERE 100 * i >= 80 * (x.n + y.n - i)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
        FROM documents AS d LEFT JOIN n USING (doc_id)
        JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) AS c USING (doc_id)
    """,
    "op10_decontamination": f"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LETTERS}') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LETTERS}') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size,
                unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
            FROM b WHERE len(w) > 0
        ), places AS (
            SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
        ), grams AS (
            SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM places
        ), found AS (
            SELECT doc_id, i, size, item_id FROM grams JOIN windows USING (size, g)
        ), hit AS (
            SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM found) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(_ANSWERS)
