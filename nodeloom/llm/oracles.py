"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from nodeloom.llm.chat import CLOSE, CONTROL, OPEN

ORACLES: dict[str, str] = {}

ORACLES["op2_chat_formatting"] = rf"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, n, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(n, role)
), escaped AS (
    SELECT *,
        replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B') AS shown_role,
        regexp_replace(text, '([<\[])(\\*)({CONTROL})', '\1\\\2\3', 'g') AS shown
    FROM said
), whole AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length(shown_role) + length(shown) + {len(OPEN) + len(CLOSE) + 2}) AS size
    FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
    sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars
FROM whole
"""

ORACLES["op3_quality_rules"] = r"""
WITH cut AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT row, p, [w[p], w[p + 1], w[p + 2]] AS three
    FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS p FROM cut)
), twice AS (
    SELECT row, p, count(*) OVER (PARTITION BY row, three) AS k FROM windows
), repeated AS (
    SELECT row, count(DISTINCT p + o) AS n FROM twice, range(3) AS r(o) WHERE k > 1 GROUP BY row
), measured AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM cut LEFT JOIN repeated USING (row)
), ledger AS (
    SELECT *,
        (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
        + 4 * (100 * n_symbols > 20 * word_chars)::INT + 8 * (word_chars < 2 * n_words)::INT
        + 16 * (word_chars > 20 * n_words)::INT
        + 32 * (n_dup_lines > 2 AND 100 * n_dup_lines > 40 * n_lines)::INT AS failures
    FROM measured
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    failures & 3 <> 0 AS base_failed, failures = 0 AS kept, CAST(failures AS BIGINT) AS failures
FROM ledger
"""

_CUT = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
)

ORACLES["op10_decontamination"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, {_CUT} FROM documents
), items AS (
    SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, {_CUT} FROM benchmark) WHERE len(w) > 0
), asked AS (
    SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS p FROM items)
), held AS (
    SELECT row, p, size, array_to_string(w[p:p + size - 1], ' ') AS phrase
    FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS p FROM docs), (SELECT DISTINCT size FROM asked)
    WHERE p + size - 1 <= len(w)
), met AS (
    SELECT row, p, size, item_id FROM held JOIN asked USING (size, phrase)
), hit AS (
    SELECT row, count(DISTINCT place) AS n_hit
    FROM (SELECT row, unnest(range(p, p + size)) AS place FROM (SELECT DISTINCT row, p, size FROM met)) GROUP BY row
), named AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""

ORACLES["op12_fill_in_middle"] = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
    FROM documents
), drawn AS (
    SELECT *, len(w) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w) + 1) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
            OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
            WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parts AS (
    SELECT *, array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m,
        array_to_string(w[greatest(a, b) + 1:], '') AS s
    FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""

# Base32 of a SHA-1 in hex: five bits at a time out of two neighbouring hex digits.
ORACLES["op13_warc"] = r"""
WITH kept AS (
    SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
        row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS place,
        max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top
    FROM pages
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(h, CAST(5 * i // 4 + 1 AS BIGINT), 2) AS BIGINT) >> CAST(3 - 5 * i % 4 AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN place > 1 THEN top END AS refers_to
FROM kept
"""


def _crc_steps() -> list[int]:
    """What four zero bits add to a CRC-32 that ends in the given four bits, from its polynomial."""
    out = list(range(16))
    for _ in range(4):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


# The checksum goes over four bits at a time, the lower ones of each byte first.
ORACLES["op11_spelling_variants"] = rf"""
WITH RECURSIVE runs AS (
    SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS h FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
            translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM documents
    ) GROUP BY ALL
), summed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_concat([4294967295], list_transform(range(length(h)), lambda k: CAST('0x' || substr(h, CAST(k + 1 - 2 * (k % 2) + 1 AS BIGINT), 1) AS BIGINT))),
        lambda c, b: xor(c >> 4, list_extract({_crc_steps()}, (xor(c, b) & 15) + 1)))) AS crc
    FROM runs
), words AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM summed
    ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS MATERIALIZED (
    SELECT word, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS k FROM words)
), near AS (
    SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, other) AS other, max(w.n) AS other_n
    FROM near JOIN words w ON w.word = near.other GROUP BY near.word
), formed AS MATERIALIZED (
    SELECT words.word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
        CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
    FROM words LEFT JOIN best ON best.word = words.word
), chain AS (
    SELECT word, word AS root FROM formed
    UNION ALL
    SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.root AND e.form IS NULL
"""
