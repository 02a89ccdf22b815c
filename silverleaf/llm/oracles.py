"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(table: str, pattern: str) -> str:
    return rf"""SELECT *, len(w) AS k, row_number() OVER () AS r
        FROM (SELECT *, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{pattern}') AS w FROM {table})"""


ORACLE_SQL = {
    # every 50-byte string in hexadecimal, cut from pieces of 1000 starts so that long texts stay linear
    "op1_suffix_dedup": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
        piece AS (SELECT doc_id, r, c, substr(x, 2000 * c + 1, 2098) AS x FROM (SELECT *, unnest(range(0, length(x) // 2000 + 1)) AS c FROM d)),
        start AS (SELECT doc_id, r, 1000 * c + i AS i, substr(x, 2 * i + 1, 100) AS s
            FROM (SELECT *, unnest(range(0, least(1000, length(x) // 2 - 49))) AS i FROM piece)),
        low AS (SELECT s, min(doc_id) AS low FROM start GROUP BY s HAVING count(*) > 1),
        hit AS (SELECT DISTINCT r, i FROM start JOIN low USING (s) WHERE doc_id > low),
        run AS (SELECT r, min(i) AS lo, max(i) + 50 AS hi FROM (
            SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (
                SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM hit)) GROUP BY r, g),
        gap AS (SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS a, lo AS b FROM run
            UNION ALL SELECT r, max(hi), NULL FROM run GROUP BY r),
        kept AS (SELECT r, string_agg(CASE WHEN b IS NULL THEN substr(x, 2 * a + 1) ELSE substr(x, 2 * a + 1, 2 * (b - a)) END, '' ORDER BY a) AS x
            FROM gap JOIN d USING (r) GROUP BY r),
        removed AS (SELECT r, sum(hi - lo) AS n, count(*) AS spans, string_agg(lo || ':' || hi, ',' ORDER BY lo) AS removed FROM run GROUP BY r)
        SELECT doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
            CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN d.x ELSE coalesce(kept.x, '') END)) AS kept_sha256, coalesce(removed, '') AS removed
        FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)""",
    # the length of the formatted text follows from its template: roles, separators, escapes
    "op2_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS et,
            replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS er FROM t),
        p AS (SELECT *, lag(er) OVER o AS before, lead(er) OVER o AS after FROM e WINDOW o AS (PARTITION BY conv_id ORDER BY turn, er, et)),
        s AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, er, et)) AS turns_sha256,
            coalesce(string_agg(text, '' ORDER BY turn, er, et) FILTER (er = 'assistant'), '') AS loss,
            sum(length(et) + CASE WHEN before = er THEN 7 ELSE length(er) + 2 END + CASE WHEN after = er THEN 0 ELSE 8 END) AS chars
            FROM p GROUP BY conv_id)
        SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
            CAST(chars AS BIGINT) AS formatted_chars
        FROM s""",
    "op6_decontamination": rf"""
        WITH d AS ({_words("documents", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}),
        b AS ({_words("benchmark", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}),
        known AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, k - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
            FROM (SELECT *, least(13, k) AS n FROM b WHERE k > 0)),
        own AS (SELECT r, n, unnest(range(1, k - n + 2)) AS i, unnest(list_transform(range(1, k - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
            FROM d, (SELECT DISTINCT n FROM known) WHERE k >= n),
        hit AS (SELECT r, i, n, item_id FROM own JOIN known USING (n, win)),
        words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
        SELECT doc_id, CAST(k AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= k AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op8_jaccard_join": rf"""
        WITH RECURSIVE d AS ({_words("documents", r"[^\x20\x09-\x0D]+")}),
        s AS (SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, greatest(k - 5, 0) + 2), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM d WHERE k > 0),
        n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
        pair AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.r <> b.r GROUP BY a.r, b.r),
        link AS (SELECT a, b FROM pair JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
        reach AS (SELECT r AS a, r AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
        least AS (SELECT reach.a AS r, min(n.doc_id) AS low FROM reach JOIN n ON n.r = reach.b GROUP BY reach.a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least.low, d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r)""",
    # subtree sums: every node adds to all prefixes of its smallest member
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(dig, 1, 32)) AS pos, dig, chars
            FROM (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS dig, length(coalesce(text, '')) AS chars
                FROM conversations WHERE conv_id IS NOT NULL)),
        crc AS (SELECT CAST(n AS UBIGINT) AS n, 0 AS round FROM range(0, 256) AS x(n)),
        r1 AS (SELECT n AS i, CASE WHEN n % 2 = 1 THEN xor(n // 2, 3988292384::UBIGINT) ELSE n // 2 END AS n FROM crc),
        r2 AS (SELECT i, CASE WHEN n % 2 = 1 THEN xor(n // 2, 3988292384::UBIGINT) ELSE n // 2 END AS n FROM r1),
        r3 AS (SELECT i, CASE WHEN n % 2 = 1 THEN xor(n // 2, 3988292384::UBIGINT) ELSE n // 2 END AS n FROM r2),
        r4 AS (SELECT i, CASE WHEN n % 2 = 1 THEN xor(n // 2, 3988292384::UBIGINT) ELSE n // 2 END AS n FROM r3),
        r5 AS (SELECT i, CASE WHEN n % 2 = 1 THEN xor(n // 2, 3988292384::UBIGINT) ELSE n // 2 END AS n FROM r4),
        r6 AS (SELECT i, CASE WHEN n % 2 = 1 THEN xor(n // 2, 3988292384::UBIGINT) ELSE n // 2 END AS n FROM r5),
        r7 AS (SELECT i, CASE WHEN n % 2 = 1 THEN xor(n // 2, 3988292384::UBIGINT) ELSE n // 2 END AS n FROM r6),
        r8 AS (SELECT i, CASE WHEN n % 2 = 1 THEN xor(n // 2, 3988292384::UBIGINT) ELSE n // 2 END AS n FROM r7),
        lookup AS (SELECT list(n ORDER BY i) AS l FROM r8),
        c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT))),
            lambda a, b: xor(l[CAST(xor(a, b) % 256 AS INT) + 1], a // 256)), 4294967295::UBIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), lookup),
        rebuilt AS (SELECT c.conv_id, t.pos, dig, chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= h
            UNION ALL SELECT c.conv_id, t.pos, dig, chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
        turn AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, chars,
            sha256(string_agg(dig, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS k FROM rebuilt),
        size AS (SELECT c.conv_id, coalesce(max(depth), 0) AS size FROM c LEFT JOIN turn USING (conv_id) GROUP BY c.conv_id),
        step AS (SELECT conv_id, depth, chars, k, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM turn UNION ALL SELECT conv_id, 0, 0, '', NULL FROM size),
        node AS (SELECT k, depth, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n,
            sha256(coalesce(string_agg(CASE WHEN size = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends
            FROM step JOIN size USING (conv_id) GROUP BY k, depth),
        kids AS (SELECT up AS k, count(*) AS kids FROM node WHERE up IS NOT NULL GROUP BY up),
        below AS (SELECT s.k, sum((n.n - 1) * n.chars) AS saved, count(*) FILTER (kids.kids IS NULL) AS leaves
            FROM node n JOIN step s ON s.conv_id = n.conv_id AND s.depth <= n.depth LEFT JOIN kids ON kids.k = n.k GROUP BY s.k)
        SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs, CAST(coalesce(kids, 0) AS BIGINT) AS n_children,
            CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
        FROM node LEFT JOIN node parent ON parent.k = node.up LEFT JOIN kids ON kids.k = node.k JOIN below ON below.k = node.k""",
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w,
            sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
        h AS (SELECT *, len(w) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
        p AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
        s AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM p)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
        FROM s""",
}
