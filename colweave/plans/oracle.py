"""DuckDB statements that compute the catalogue's queries independently, from the same tables.

Each statement is put together from named common table expressions; ``sql`` adds those that a
final SELECT mentions, directly or through others, in order.
"""

from __future__ import annotations

import re

PIECES = {
    "seqs": "SELECT unnest(range(8)) AS j",
    "cells": """SELECT CAST(j AS INT) AS seq_id, CAST(p_partkey AS INT) AS col,
       CASE WHEN (p_partkey + 5*j) % 29 = 0 THEN '-'
            WHEN (p_partkey*(2*j+3) + p_size*(j+1)) % 23 = 0 THEN substr('CGTA', CAST(1 + (p_size*7 + p_partkey*17) % 4 AS INT), 1)
            ELSE substr('ACGT', CAST(1 + (p_size*7 + p_partkey*17) % 4 AS INT), 1) END AS ch
FROM part CROSS JOIN seqs""",
    "cells2": "SELECT seq_id, col, CASE WHEN (col + 3*seq_id) % 101 = 0 THEN '-' ELSE ch END AS ch FROM cells",
    "ranked": "SELECT seq_id, col, ch, CAST(coalesce(sum(CASE WHEN ch <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS nb FROM cells",
    "ranked2": "SELECT seq_id, col, ch, CAST(coalesce(sum(CASE WHEN ch <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS nb FROM cells2",
    "msa": "SELECT seq_id, string_agg(ch, '' ORDER BY col) AS seq FROM cells GROUP BY seq_id",
    "ungapped": "SELECT seq_id, replace(seq, '-', '') AS s FROM msa",
    "whole": "SELECT c.seq_id, c.nb, substr(u.s, c.nb + 1, length(u.s)) AS suf FROM ranked c JOIN ungapped u USING (seq_id) WHERE c.ch <> '-'",
    "steps_": "SELECT suf, lag(suf) OVER (ORDER BY suf) AS p FROM whole",
    "shared": "SELECT max(CAST((SELECT count(*) FROM (SELECT unnest(range(1, least(length(suf), length(p)) // 32 + 1)) AS k) z WHERE substr(suf, 1, 32 * CAST(k AS BIGINT)) = substr(p, 1, 32 * CAST(k AS BIGINT))) AS BIGINT)) AS n FROM steps_",
    "longest": "SELECT 32 * coalesce(n, 0) + 33 AS n FROM shared",
    "wins": "SELECT seq_id, nb, substr(suf, 1, (SELECT n FROM longest)) AS win FROM whole",
    "lens": "SELECT CAST(unnest(range(1, (SELECT n + 1 FROM longest))) AS INT) AS l",
    "mem": "SELECT c.col, c.seq_id, c.nb, w.win FROM ranked c JOIN wins w USING (seq_id, nb)",
    "tx": "SELECT l, substr(win, 1, l) AS k, count(*) AS n FROM wins, lens WHERE length(win) >= l GROUP BY ALL",
    "mk": "SELECT col, seq_id, nb, l, substr(win, 1, l) AS k FROM mem, lens WHERE length(win) >= l",
    "mc": "SELECT col, l, k, count(*) AS n FROM mk GROUP BY ALL",
    "good": "SELECT mc.col, mc.l, mc.k FROM mc JOIN tx ON tx.l = mc.l AND tx.k = mc.k AND tx.n = mc.n",
    "dd": "SELECT mk.col, mk.seq_id, mk.nb, CAST(min(mk.l) AS INT) AS d FROM mk JOIN good USING (col, l, k) GROUP BY ALL",
    "reach": "SELECT dd.col AS lb, max(r.col) AS rb, count(*) AS n FROM dd JOIN ranked r ON r.seq_id = dd.seq_id AND r.nb = dd.nb + dd.d - 1 AND r.ch <> '-' GROUP BY dd.col",
    "raw": "SELECT CAST(c.col AS BIGINT) AS lb, CAST(q.rb AS BIGINT) AS rb FROM (SELECT DISTINCT col FROM cells) c LEFT JOIN (SELECT * FROM reach WHERE n = 8) q ON q.lb = c.col",
    "ivs": "SELECT lb, rb + 1 AS rb FROM raw WHERE rb IS NOT NULL",
    "nxt": "SELECT x.lb, (SELECT y.lb FROM ivs y WHERE y.lb >= x.rb ORDER BY y.rb, y.lb DESC LIMIT 1) AS nb FROM ivs x",
    "chain": "SELECT CAST(0 AS BIGINT) AS a UNION ALL SELECT nxt.nb FROM chain JOIN nxt ON nxt.lb = chain.a WHERE nxt.nb IS NOT NULL",
    "least": "SELECT (SELECT max(lb) + 1 FROM raw) AS a, [CAST(0 AS BIGINT)] AS best UNION ALL SELECT p.a - 1, list_prepend(CASE WHEN r.rb IS NULL THEN 1099511627776 ELSE list_min([greatest(y - p.a + 1, p.best[y - p.a + 1]) FOR y IN range(r.rb + 1, (SELECT max(lb) + 2 FROM raw))]) END, p.best) FROM least p JOIN raw r ON r.lb = p.a - 1",
    "shortchain": "SELECT CAST(0 AS BIGINT) AS a UNION ALL SELECT list_min([y FOR y IN range(r.rb + 1, (SELECT max(lb) + 2 FROM raw)) IF f.best[y + 1] <= f.best[1]]) FROM shortchain c JOIN raw r ON r.lb = c.a JOIN (SELECT best FROM least WHERE a = 0) f ON true",
    "seg": "SELECT CAST(row_number() OVER (ORDER BY a) - 1 AS INT) AS block_idx, a AS lb, coalesce(lead(a) OVER (ORDER BY a), (SELECT max(lb) + 1 FROM raw)) AS rb FROM chain",
    "brows": "SELECT g.block_idx, c.seq_id, coalesce(string_agg(CASE WHEN c.ch = '-' THEN '' ELSE c.ch END, '' ORDER BY c.col), '') AS label FROM cells c JOIN seg g ON c.col >= g.lb AND c.col < g.rb GROUP BY ALL",
    "labels_": "SELECT DISTINCT block_idx, label FROM brows",
    "nodes": "SELECT block_idx, CAST(row_number() OVER (PARTITION BY block_idx ORDER BY label) - 1 AS INT) AS node_rank, CAST(row_number() OVER (ORDER BY block_idx, label) - 1 AS BIGINT) AS node_idx, label, CAST(length(label) AS INT) AS label_len, NOT EXISTS (SELECT 1 FROM labels_ o WHERE o.block_idx = n.block_idx AND o.label <> n.label AND starts_with(n.label, o.label)) AS is_shortest_prefix FROM labels_ n",
    "paths": "SELECT n.node_idx, b.seq_id FROM brows b JOIN nodes n USING (block_idx, label)",
    "own": "SELECT b.seq_id, n.* FROM brows b JOIN nodes n USING (block_idx, label)",
    "edges": "SELECT DISTINCT r.block_idx, l.node_rank AS lhs, r.node_rank AS rhs, l.node_idx AS lhs_idx, r.node_idx AS rhs_idx, r.node_idx - l.node_idx AS rho_diff, l.label AS lhs_label, r.label AS rhs_label FROM own l JOIN own r ON r.seq_id = l.seq_id AND r.block_idx = l.block_idx + 1",
    "heights": "SELECT block_idx, count(*) AS height, sum(label_len) AS len FROM nodes GROUP BY block_idx",
    "blocks": "SELECT h.block_idx, g.lb AS aligned_position, CAST(height AS INT) AS height, CAST(sum(height) OVER (ORDER BY h.block_idx) - height AS BIGINT) AS node_csum, CAST(sum(len) OVER (ORDER BY h.block_idx) - len AS BIGINT) AS node_label_length_csum FROM heights h JOIN seg g ON g.block_idx = h.block_idx",
    "parts": "SELECT 'Segment' AS kind, block_idx, node_rank AS lhs, CAST(NULL AS INT) AS rhs, label_len AS lhs_size, CAST(NULL AS INT) AS rhs_size, label || '#' AS text FROM nodes WHERE block_idx = 0 UNION ALL SELECT 'Edge', block_idx, lhs, rhs, CAST(length(lhs_label) AS INT), CAST(length(rhs_label) AS INT), lhs_label || rhs_label || '#' FROM edges",
    "offs": "SELECT *, CAST(1 + coalesce(sum(length(text)) OVER (ORDER BY block_idx, coalesce(rhs, -1), lhs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM parts",
    "itext": "SELECT '#' || string_agg(text, '' ORDER BY off) AS s FROM offs",
    "names": "SELECT CAST(p_partkey AS BIGINT) AS text_id, p_name AS s FROM part WHERE p_name IS NOT NULL",
    "sufs": "SELECT text_id, CAST(pos AS INT) AS pos, substr(s, CAST(pos AS BIGINT) + 1, length(s)) AS suf, CASE WHEN pos = 0 THEN '$' ELSE substr(s, CAST(pos AS BIGINT), 1) END AS prev_char FROM (SELECT text_id, s, unnest(range(length(s))) AS pos FROM names)",
    "sa": "SELECT CAST(row_number() OVER (ORDER BY suf, text_id, pos) - 1 AS BIGINT) AS idx, text_id, pos, suf, prev_char FROM sufs",
    "sal": "SELECT idx, suf, CAST(CASE WHEN p IS NULL THEN 0 ELSE (SELECT count(*) FROM (SELECT unnest(range(1, least(length(suf), length(p)) + 1)) AS k) z WHERE substr(suf, 1, CAST(k AS BIGINT)) = substr(p, 1, CAST(k AS BIGINT))) END AS INT) AS lcp FROM (SELECT idx, suf, lag(suf) OVER (ORDER BY idx) AS p FROM sa)",
    "tpre": "SELECT DISTINCT lcp AS depth, substr(suf, 1, lcp) AS pre FROM sal WHERE idx > 0",
    "tnode": "SELECT depth, pre, min(idx) AS lb, max(idx) AS rb FROM tpre JOIN (SELECT idx, suf, unnest(range(length(suf) + 1)) AS d FROM sal) x ON x.d = depth AND substr(x.suf, 1, CAST(x.d AS BIGINT)) = pre GROUP BY ALL",
    "tup": "SELECT n.lb, n.rb, n.depth, max_by(p.lb, p.depth) AS parent_lb, max_by(p.rb, p.depth) AS parent_rb, CAST(max(p.depth) AS INT) AS parent_depth FROM tnode n LEFT JOIN tnode p ON p.depth < n.depth AND starts_with(n.pre, p.pre) GROUP BY ALL",
    "rnames": "SELECT text_id, reverse(s) AS s FROM names",
    "rsa": "SELECT CAST(row_number() OVER (ORDER BY suf, text_id, pos) - 1 AS BIGINT) AS idx, suf FROM (SELECT text_id, pos, substr(s, CAST(pos AS BIGINT) + 1, length(s)) AS suf FROM (SELECT text_id, s, unnest(range(length(s))) AS pos FROM rnames))",
    "kmers_": "SELECT DISTINCT pattern FROM (SELECT substr(s, 1, 3) AS pattern FROM names UNION ALL SELECT substr(s, 2, 4) FROM names) WHERE pattern <> ''",
    "shortest": "SELECT row_number() OVER (ORDER BY label, block_idx) - 1 AS pos, label_len, block_idx FROM nodes WHERE is_shortest_prefix",
    "ealpha": "SELECT *, row_number() OVER (ORDER BY lhs_label || rhs_label || '#', block_idx, lhs, rhs) - 1 AS alpha, row_number() OVER (ORDER BY reverse(lhs_label || rhs_label), block_idx, lhs, rhs) - 1 AS alpha_tilde FROM edges",
    "pats": "SELECT DISTINCT substr(s, p, l) AS pattern FROM (SELECT substr(replace(string_agg(ch, '' ORDER BY col), '-', ''), 1, 400) AS s FROM cells WHERE seq_id = 0) q, (SELECT unnest(range(1, 180, 23)) AS p) a, (SELECT unnest([3, 6, 9, 14, 30]) AS l) b UNION SELECT 'ACGTTGCAACGT' UNION SELECT 'GG'",
    "ptails": "SELECT pattern, substr(pattern, i, length(pattern)) AS q FROM (SELECT pattern, unnest(range(1, length(pattern) + 1)) AS i FROM pats)",
    "spots": "SELECT substr(text, p, length(text)) AS rest FROM (SELECT text, unnest(range(1, length(text) + 1)) AS p FROM parts)",
    "plen": "SELECT DISTINCT length(q) AS len FROM ptails",
    "phits": "SELECT substr(rest, 1, len) AS q, rest FROM spots JOIN plen ON length(rest) >= len WHERE substr(rest, 1, len) IN (SELECT q FROM ptails)",
    "ptot": "SELECT q, count(*) AS n FROM phits GROUP BY q",
    "plab": "SELECT q, node_idx, count(*) AS n FROM phits JOIN (SELECT label, node_idx FROM nodes WHERE is_shortest_prefix AND label <> '') v ON starts_with(rest, label) GROUP BY ALL",
    "pgood": "SELECT DISTINCT q FROM plab JOIN ptot USING (q, n)",
    "pexp": "SELECT pattern, pattern IN (SELECT t.pattern FROM ptails t JOIN pgood USING (q)) AS did_expand FROM pats",
    "pocc": "SELECT e.pattern, u.seq_id, CAST(pos AS INT) AS pos FROM pexp e, (SELECT seq_id, s, unnest(range(length(s))) AS pos FROM ungapped) u WHERE e.did_expand AND substr(s, pos + 1, length(e.pattern)) = e.pattern",
    "pfirst": "SELECT o.pattern, CAST(min(r.col) AS BIGINT) AS col, string_agg(DISTINCT CAST(o.seq_id AS VARCHAR), ',' ORDER BY CAST(o.seq_id AS VARCHAR)) AS matches, count(DISTINCT o.seq_id) AS n FROM pocc o JOIN ranked r ON r.seq_id = o.seq_id AND r.nb = o.pos AND r.ch <> '-' GROUP BY o.pattern",
    "praw": "SELECT e.pattern, count(*) AS n FROM pexp e, parts p, (SELECT unnest(range(0, 400)) AS i) z WHERE NOT e.did_expand AND i < length(text) AND substr(text, i + 1, length(e.pattern)) = e.pattern GROUP BY e.pattern",
    "found_": "SELECT e.pattern, e.did_expand, CAST(coalesce(f.n, w.n, 0) AS BIGINT) AS match_count, coalesce(g.lb, 0) AS block_aln_pos, coalesce(f.col - g.lb, 0) AS match_offset, coalesce(f.matches, '') AS matches FROM pexp e LEFT JOIN pfirst f USING (pattern) LEFT JOIN seg g ON f.col >= g.lb AND f.col < g.rb LEFT JOIN praw w ON w.pattern = e.pattern",
    "evr": "SELECT user_id AS key, lb, lb + 1 + event_id % 7 AS rb FROM (SELECT user_id, event_id, event_id % 19 AS lb FROM events)",
    "evt": "SELECT user_id AS key, 'the quick brown fox ' || CAST(user_id AS VARCHAR) AS s FROM (SELECT DISTINCT user_id FROM events)",
}
_MATERIALIZED = {"sal", "tpre", "tnode", "whole", "longest", "sa", "least", "ranked", "wins", "mem", "mk", "mc", "tx", "raw", "ivs", "nxt", "brows", "labels_", "nodes", "own", "edges", "parts", "sufs", "spots", "phits", "seg"}


def sql(final: str) -> str:
    needed: list[str] = []

    def add(text: str) -> None:
        for name in PIECES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                if PIECES[name] is not text:
                    rest = PIECES[name]
                    needed.append(name)
                    add(rest)

    add(final)
    order = [n for n in PIECES if n in needed]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in _MATERIALIZED else ''}({PIECES[n]})" for n in order) + "\n" + final
