"""SQL for DuckDB that gives the rows of the queries which SQL can express, written without looking at the operators' ways."""

from __future__ import annotations

OP1 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
rk AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM src),
wt AS (SELECT *, CASE s % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, 3 * source_size AS cap FROM rk),
al AS (SELECT sum(source_size)::BIGINT AS words, sum(w)::BIGINT AS weights FROM wt),
fl AS (SELECT wt.*, words, weights, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before FROM wt, al WINDOW o AS (ORDER BY cap * 10 / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT *, cap * (weights - w_before) <= w * (words - cap_before) AS stops FROM fl),
lf AS (SELECT words - sum(CASE WHEN stops THEN cap ELSE 0 END) AS words_left, weights - sum(CASE WHEN stops THEN w ELSE 0 END) AS weight_left FROM st GROUP BY words, weights),
tg AS (SELECT s, source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE (w * words_left)::DOUBLE / weight_left::DOUBLE END AS target FROM st, lf),
pl AS (SELECT d.doc_id, d.size, tg.*, round(target)::BIGINT AS t, sum(size) OVER (PARTITION BY tg.s ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE t // source_size * size + greatest(least(start + size, t % source_size) - start, 0) END::BIGINT AS taken FROM pl
"""

OP2 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""

OP5 = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
ln AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM raw),
w AS (SELECT doc_id, place, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t, len(regexp_extract_all(line, '\S+')) AS words FROM ln),
nb AS (SELECT doc_id, place, t, words, row_number() OVER o AS p, sum(words) OVER o AS upto FROM w WHERE words > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
pr AS (SELECT a.doc_id, a.p, b.p AS e FROM nb a JOIN nb b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.upto - a.upto + a.words >= 50),
en AS (SELECT doc_id, p, min(e) AS e FROM pr GROUP BY doc_id, p UNION SELECT doc_id, max(p), e FROM pr GROUP BY doc_id, e),
rn AS (SELECT en.doc_id, en.p, en.e, string_agg(t, chr(10) ORDER BY nb.p) AS run FROM en JOIN nb ON nb.doc_id = en.doc_id AND nb.p BETWEEN en.p AND en.e GROUP BY ALL),
fs AS (SELECT run, min(doc_id) AS d0 FROM rn GROUP BY run), ft AS (SELECT run, d0, min(p) AS p0, min(e) AS e0 FROM rn JOIN fs USING (run) WHERE doc_id = d0 GROUP BY ALL),
lt AS (SELECT doc_id, p, e FROM rn JOIN ft USING (run) WHERE doc_id <> d0 OR p > e0),
gone AS (SELECT DISTINCT nb.doc_id, nb.place FROM lt JOIN nb ON nb.doc_id = lt.doc_id AND nb.p BETWEEN lt.p AND lt.e),
cn AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id), al AS (SELECT doc_id, count(*) AS n FROM nb GROUP BY doc_id),
kept AS (SELECT w.doc_id, string_agg(w.line, chr(10) ORDER BY w.place) AS text FROM w LEFT JOIN gone USING (doc_id, place) WHERE gone.place IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CASE WHEN n_removed = al.n THEN '' WHEN n_removed IS NULL THEN d.text ELSE kept.text END AS text, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN cn USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

WORDS6 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6 = f"""
WITH d AS (SELECT doc_id, {WORDS6} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS6} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM b, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= greatest(1, len(w) - 12)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
gr AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM pos, sizes WHERE i + n - 1 <= len(w)),
oc AS (SELECT doc_id, i, win.n, item FROM gr JOIN win ON gr.g = win.g AND gr.n = win.n),
ht AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM oc, range(13) r(k) WHERE k < n GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM oc) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN ht USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g FROM d, range(1, 1000000) r(i) WHERE len(w) > 0 AND i <= greatest(1, len(w) - 4)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 10 * c >= 8 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
co AS (SELECT a, min(b) AS m FROM reach GROUP BY a), cl AS (SELECT a, count(*) AS links, min(CASE WHEN same THEN b END) AS twin FROM l GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS class_id, coalesce(links, 0)::BIGINT AS n_links, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM d LEFT JOIN co ON co.a = doc_id LEFT JOIN cl ON cl.a = doc_id
"""

OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
co AS (SELECT a, min(b) AS m FROM reach GROUP BY a), cn AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept FROM v LEFT JOIN co ON co.a = vec_id LEFT JOIN cn ON cn.a = vec_id
"""

def crc32_sql(x: str) -> str:
    """The unsigned CRC-32 of a short ASCII text: a byte is added and shifted out in eight steps."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length({x}) + 1), lambda i: [ord(({x})[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) // 2, (xor(c, b) % 2) * 3988292384)), 4294967295)"


def _leaf_sql(text: str) -> str:
    parts = [f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f}::VARCHAR END" for f in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


OP11 = f"""
WITH RECURSIVE h AS (SELECT doc_id, coalesce('+' || source, '') AS g, {_leaf_sql('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS rid FROM h),
up(g, level, i, d, n) AS (SELECT g, 0, i, leaf, n FROM l UNION ALL SELECT g, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY g, level, i // 3),
s AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, i, d, n) AS (SELECT 0, i, subroot, n FROM s UNION ALL SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY level, i // 3),
ur AS (SELECT g, level, i // 3 AS run, list(d ORDER BY i) AS ds FROM up WHERE n > 1 GROUP BY ALL), tr AS (SELECT level, i // 3 AS run, list(d ORDER BY i) AS ds FROM top WHERE n > 1 GROUP BY ALL),
f(rid, g, level, i, d, sibs) AS (SELECT rid, g, 0, i, coalesce(changed, leaf), '' FROM l
  UNION ALL SELECT rid, f.g, f.level + 1, i // 3, sha256(array_to_string(ds[1 : i % 3] || [d] || ds[i % 3 + 2 :], '')), sibs || array_to_string(ds[1 : i % 3] || ds[i % 3 + 2 :], '') FROM f JOIN ur ON ur.g = f.g AND ur.level = f.level AND ur.run = f.i // 3),
e AS (SELECT rid, g, d, sibs FROM f QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level DESC) = 1),
t(rid, level, i, d, sibs) AS (SELECT rid, 0, s.i, d, sibs FROM e JOIN s USING (g)
  UNION ALL SELECT rid, t.level + 1, i // 3, sha256(array_to_string(ds[1 : i % 3] || [d] || ds[i % 3 + 2 :], '')), sibs || array_to_string(ds[1 : i % 3] || ds[i % 3 + 2 :], '') FROM t JOIN tr ON tr.level = t.level AND tr.run = t.i // 3),
z AS (SELECT rid, d AS folded_root, sha256(sibs) AS proof_sha256 FROM t QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, r.d AS root, proof_sha256, folded_root, folded_root = r.d AS verified FROM l JOIN z USING (rid) JOIN s USING (g), (SELECT d FROM top WHERE n = 1) r
"""

def _step(state: str, letter: str, role: str, cost: str, line: str = "NULL") -> str:
    """A path of SQL's op13 with one edit more: (cost, audit, lines); null where there is none."""
    joined = f"{state}.r" if line == "NULL" else f"list_append({state}.r, {line})"
    return f"CASE WHEN {state} IS NOT NULL AND {role} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {joined}}} END"


def _closed(names: str) -> dict[str, str]:
    """Each state's paths after one insertion at most, of states named like ``names``."""
    q = [f"{names}{k}" for k in range(4)]
    user = [_step(q[k], "I", "true", "5", "'user:'") for k in (0, 1, 3)]
    return {"0": q[0], "1": q[1], "2": f"list_min([{', '.join([q[2], *user])}])", "3": f"list_min([{q[3]}, {_step(q[2], 'I', 'true', '5', chr(39) + 'assistant:' + chr(39))}])"}


def _after_row(names: str) -> dict[str, str]:
    """Each state's paths after the row (initial i, whether it must go, cost of keeping it x, its line and text)."""
    q, may = [f"{names}{k}" for k in range(4)], "NOT must"
    into = {0: {}, 1: {"s": (0,)}, 2: {"u": (0, 1, 3)}, 3: {"a": (2,)}}
    out = {}
    for k in range(4):
        ways = [_step(q[k], "D", "true", "2")]
        for role, froms in into[k].items():
            for f in froms:
                ways.append(_step(q[f], "K", f"{may} AND i = '{role}'", "x", "line"))
                if role != "s":
                    name = {"u": "user", "a": "assistant"}[role]
                    ways.append(_step(q[f], "R", may, "1 + x", f"'{name}:' || text"))
        out[str(k)] = f"list_min([{', '.join(ways)}])"
    return out


def _select(states: dict[str, str], into: str) -> str:
    return ", ".join(f"{v} AS {into}{k}" for k, v in states.items())


_PATH = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])"
OP13 = rf"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM given WHERE kind <> 0),
n AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM b),
d AS (SELECT g, turn, k, role || ':' || text AS line, text, left(role, 1) AS i, cut = '' AS blank, cut <> '' AND nth > 1 AS dup, cut <> '' AND nth = 1 AND right(cut, 1) NOT IN ('.', '!', '?') AS trunc FROM n),
rows_ AS (SELECT *, blank OR dup AS must, CASE WHEN trunc THEN 5 ELSE 0 END AS x, lag(i) OVER (PARTITION BY g ORDER BY k) || i AS pair FROM d),
st AS (SELECT g, count(*) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated, count(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY g),
p(g, k, q0, q1, q2, q3) AS (SELECT g, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}}::{_PATH}, NULL::{_PATH}, NULL::{_PATH}, NULL::{_PATH} FROM st
  UNION ALL SELECT p2.g, p2.k + 1, {", ".join(f"({v})::{_PATH}" for v in _after_row("z").values())} FROM (SELECT g, k, {_select(_closed("y"), "z")} FROM (SELECT g, k, {_select(_closed("q"), "y")} FROM p)) p2 JOIN rows_ ON rows_.g = p2.g AND rows_.k = p2.k + 1),
e AS (SELECT g, list_min([z0, z3]) AS best FROM (SELECT g, {_select(_closed("y"), "z")} FROM (SELECT p.g, {_select(_closed("q"), "y")} FROM p JOIN st ON st.g = p.g AND st.m = p.k))),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN st ON st.g = coalesce(c.conv_id::VARCHAR, ' ') LEFT JOIN e ON e.g = coalesce(c.conv_id::VARCHAR, ' ')
"""

SQL = {"op1_mix_sources": OP1, "op2_warc": OP2, "op5_line_dedup": OP5, "op6_decontaminate": OP6, "op7_ngram_jaccard": OP7, "op8_embedding_near": OP8, "op11_merkle_manifest": OP11, "op13_conversations": OP13}
