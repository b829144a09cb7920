"""DuckDB SQL for the operators that SQL can express.

The others have none: contexts are scored in rounds (2), boundaries come from
rolling hashes (4), trees are fitted (5), licenses and near duplicates are found
by MinHash and grouped transitively (6, 8), strings start at every byte (7),
pages are parsed (9), blocks scheduled one after the other (10) and texts encoded
by a tokenizer (13). tests/llm compares them with plain versions.
"""

#: Ten consecutive words of an item, or all of a shorter one, against the words of every document.
WINDOWS = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pattern AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS body
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
place AS (
    SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS body
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM pattern) WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, m, i FROM place JOIN pattern USING (m, body)),
word AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM hit) GROUP BY doc_id),
owner AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(owner.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(owner.ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN owner USING (doc_id)
"""

COPIES = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

#: Nodes are the distinct beginnings of rebuilt conversations; CRC-32 bit by bit, over the digits of the id.
TRIE = """
WITH turn AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(octet_length(encode(coalesce(role, ''))), '|', coalesce(role, ''), '|', coalesce(text, '')))) - 1 AS i,
           struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY i) AS xs FROM turn GROUP BY conv_id),
crc AS (SELECT conv_id, xs, conv_id - conv_id % 5 AS head,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 9 AS h FROM own),
built AS (SELECT c.conv_id, list_concat(coalesce(p.xs, [])[1:c.h], c.xs[c.h + 1:]) AS xs FROM crc c LEFT JOIN own p ON p.conv_id = c.head),
member AS (SELECT conv_id, len(xs) AS n, d AS depth, xs[1:d] AS k FROM built, range(0, (SELECT max(len(xs)) FROM built) + 1) r(d) WHERE d <= len(xs)),
node AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends,
                CASE WHEN depth > 0 THEN (count(*) - 1) * octet_length(encode(k[depth].t)) ELSE 0 END AS saved FROM member GROUP BY k, depth),
kids AS (SELECT k[1:depth - 1] AS k, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
marked AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (k, depth)),
above AS (SELECT m.k[1:a] AS k, a AS depth, m.saved, m.n_children FROM marked m, range(0, (SELECT max(depth) FROM node) + 1) r(a) WHERE a <= m.depth),
under AS (SELECT k, depth, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY k, depth)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
       CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM marked m JOIN under u ON u.k = m.k AND u.depth = m.depth LEFT JOIN node p ON m.depth > 0 AND p.depth = m.depth - 1 AND p.k = m.k[1:m.depth - 1]
"""


def codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and floored means, over rows (vec_id, part, place, component)."""
    nearest = """SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT x.vec_id, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM piece x JOIN book{0} b USING (part)) GROUP BY vec_id, part"""
    steps = "".join(f""",
near{k} AS MATERIALIZED ({nearest.format(k)}),
mean{k} AS (SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY j) AS v FROM (
    SELECT part, entry, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM near{k} JOIN piece USING (vec_id, part)) GROUP BY ALL) GROUP BY part, entry),
book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))""" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
piece AS MATERIALIZED (SELECT vec_id, p AS part, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) r(p)),
book0 AS MATERIALIZED (SELECT part, entry, v FROM piece JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < {entries}){steps},
last AS MATERIALIZED ({nearest.format(rounds)}),
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""


ORACLES = {"op1_decontamination": WINDOWS, "op3_exact_dedup": COPIES, "op11_vector_codes": codes(), "op12_conversation_trie": TRIE}
