"""DuckDB SQL for the queries that SQL can express, over the same whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
first AS (SELECT k, min(doc_id) AS m FROM h GROUP BY k),
lost AS (SELECT h.doc_id, h.i FROM h JOIN first USING (k) WHERE m < h.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM lost),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT words.doc_id, string_agg(CASE WHEN gone.j IS NULL THEN word END, ' ' ORDER BY words.j) AS t, count(gone.j) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j GROUP BY words.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Bytes as two hexadecimal digits each.
OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d WHERE len(x) >= 800),
h AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 800)) AS k FROM p),
twice AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
s AS (SELECT doc_id, i FROM h SEMI JOIN twice USING (k)),
g AS (SELECT doc_id, i, CASE WHEN i <= max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 400 THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM r GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT d.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS t, sum(b - a) AS n, count(*) AS c FROM gaps JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, x))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
low AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
keys AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM sh GROUP BY doc_id),
eq AS (SELECT k, count(*) AS c FROM keys GROUP BY k)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, low.c AS component_id, d.doc_id = low.c AS kept, coalesce(eq.c, 1)::BIGINT AS n_equal
FROM d JOIN low ON low.a = d.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN keys USING (doc_id) LEFT JOIN eq USING (k)"""



def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a string's UTF-8: a step for each byte, eight for its bits."""
    byte = "instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 17"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))"
    return f"(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ({byte})::BIGINT)), lambda c, b: {bits}), 4294967295) FROM (SELECT hex(encode({text})) AS x))"


OP11 = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS c FROM runs WHERE length(w) >= 6 GROUP BY ALL),
h AS (SELECT w, c, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM d),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM cut),
pairs AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN v b ON a.k = b.word UNION SELECT b.word, a.word FROM less a JOIN v b ON a.k = b.word),
best AS (SELECT a, count(*) AS n_near, arg_min(struct_pack(w := b, n := v.n), (-v.n, b)) AS top FROM pairs JOIN v ON v.word = b GROUP BY a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top.n >= 5 * v.n THEN top.w END AS form, CASE WHEN top.n >= 5 * v.n THEN top.n END AS form_n FROM v LEFT JOIN best ON a = v.word),
up AS (SELECT word, word AS r FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.r WHERE f.form IS NOT NULL),
roots AS (SELECT up.word, r AS root FROM up JOIN f ON f.word = r WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)"""


OP13 = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, 0 AS own, p, r, t FROM c JOIN o ON o.conv_id = base WHERE p < h UNION ALL SELECT c.conv_id, 1, p, r, t FROM c JOIN o ON o.conv_id = c.conv_id WHERE p >= h),
s AS (SELECT conv_id, row_number() OVER w AS d, strlen(t) AS bytes, md5(string_agg(md5(r) || md5(t), '') OVER w) AS k FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, p)),
a AS (SELECT conv_id, 0 AS d, 0 AS bytes, 'root' AS k FROM c UNION ALL SELECT * FROM s),
x AS (SELECT *, lag(k) OVER v AS up, d = max(d) OVER (PARTITION BY conv_id) AS last FROM a WINDOW v AS (PARTITION BY conv_id ORDER BY d)),
n AS (SELECT k, min(conv_id) AS conv_id, any_value(d)::BIGINT AS depth, any_value(up) AS up, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM x GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
under AS (SELECT DISTINCT i.k AS top, j.k FROM x i JOIN x j ON i.conv_id = j.conv_id AND j.d >= i.d),
sums AS (SELECT top, count(*) FILTER (kids.k IS NULL) AS leaves, sum((n.n_convs - 1) * n.bytes) AS saved FROM under JOIN n ON n.k = under.k LEFT JOIN kids ON kids.k = under.k GROUP BY top)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN sums ON sums.top = n.k LEFT JOIN n m ON m.k = n.up LEFT JOIN kids ON kids.k = n.k"""

#: Tokenising and sampling hashes, models and searches have no SQL; their queries are tested against brute force.
ORACLES = {"op1_substring_dedup": OP1, "op2_suffix_array_dedup": OP2, "op4_minhash_near_dedup": OP4, "op11_spelling_variants": OP11, "op13_conversation_trie": OP13}
