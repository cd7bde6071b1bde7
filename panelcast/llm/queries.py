"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bloom_lm, bpe_tree, cotrain, decontam, mih, mincut, piece_agenda, prefix_trie, secret_ledger, simhash_ball, spelling, token_store, url_digest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op8_bpe_tree")
def op8(spark, folder):
    return bpe_tree.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


_WORDS = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op10_decontamination",
    rf"""
WITH item AS (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[b:b + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS b FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents),
pos AS (SELECT doc_id, b, l, array_to_string(w[b:b + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS b FROM doc), (SELECT DISTINCT l FROM win) WHERE b + l - 1 <= len(w)),
hit AS (SELECT DISTINCT doc_id, b, pos.l, item_id FROM pos JOIN win ON pos.g = win.g AND pos.l = win.l),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(b, b + l)) AS p FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN n ON doc.doc_id = n.doc_id LEFT JOIN i ON doc.doc_id = i.doc_id""",
)
def op10(spark, folder):
    return decontam.flags(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_SECRETS = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ("url_password", r"[a-z][a-z0-9+.-]{1,19}://[^\x00-\x20/:@]*:[^\x00-\x20/:@]+@", 0, 0),
)


@query(
    "op2_secret_scan",
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {i} AS ord, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {g}) AS vs, {n} AS least FROM d"
        for i, (k, p, g, n) in enumerate(_SECRETS)
    )
    + """), e AS (SELECT doc_id, kind, ord, least, gaps, ms, vs, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, ord, (list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0))::BIGINT AS b,
  length(ms[i]) AS l FROM e WHERE length(vs[i]) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat_ws(':', kind, b::VARCHAR, (b + l)::VARCHAR), ',' ORDER BY b, ord) FILTER (ord < 3) AS base,
  string_agg(concat_ws(':', kind, b::VARCHAR, (b + l)::VARCHAR), ',' ORDER BY b, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON d.doc_id = a.doc_id""",
)
def op2(spark, folder):
    return secret_ledger.summary(secret_ledger.scan(table(spark, folder, "documents")))


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query(
    "op9_url_filter",
    """WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM u),
p AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, v) AS (VALUES """
    + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    + """)
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, coalesce(arg_max(v, length(rhost || rpath)), 'allow') AS verdict
FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path""",
)
def op9(spark, folder):
    return url_digest.judge(table(spark, folder, "pages"), URL_RULES)


@query("op1_token_store")
def op1(spark, folder):
    return token_store.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_simhash_ball")
def op7(spark, folder):
    return simhash_ball.near_duplicates(table(spark, folder, "documents"))


@query("op4_cotraining")
def op4(spark, folder):
    docs = table(spark, folder, "documents")
    return cotrain.score(docs, cotrain.train(docs, table(spark, folder, "labels")))


@query("op5_multi_index_hashing")
def op5(spark, folder):
    return mih.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query("op6_bloom_lm")
def op6(spark, folder):
    return bloom_lm.score(table(spark, folder, "documents"))


@query("op3_mincut_text")
def op3(spark, folder):
    return mincut.extract(table(spark, folder, "pages"))


def _crc32(codes: str) -> str:
    """SQL for the unsigned crc32 of a list of byte values."""
    bit = "xor(c >> 1, 3988292384 * (c & 1))"
    byte = f"list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, x: {byte}), 4294967295)"


@query(
    "op11_prefix_trie",
    f"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, s, {_crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 9 AS h FROM own),
built AS (SELECT c.conv_id, list_concat(coalesce(b.s[1:h], []), c.s[h + 1:]) AS s FROM h c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, s, len(s) AS l, unnest(range(0, len(s) + 1)) AS d FROM built),
n AS (SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = d), '')) AS ends_sha256 FROM p GROUP BY s[1:d], d),
k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY p[1:d - 1], d - 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.p = k.p AND n.d = k.d),
e AS (SELECT p, d, n_convs, n_children, unnest(range(0, d + 1)) AS u FROM m),
sub AS (SELECT p[1:u] AS p, u AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * CASE WHEN d > 0 THEN strlen(p[d].t) ELSE 0 END) AS saved FROM e GROUP BY p[1:u], u)
SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN sub ON m.p = sub.p AND m.d = sub.d LEFT JOIN n up ON up.p = m.p[1:m.d - 1] AND up.d = m.d - 1""",
)
def op11(spark, folder):
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


@query("op13_piece_agenda")
def op13(spark, folder):
    return piece_agenda.digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op12_spelling_variants",
    f"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents),
each AS (SELECT doc_id, r, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM runs WHERE length(r) >= 7 GROUP BY doc_id, r),
hashed AS (SELECT r, k, {_crc32("list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)")} AS h FROM each),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM hashed),
v AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS c FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
pair AS (SELECT DISTINCT * FROM (
  SELECT a.word, a.n, b.word AS o, b.n AS o_n FROM cut a JOIN v b ON a.c = b.word
  UNION ALL SELECT b.word, b.n, a.word, a.n FROM cut a JOIN v b ON a.c = b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.c = b.c AND a.i = b.i AND a.word <> b.word)),
best AS (SELECT word, count(*) AS n_near, list(struct_pack(o := o, o_n := o_n) ORDER BY o_n DESC, encode(o))[1] AS top FROM pair GROUP BY word),
w AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.o_n >= 10 * v.n THEN top.o END AS form, CASE WHEN top.o_n >= 10 * v.n THEN top.o_n END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word),
walk AS (WITH RECURSIVE s(word, goal) AS (SELECT word, form FROM w WHERE form IS NOT NULL UNION ALL SELECT s.word, w.form FROM s JOIN w ON s.goal = w.word WHERE w.form IS NOT NULL) SELECT * FROM s),
ends AS (SELECT walk.word, goal FROM walk JOIN w ON walk.goal = w.word WHERE w.form IS NULL)
SELECT w.word, form, coalesce(goal, w.word) AS root, n, n_near, form_n FROM w LEFT JOIN ends ON w.word = ends.word""",
)
def op12(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))
