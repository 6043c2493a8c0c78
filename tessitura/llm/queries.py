"""The registered opN_ queries and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import link_quotes
from .common import table
from .exact_dedup import find_copies
from .jaccard_join import near_components
from .language_id import predict_languages
from .mixing import mix
from .periodic_runs import run_digests
from .piece_tokens import encode_texts
from .spelling import spelling_variants
from .top_products import contract_search
from .toxicity import toxicity
from .url_filter import judge_urls
from .warc import archive_pages
from .winnow import decontamination

#: The rules of op7, (verdict, host/path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP7_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                        ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (SELECT h.*, (SELECT max(struct_pack(n := length(rhost || rpath), r := rhost || rpath, v := verdict)) FROM rules
                      WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS b FROM h)
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, 'allow') AS verdict FROM best
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _op8_sql(seeds: int = 10) -> str:
    draw = lambda k: f"substr(sha256('{k // 5}:' || coalesce(doc_id::varchar, 'null')), {1 + 12 * (k % 5)}, 12)"
    extra = ", ".join(f"sum(CASE WHEN d{k} < lim THEN size ELSE 0 END) AS x{k}" for k in range(seeds))
    draws = ", ".join(f"{draw(k)} AS d{k}" for k in range(seeds))
    miss = ", ".join(f"struct_pack(m := abs(source_size * fl + x{k} - target), k := {k})" for k in range(seeds))
    pick = " ".join(f"WHEN {k} THEN d{k}" for k in range(seeds))
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, {draws} FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3.0::double WHEN 1 THEN 1.0::double ELSE 2.0::double END AS w, 2.0::double * source_size AS cap FROM s),
o AS (SELECT *, 1.5::double * sum(source_size) OVER () - coalesce(sum(cap) OVER q, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER q, 0) AS wleft
      FROM w WINDOW q AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, w * rest >= cap * wleft AS capped FROM o),
lev AS (SELECT 1.5::double * sum(source_size) - coalesce(sum(cap) FILTER (capped), 0) AS rest, sum(w) FILTER (NOT capped) AS wleft FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * lev.rest / lev.wleft END AS target FROM c, lev),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
l AS (SELECT *, floor(rate)::bigint AS fl, printf('%012x', floor((rate - floor(rate)) * 281474976710656)::bigint) AS lim FROM r),
x AS (SELECT l.source, any_value(source_size) AS source_size, any_value(target) AS target, any_value(fl) AS fl, any_value(lim) AS lim, {extra}
      FROM l JOIN d ON d.source IS NOT DISTINCT FROM l.source GROUP BY l.source),
p AS (SELECT *, list_min([{miss}]).k AS seed FROM x)
SELECT doc_id, size::bigint AS size, source_size::bigint AS source_size, target,
       (size * (fl + CASE WHEN CASE seed {pick} END < lim THEN 1 ELSE 0 END))::bigint AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""

def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 10 * i}, 10))::ubigint >> {35 - 5 * k}) & 31)::int, 1)"
                   for i in range(4) for k in range(8))
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS last FROM p)
SELECT page_id, strlen(b)::bigint AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM g
"""

def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_search(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::integer AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
v AS (SELECT item_id, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda k: w[k : k + 9]) END) AS x FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, len(x) AS m, array_to_string(x, ' ') AS t FROM v),
lens AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS t FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM d, lens)),
h AS (SELECT doc_id, item_id, dw.m, s FROM dw JOIN win USING (t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::varchar AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(hit.n, 0)::bigint AS n_hit, coalesce(it.n, 0)::bigint AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


QUERIES = {"op11_spelling_variants": op11_spelling_variants, "op12_periodic_runs": op12_periodic_runs, "op13_decontamination": op13_decontamination, "op2_quote_links": op2_quote_links, "op1_language_id": op1_language_id, "op3_exact_topk": op3_exact_topk, "op4_toxicity": op4_toxicity, "op5_jaccard_join": op5_jaccard_join, "op6_warc": op6_warc, "op7_url_filter": op7_url_filter,
           "op8_mixing": op8_mixing, "op9_sentencepiece": op9_sentencepiece, "op10_exact_dedup": op10_exact_dedup}
ORACLES = {"op3_exact_topk": OP3_SQL, "op5_jaccard_join": OP5_SQL, "op6_warc": OP6_SQL, "op7_url_filter": OP7_SQL, "op8_mixing": _op8_sql(), "op10_exact_dedup": OP10_SQL, "op13_decontamination": OP13_SQL}
