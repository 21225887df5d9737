"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unsigned_crc
from .decontaminate import decontaminate
from .embedding_join import embedding_join
from .exact_dedup import exact_dedup
from .fill_middle import fill_in_middle
from .language_id import fit_language, predict_language
from .mixing import mix_sources
from .ngram_join import ngram_join
from .pieces import encode_pieces
from .quality import fit_quality, score_quality
from .sharding import shard_documents
from .spelling import spelling_variants, word_counts
from .token_counts import encoded_lengths, length_histogram
from .toxicity import fit_toxicity, toxic_passages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("text_md5")


def remainder(column: str, of: int) -> Column:
    return F.coalesce(unsigned_crc(column) % of, F.lit(0))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(remainder("doc_id", 5) != 0))
    found = toxic_passages(docs, model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op3_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fit_language(docs.filter(remainder("doc_id", 3) != 1))
    return predict_language(docs, network).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), all_ids=True)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), texts=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_toxicity, op3_embedding_join, op4_quality, op5_language_id, op6_pieces, op7_mixing, op8_sharding, op9_exact_dedup, op10_token_counts, op11_decontamination, op12_spelling, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1, "op3_embedding_join": OP3, "op7_mixing": OP7, "op9_exact_dedup": OP9, "op11_decontamination": OP11, "op12_spelling": OP12, "op13_fill_in_middle": OP13}


OP1 = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cls AS (SELECT text, min(doc_id) AS c, count(*) AS copies FROM t GROUP BY 1),
w AS (SELECT c, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS ws FROM cls),
sh AS (SELECT DISTINCT c, s FROM (SELECT c, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)),
n AS (SELECT c, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.c AS a, b.c AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.c < b.c GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT c AS a, c AS b FROM cls UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS c, min(b) AS class_id FROM r GROUP BY 1),
k AS (SELECT e.a AS c, count(*) AS texts, sum(copies)::BIGINT AS docs FROM e JOIN cls ON cls.c = e.b GROUP BY 1)
SELECT doc_id, class_id, (coalesce(docs, 0) + copies - 1)::BIGINT AS n_links, coalesce(texts, 0)::BIGINT AS n_text_links, copies, doc_id = class_id AS kept
FROM t JOIN cls USING (text) JOIN g USING (c) LEFT JOIN k USING (c)
"""
OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM g LEFT JOIN k USING (vec_id)
"""
OP7 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  -ln((('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / greatest(coalesce(0.25 + 0.75 * length(translate(text, '0123456789#$%&*|<>{}[]()!?_=+~^/\@', '')) / nullif(length(text), 0), 0.25), 1e-6) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at FROM w),
u AS (SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(weight) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM f),
v AS (SELECT *, (1.5::DOUBLE * total - used) / rest AS level FROM u),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT max(level) FROM v WHERE level <= full_at) * weight, 2.0::DOUBLE * source_size)) AS target FROM v),
b AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS complete FROM t),
c AS (SELECT d.*, b.source_size, b.target, b.complete, b.target - b.complete * b.source_size AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target, (size * (complete + CASE WHEN upto <= budget OR 2 * budget > 2 * upto - size THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""


OP9 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
OP11 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT DISTINCT item, least(len(ws), 10) AS k, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS t FROM b WHERE len(ws) > 0),
p AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
h AS (SELECT r, i, k, item FROM (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS t FROM p, (SELECT DISTINCT k FROM w) WHERE i + k - 1 <= len(ws)) JOIN w USING (k, t)),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS i FROM (SELECT DISTINCT r, i, k FROM h)) GROUP BY 1),
m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""
OP12 = r"""
WITH RECURSIVE bits AS (SELECT range AS b, list_reduce(list_prepend(range, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256)),
crc AS (SELECT list(v ORDER BY b) AS v FROM bits),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
g AS (SELECT run, count(*) AS m, coalesce(doc_id::VARCHAR, '') || ':' || run AS of FROM r GROUP BY doc_id, run),
x AS (SELECT run, m, list_transform(range(0, strlen(of)), lambda i: ('0x' || substr(hex(encode(of)), 2 * i + 1, 2))::BIGINT) AS bytes FROM g),
s AS (SELECT run, m, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, y: xor(v[xor(c, y) % 256 + 1], c >> 8)), 4294967295::BIGINT) AS h FROM x, crc),
c AS (SELECT word, sum(m)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM s) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(m) >= 3),
l AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM c)),
e AS (SELECT a.word, b.word AS near, b.n AS m FROM l a JOIN l b ON a.part = b.part AND a.i = b.i AND a.word <> b.word UNION SELECT l.word, c.word, c.n FROM l JOIN c ON l.part = c.word UNION SELECT c.word, l.word, l.n FROM l JOIN c ON l.part = c.word),
k AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM e GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM c LEFT JOIN k USING (word)),
t AS (SELECT word, word AS at FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.at WHERE f.form IS NOT NULL),
z AS (SELECT t.word, t.at AS root FROM t JOIN f ON f.word = t.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN z USING (word)
"""
OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, [('0x' || h[1:8])::BIGINT % (len(u) + 1), ('0x' || h[9:16])::BIGINT % (len(u) + 1)] AS cuts, ('0x' || h[17:24])::BIGINT % 100 AS rate, ('0x' || h[25:32])::BIGINT % 100 AS side FROM d),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR rate >= 90 THEN 'plain' WHEN side < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[:list_min(cuts)], '') AS p, array_to_string(u[list_min(cuts) + 1:list_max(cuts)], '') AS m, array_to_string(u[list_max(cuts) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""
