"""One query per operator over the test tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from .. import models as M
from ..operators import dedup, lifecycle, metric, records, reporting, search
from ..operators import retrieval as R
from ..operators import vectors as V
from ..sources.pages import PagesSource
from ..sources.store import Store, shared_folder
from ..streaming import watch
from . import tables as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


A = f"WITH {B.ASSETS}\n"


# scalar layer


@query(A + "SELECT asset_id, path FROM assets WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('jpg','jpeg','png','webp','bmp','pdf')")
def scan_ext_filter(spark, d):
    return B.assets(spark, d).where(T.is_indexable(F.col("path"))).select("asset_id", "path")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS sha256 FROM documents")
def hash_sha256(spark, d):
    return B.read(spark, d, "documents").select("doc_id", H.file_digest(F.col("text").cast("binary")).alias("sha256"))


@query(f"WITH src AS (SELECT doc_id AS id, text AS txt FROM documents), {B.embedded('e', 'src')} SELECT id AS doc_id, CAST(b AS INTEGER) AS bucket, round(x, 6) AS x FROM e")
def hash_embedding(spark, d):
    v = B.read(spark, d, "documents").select("doc_id", F.posexplode(H.hash_embedding(F.col("text"))).alias("bucket", "x"))
    return v.where("x <> 0").select("doc_id", "bucket", F.round("x", 6).alias("x"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: 9 * x::DOUBLE * x::DOUBLE))), 4) AS norm,
  round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings""")
def l2_normalize(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    return B.read(spark, d, "embeddings").select("vec_id", F.round(H.norm(v), 4).alias("norm"), F.round(F.get(H.unit(v), 0), 5).alias("first"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0")
def nonzero_vectors(spark, d):
    zero = F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return B.read(spark, d, "embeddings").where(H.is_nonzero(zero)).select("vec_id")


@query(A + "SELECT asset_id, array_to_string(list_filter([caption, lang, source], lambda x: x <> ''), ' ') AS visual_input FROM assets")
def visual_input(spark, d):
    return B.assets(spark, d).select("asset_id", T.visual_input(F.col("caption"), F.array("lang"), F.array("source")).alias("visual_input"))


@query("SELECT doc_id, regexp_replace('  ' || text || chr(10), '^\\s+|\\s+$', '', 'g') AS text_input FROM documents")
def text_input(spark, d):
    return B.read(spark, d, "documents").select("doc_id", T.strip(F.concat(F.lit("  "), "text", F.lit("\n"))).alias("text_input"))


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
TAGS = f"""array_to_string(list_filter(list_filter(regexp_extract_all(lower(CAP), '[A-Za-z]{{3,}}'), lambda w: w NOT IN ({STOP})),
  lambda w, i: list_position(list_filter(regexp_extract_all(lower(CAP), '[A-Za-z]{{3,}}'), lambda v: v NOT IN ({STOP})), w) = i)[1:8], ',')"""


@query(A + f"SELECT asset_id, {TAGS.replace('CAP', 'caption')} AS tags FROM assets")
def derive_tags(spark, d):
    return B.assets(spark, d).select("asset_id", F.array_join(T.derive_tags(F.col("caption")), ",").alias("tags"))


@query(A + f"""SELECT asset_id, CASE WHEN asset_id % 2 = 0 THEN trim(caption) ELSE caption END AS caption, CASE WHEN asset_id % 2 = 0 THEN source || ',' || lang ELSE {TAGS.replace('CAP', 'trim(caption)')} END AS tags FROM assets""")
def parse_caption(spark, d):
    odd, even = F.concat(F.lit("\n"), "text"), F.concat(F.lit("x\nCaption: "), "caption", F.lit("\nTAGS: "), "source", F.lit(" ; "), "lang", F.lit(","))
    r = B.assets(spark, d).select("asset_id", T.parse_response(F.when(F.col("asset_id") % 2 == 0, even).otherwise(odd)).alias("r"))
    return r.select("asset_id", "r.caption", F.array_join("r.tags", ",").alias("tags"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS full_text, bool_or(length(trim(text)) > 0) AS has_text FROM conversations GROUP BY 1")
def ocr_flatten(spark, d):
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return B.read(spark, d, "conversations").groupBy("conv_id").agg(T.flatten_blocks(blocks).alias("r")).select("conv_id", "r.*")


CLASS = "CASE WHEN length(text) % 80 >= 40 THEN CASE WHEN doc_id % 4 >= 1 THEN 'mixed' ELSE 'born_digital_text' END WHEN doc_id % 4 >= 2 THEN 'figure' WHEN doc_id % 4 = 1 THEN 'scanned' ELSE 'born_digital_text' END"


@query(f"SELECT doc_id, {CLASS} AS page_type FROM documents")
def classify_page(spark, d):
    return B.read(spark, d, "documents").select("doc_id", T.page_type(F.length("text") % 80, F.col("doc_id") % 4).alias("page_type"))


@query("SELECT conv_id || '#p' || turn || CASE WHEN turn % 2 = 1 THEN '#r0' ELSE '' END AS vec_id, conv_id || '#p' || turn AS entity, CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS INTEGER) AS page FROM conversations")
def entity_of(spark, d):
    rows = B.read(spark, d, "conversations").select(F.concat("conv_id", F.lit("#p"), "turn", F.when(F.col("turn") % 2 == 1, "#r0").otherwise("")).alias("vec_id"))
    return rows.select("vec_id", T.entity(F.col("vec_id")).alias("e")).select("vec_id", "e.*")


POOL = "['person','car','tree','building','dog','chair','sign']"


@query(A + f"""SELECT asset_id, seed, CASE WHEN l1 = l2 THEN l1 ELSE l1 || ',' || l2 END AS labels, ['outdoor urban scene','indoor room','natural landscape','street view'][seed % 4 + 1] AS caption FROM (
  SELECT asset_id, seed, {POOL}[seed % 7 + 1] AS l1, {POOL}[seed // 7 % 7 + 1] AS l2 FROM (SELECT asset_id, CAST('0x' || left(sha256(path), 8) AS BIGINT) AS seed FROM assets))""")
def stub_extract(spark, d):
    p = F.col("path")
    return B.assets(spark, d).select("asset_id", H.seed_of(p).alias("seed"), F.array_join(H.stub_labels(p), ",").alias("labels"), H.stub_caption(p).alias("caption"))


@query(A + """SELECT asset_id, '{"id":' || asset_id || ',"path":"' || path || '","scene":{"tags":["' || source || '","' || lang || '"]},"indexed":' || CAST(indexed AS VARCHAR) || '}' AS json FROM assets""")
def asset_json(spark, d):
    return B.assets(spark, d).select("asset_id", F.to_json(F.struct(F.col("asset_id").alias("id"), "path", F.struct(F.array("source", "lang").alias("tags")).alias("scene"), "indexed")).alias("json"))


@query("SELECT p_partkey, greatest(1, least(CAST(floor((p_retailprice * 10 * 0.7 - 1700) / 900) AS INTEGER), p_size)) AS workers FROM part")
def worker_sizing(spark, d):
    return B.read(spark, d, "part").select("p_partkey", reporting.workers(F.col("p_retailprice") * 10, F.col("p_size")).alias("workers"))


BITS = "list_transform(range(64), lambda i: CASE WHEN px[i // 8 * 9 + i % 8 + 1] > px[i // 8 * 9 + i % 8 + 2] THEN '1' ELSE '0' END)"


@query(f"""SELECT vec_id, array_to_string(bits, '') AS bits, array_to_string(list_transform(range(16), lambda n: lower(to_hex(CAST(CAST(bits[4 * n + 1] AS INTEGER) * 8 + CAST(bits[4 * n + 2] AS INTEGER) * 4 + CAST(bits[4 * n + 3] AS INTEGER) * 2 + CAST(bits[4 * n + 4] AS INTEGER) AS BIGINT)))), '') AS phash
  FROM (SELECT vec_id, {BITS} AS bits FROM (SELECT vec_id, list_transform(list_concat(embedding, embedding[1:8]), lambda x: CAST(floor(256 * x::DOUBLE) AS INTEGER)) AS px FROM embeddings))""")
def dhash_bits(spark, d):
    px = F.transform(F.concat("embedding", F.slice("embedding", 1, 8)), lambda x: F.floor(x.cast("double") * 256).cast("int"))
    rows = B.read(spark, d, "embeddings").select("vec_id", px.alias("px")).select("vec_id", H.dhash_bits(F.col("px")).alias("bits"))
    return rows.select("vec_id", "bits", H.bits_to_hex(F.col("bits")).alias("phash"))


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, greatest(0, CAST(floor((l_quantity - 5) * 2.0) AS INTEGER)) AS x0, least(80, CAST(floor((l_quantity + l_linenumber * 3) * 2.0) AS INTEGER)) AS x1,
  greatest(0, CAST(floor((50 - l_quantity) * 2.0) AS INTEGER)) AS y0, least(90, CAST(floor((50 - l_quantity + 7) * 2.0) AS INTEGER)) AS y1 FROM lineitem) WHERE x1 > x0 AND y1 > y0""")
def region_crop_bbox(spark, d):
    q = F.col("l_quantity")
    box = {"x0": q - 5, "x1": q + F.col("l_linenumber") * 3, "y0": q - 7, "y1": q}
    made = T.crop_box(box, F.lit(50.0), F.lit(2.0), F.lit(80), F.lit(90))
    return B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", made.alias("b")).where("b is not null").select("l_orderkey", "l_linenumber", "b.*")


# vectors and retrieval


@query("WITH src AS (SELECT conv_id || '#p' || turn AS id, text AS txt FROM conversations UNION ALL SELECT conv_id || '#p' || turn || '#r0', role FROM conversations WHERE turn % 2 = 1), " + B.embedded("e", "src") + """, v AS (SELECT id, string_agg(b || ':' || CAST(round(10000 * x) AS BIGINT), ' ' ORDER BY b) AS vector FROM (SELECT id, CAST(b AS INTEGER) AS b, x FROM e) GROUP BY 1)
SELECT 'text' AS space, conv_id || '#p' || turn AS vec_id, CAST(conv_id AS VARCHAR) AS asset_id, CAST(turn AS INTEGER) AS page_index, CAST(NULL AS INTEGER) AS region_index, vector FROM conversations JOIN v ON id = conv_id || '#p' || turn WHERE length(trim(text)) > 0
UNION ALL SELECT 'visual', conv_id || '#p' || turn || '#r0', CAST(conv_id AS VARCHAR), CAST(turn AS INTEGER), 0, vector FROM conversations JOIN v ON id = conv_id || '#p' || turn || '#r0' WHERE turn % 2 = 1
UNION ALL SELECT 'clip', 'e' || vec_id, 'e' || vec_id, NULL, NULL, array_to_string(list_transform(embedding[1:4], lambda x: CAST(CAST(round(10000 * CAST(x AS DOUBLE)) AS BIGINT) AS VARCHAR)), ' ') FROM embeddings""")
def vectors_flatten(spark, d):
    e = H.hash_embedding(F.col("text"))
    none = F.lit(None).cast("array<double>")
    region = F.struct(H.hash_embedding(F.col("role")).alias("visual"), none.alias("clip"))
    turns = B.read(spark, d, "conversations").select("conv_id", F.struct(F.col("turn").cast("int").alias("page_index"), e.alias("text_vector"), F.when(F.col("turn") % 2 == 1, F.array(region)).otherwise(F.filter(F.array(region), lambda r: F.lit(False))).alias("regions")).alias("p"))
    docs = turns.groupBy(F.col("conv_id").cast("string").alias("asset_id")).agg(F.lit("pdf").alias("kind"), F.collect_list("p").alias("pages"), F.first(F.struct(none.alias("visual"), none.alias("text"), none.alias("clip"))).alias("embeddings"))
    images = B.read(spark, d, "embeddings").select(F.concat(F.lit("e"), "vec_id").alias("asset_id"), F.lit("image").alias("kind"), F.struct(none.alias("visual"), none.alias("text"), F.col("embedding").cast("array<double>").alias("clip")).alias("embeddings"))
    rows = V.flatten(docs.unionByName(images, allowMissingColumns=True))
    value = lambda x: F.round(x.cast("double") * 10000).cast("bigint").cast("string")
    filled = F.filter(F.transform("embedding", lambda x, i: F.when(x != 0, F.concat(i, F.lit(":"), value(x)))), lambda x: x.isNotNull())
    vector = F.when(F.col("space") == "clip", F.array_join(F.transform(F.slice("embedding", 1, 4), value), " ")).otherwise(F.array_join(filled, " "))
    return rows.select("space", "vec_id", "asset_id", "page_index", "region_index", vector.alias("vector"))


KNN = """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS sim FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 50"""


@query(KNN)
def knn_top_k(spark, d):
    v = B.read(spark, d, "embeddings").select(F.lit("clip").alias("space"), "vec_id", "embedding")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "space", "embedding")
    return metric.MetricIndex.build(v).search(asked).select("query_id", "vec_id", "rank", "sim")


@query("""WITH s AS (SELECT query_id, label AS entity, rank FROM (""" + KNN + """) k JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id))
SELECT query_id, entity, CAST(min(rank) AS INTEGER) AS rank FROM s GROUP BY 1, 2""")
def entity_rollup(spark, d):
    near = knn_top_k(spark, d).join(B.read(spark, d, "embeddings").select("vec_id", F.col("label").alias("entity")), "vec_id").withColumn("source", F.lit("clip"))
    return R.rollup(near).select("query_id", "entity", "rank")


SEARCH = "WITH " + B.search_ctes() + "\n"


@query(SEARCH + "SELECT query_id, entity, score FROM fused")
def rrf_fusion(spark, d):
    return R.fuse(B.texts_ranks(spark, d))


@query(SEARCH + "SELECT query_id, entity, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ranks GROUP BY 1, 2")
def rrf_no_absentee(spark, d):
    return R.fuse(B.texts_ranks(spark, d), absentee=False)


W = "CASE WHEN source = 'text' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"


@query(SEARCH + f", e3 AS (SELECT query_id, sum(w) AS w FROM (SELECT DISTINCT query_id, source, {W} AS w FROM ranks) GROUP BY 1) SELECT query_id, entity, round(sum({W} / (60 + rank)) + (any_value(w) - sum({W})) / 111.0::DOUBLE, 6) AS score FROM ranks JOIN e3 USING (query_id) GROUP BY 1, 2")
def rrf_weighted(spark, d):
    return R.fuse(B.texts_ranks(spark, d), weights={"text": 2.0})


@query(SEARCH + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM fused), g AS (SELECT query_id, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b FROM r GROUP BY 1)
SELECT query_id, round(CASE WHEN b IS NULL OR a <= 0 THEN 1.0 ELSE (a - b) / a END, 6) AS gap, b IS NOT NULL AND (a - b) / a < 0.05 AS rerank FROM g""")
def rerank_gate(spark, d):
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity")
    return R.gap(R.fuse(B.texts_ranks(spark, d)).withColumn("rank", F.row_number().over(order)))


@query(SEARCH + "SELECT query_id, entity, CASE WHEN count(*) = 2 THEN 'visual,text' ELSE any_value(source) END AS matched FROM ranks GROUP BY 1, 2")
def matched_spaces(spark, d):
    return R.matched(B.texts_ranks(spark, d))


# searches


LAKE = "WITH " + B.lake_ctes() + "\n"


def _live(spark, d):
    return B.assets(spark, d).select("asset_id", "state", "kind", "has_text", "labels")


def _search(spark, d, **options):
    """Text search of the benchmark items over the nested assets, as result rows."""
    asked = B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = search.text_search(asked, B.lake_vectors(spark, d), B.lake(spark, d), H.hash_embedding, **options)
    return found.withColumn("objects", F.array_join("objects", ","))


def _search_sql(where: str = "TRUE", limit: int = 10) -> str:
    return LAKE + f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, entity AS id, path, page, kind, score, caption, objects, matched, FALSE AS reranked
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM hits WHERE {where}) WHERE rank <= {limit}"""


def _again_sql(limit: int, gap: str) -> str:
    words = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> ''))"
    return LAKE + f""", pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS position FROM hits) WHERE position <= {max(3 * limit, 20)}),
g AS (SELECT query_id, max(score) FILTER (position = 1) AS a, max(score) FILTER (position = 2) AS b FROM pool GROUP BY 1),
w AS (SELECT pool.*, b IS NOT NULL AND {gap} AS reranked, round(len(list_intersect({words.format("t.text")}, {words.format("ce")})) / greatest(1, len({words.format("t.text")})), 6) AS ce_score
  FROM pool JOIN g USING (query_id) JOIN benchmark t ON item_id = query_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN reranked THEN ce_score END DESC, position) AS rank FROM w)
SELECT query_id, CAST(rank AS INTEGER) AS rank, entity AS id, path, page, kind, score, caption, objects, matched, reranked FROM o WHERE rank <= {limit}"""


@query(_search_sql())
def search_text(spark, d):
    return _search(spark, d)


@query(_again_sql(5, "TRUE"))
def search_pool(spark, d):
    """The re-rank looks at the pool of 20, so rows beyond the limit of 5 come up."""
    return _search(spark, d, limit=5, rerank=R.lexical_rerank)


@query(_again_sql(10, "CASE WHEN a > 0 THEN (a - b) / a ELSE 1.0 END < 0.01"))
def search_gated(spark, d):
    return _search(spark, d, rerank=R.lexical_rerank, gap=0.01)


@query(_search_sql("kind = 'pdf'"))
def search_filter_kind(spark, d):
    return _search(spark, d, kind="pdf")


@query(_search_sql("has_text"))
def search_filter_has_text(spark, d):
    return _search(spark, d, with_text=True)


@query(_search_sql("list_contains(labels, 'user')"))
def search_filter_object(spark, d):
    return _search(spark, d, label=" User ")


@query(SEARCH + "SELECT query_id, count(*) AS n, count(*) FILTER (state = 'active') AS live FROM fused JOIN assets ON asset_id = entity GROUP BY 1")
def search_orphan_guard(spark, d):
    fused = R.fuse(B.texts_ranks(spark, d)).withColumn("asset_id", F.col("entity"))
    live = fused.join(_live(spark, d).where("state = 'active'"), "asset_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("live"))
    return fused.groupBy("query_id").agg(F.count("*").alias("n")).join(live, "query_id", "left").select("query_id", "n", F.coalesce("live", F.lit(0)).alias("live"))


PAGE = ",\n".join(["cd AS (SELECT conv_id || '#p' || turn AS id, text AS txt FROM conversations)", "bq AS (SELECT item_id AS id, text AS txt FROM benchmark)", B.embedded("ec", "cd"), B.embedded("eq", "bq"), B.ranked("rc", "eq", "ec", 10)])


def _page_hits(spark, d):
    turns = B.read(spark, d, "conversations").select(F.concat("conv_id", F.lit("#p"), "turn").alias("vec_id"), F.lit("text").alias("space"), H.hash_embedding(F.col("text")).alias("embedding"))
    asked = B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("text").alias("space"), H.hash_embedding(F.col("text")).alias("embedding"))
    near = R.knn(asked, turns, 10)
    return near.withColumn("e", T.entity(F.col("vec_id"))).select("query_id", "rank", F.col("e.doc").alias("asset_id"), F.col("e.page").alias("page_index"))


def _pages(spark, d):
    return B.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("asset_id"), F.col("turn").cast("int").alias("page_index"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("page_text"), F.when(F.col("turn") % 2 == 0, F.array(F.lit(""), F.col("role"))).otherwise(F.array(F.lit(""))).alias("region_captions"), "role", "text")


CAPTION = "CASE WHEN turn % 3 <> 0 AND text <> '' THEN substr(text, 1, 120) WHEN turn % 2 = 0 THEN role ELSE 'page ' || (turn + 1) END"


@query("WITH " + PAGE + f" SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(conv_id AS VARCHAR) AS asset_id, CAST(turn AS INTEGER) AS page_index, {CAPTION} AS caption FROM rc JOIN conversations ON conv_id || '#p' || turn = entity")
def page_search(spark, d):
    return search.page_results(_page_hits(spark, d), _pages(spark, d)).select("query_id", "rank", "asset_id", "page_index", "caption")


@query("SELECT conv_id, count(*) AS n_pages, sum(CASE WHEN length(text) >= 40 THEN 1 ELSE 0 END)::BIGINT AS n_text, max(turn) AS last_page FROM conversations GROUP BY 1")
def page_hierarchy(spark, d):
    docs = B.read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("pages"))
    return docs.select("conv_id", F.size("pages").cast("bigint").alias("n_pages"), F.size(F.filter("pages", lambda p: F.length(p["text"]) >= 40)).cast("bigint").alias("n_text"), F.array_max(F.transform("pages", lambda p: p["turn"])).alias("last_page"))


@query("SELECT conv_id, string_agg(CASE WHEN length(text) >= 100 THEN CASE WHEN turn % 2 = 0 THEN 'mixed' ELSE 'born_digital_text' END ELSE CASE WHEN turn % 2 = 0 THEN 'scanned' ELSE 'born_digital_text' END END, ',' ORDER BY turn) AS page_types FROM conversations GROUP BY 1")
def page_types(spark, d):
    kind = T.page_type(F.when(F.length("text") >= 100, 40).otherwise(0), F.when(F.col("turn") % 2 == 0, 1).otherwise(0))
    pages = F.array_sort(F.collect_list(F.struct("turn", kind.alias("page_type"))))
    return B.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(pages, lambda p: p["page_type"]), ",").alias("page_types"))


@query("WITH k AS (" + KNN + """) SELECT query_id, CAST(r AS INTEGER) AS rank, CAST(vec_id AS VARCHAR) AS id, '/lake/' || vec_id || '.png' AS path, score, 'clip' AS matched
FROM (SELECT query_id, vec_id, round(1.0::DOUBLE / (60 + rank), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (60 + rank), 6) DESC, CAST(vec_id AS VARCHAR)) AS r FROM k WHERE vec_id % 11 <> 0) WHERE r <= 20""")
def search_by_vector(spark, d):
    v = B.read(spark, d, "embeddings")
    none = F.lit(None)
    held = v.select(F.lit("clip").alias("space"), "vec_id", F.col("vec_id").cast("string").alias("asset_id"), none.cast("int").alias("page_index"), "embedding")
    assets = v.select(F.col("vec_id").cast("string").alias("asset_id"), F.when(F.col("vec_id") % 11 == 0, "deleted").otherwise("active").alias("state"), F.concat(F.lit("/lake/"), "vec_id", F.lit(".png")).alias("path"), F.lit("image").alias("kind"))
    full = B.lake(spark, d).limit(0).unionByName(assets, allowMissingColumns=True)
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.image_search(asked, held, full).select("query_id", "rank", "id", "path", "score", "matched")


@query(KNN.replace("rank <= 50", "rank <= 13").join(["WITH k AS (", ") SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM k WHERE vec_id <> query_id AND vec_id % 11 <> 0) WHERE r <= 12"]))
def similar_assets(spark, d):
    v = B.read(spark, d, "embeddings").select(F.lit("clip").alias("space"), "vec_id", F.col("vec_id").alias("asset_id"), "embedding")
    assets = v.select("asset_id", F.when(F.col("asset_id") % 11 == 0, "deleted").otherwise("active").alias("state"))
    return search.similar(v, v.where("vec_id % 20 = 0").select("asset_id"), assets).select("query_id", "rank", "vec_id")


@query("WITH k AS (" + KNN + """), p AS (SELECT query_id, vec_id AS entity, 51 - rank AS position, CASE WHEN rank % 3 = 0 THEN NULL ELSE rank END AS clip_rank FROM k), b AS (SELECT *, round(2.0::DOUBLE / (60 + position) + 1.0::DOUBLE / (60 + coalesce(clip_rank, 51)), 9) AS blend FROM p)
SELECT query_id, entity, blend, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, position) AS INTEGER) AS rank FROM b""")
def clip_blend(spark, d):
    pool = knn_top_k(spark, d).select("query_id", F.col("vec_id").alias("entity"), (51 - F.col("rank")).alias("position"), F.when(F.col("rank") % 3 != 0, F.col("rank")).alias("clip_rank"))
    return R.clip_blend(pool).select("query_id", "entity", "blend", "rank")


WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda x: x <> ''))"


@query("WITH " + PAGE + f""", c AS (SELECT query_id, entity, rank AS position, round(len(list_intersect({WORDS.format('b.text')}, {WORDS.format('c.text')})) / greatest(1, len({WORDS.format('b.text')})), 6) AS ce
  FROM rc JOIN benchmark b ON item_id = query_id JOIN conversations c ON conv_id || '#p' || turn = entity) SELECT query_id, entity, ce, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ce DESC, position) AS INTEGER) AS rank FROM c""")
def rerank_order(spark, d):
    hits = _page_hits(spark, d).join(_pages(spark, d).select("asset_id", "page_index", "text"), ["asset_id", "page_index"]).join(B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    pool = hits.select("query_id", F.concat("asset_id", F.lit("#p"), "page_index").alias("entity"), F.col("rank").alias("position"), "query", "text")
    return R.lexical_rerank(pool).select("query_id", "entity", "ce", "rank")


@query("WITH " + PAGE + " SELECT query_id, string_agg('[' || rank || '] ' || conv_id || '.pdf p' || (turn + 1) || ': ' || role || ' ' || 'turn, ' || role || ' ' || substr(text, 1, 300), chr(10) ORDER BY rank) AS context FROM rc JOIN conversations ON conv_id || '#p' || turn = entity WHERE rank <= 5 GROUP BY 1")
def rag_context(spark, d):
    hits = _page_hits(spark, d).where("rank <= 5").join(_pages(spark, d).select("asset_id", "page_index", "role", "text"), ["asset_id", "page_index"])
    return search.rag_context(hits.select("query_id", "rank", F.concat(F.lit("/lake/"), "asset_id", F.lit(".pdf")).alias("path"), "page_index", F.col("role").alias("caption"), F.array(F.lit("turn"), "role").alias("labels"), "text"))


@query(_search_sql().replace("AS id, path, page, kind, score, caption, objects, matched, FALSE AS reranked", "AS id, kind, page, caption, score, matched"))
def agent_results(spark, d):
    return search.agent_rows(_search(spark, d))


@query(LAKE + """, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM hits)
SELECT query_id, string_agg('[' || rank || '] ' || split_part(path, '/', -1) || CASE WHEN page IS NULL THEN '' ELSE ' p' || (page + 1) END || ': ' || caption || ' ' || objects || ' ', chr(10) ORDER BY rank) AS context,
  string_agg(entity, ',' ORDER BY rank) AS sources, 'The answering model is unavailable; these are the sources.' AS answer FROM a WHERE rank <= 5 GROUP BY 1""")
def ask_sources(spark, d):
    asked = B.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = search.text_search(asked, B.lake_vectors(spark, d), B.lake(spark, d), H.hash_embedding, limit=5)
    no_texts = found.limit(0).select("id", F.lit("").alias("text"))
    return search.ask(found, no_texts, asked).withColumn("sources", F.array_join("sources", ","))


# records


@query(A + f"""SELECT path, l1 AS first_label, caption, caption || ' ' || caption || ' ' || CASE WHEN l1 = l2 THEN l1 ELSE l1 || ' ' || l2 END AS visual_input, upper(lower(regexp_extract(path, '\\.([^./]+)$', 1))) AS format, 'disabled' AS faces, 'stub' AS scene
  FROM (SELECT path, {POOL}[seed % 7 + 1] AS l1, {POOL}[seed // 7 % 7 + 1] AS l2, ['outdoor urban scene','indoor room','natural landscape','street view'][seed % 4 + 1] AS caption FROM (SELECT path, CAST('0x' || left(sha256(path), 8) AS BIGINT) AS seed FROM assets))""")
def image_records(spark, d):
    none = F.lit("")
    files = B.assets(spark, d).select("path", "sha256", none.alias("pixel_hash"), none.alias("phash"), F.length("text").cast("bigint").alias("size_bytes"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    made = records.images(files, M.Models())
    return made.select("path", F.get("objects.label", 0).alias("first_label"), F.col("scene.caption").alias("caption"), "embeddings.visual_input", "format", F.col("models_used")["faces"].alias("faces"), F.col("models_used")["scene"].alias("scene"))


BOXES = "turn % 11"


@query(f"""WITH p AS (SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 THEN '' ELSE text END) AS txt, {BOXES} AS n FROM conversations),
k AS (SELECT *, CASE WHEN length(txt) >= 40 THEN CASE WHEN n >= 1 THEN 'mixed' ELSE 'born_digital_text' END WHEN n >= 2 THEN 'figure' WHEN n = 1 THEN 'scanned' ELSE 'born_digital_text' END AS page_type FROM p)
SELECT '/lake/c' || conv_id || '.pdf' AS path, count(*) AS n_pages, string_agg(page_type, ',' ORDER BY turn) AS page_types, sum(CASE WHEN page_type = 'born_digital_text' THEN 0 WHEN n > 0 THEN least(8, n) ELSE 1 END)::BIGINT AS n_regions,
  sum(CASE WHEN txt <> '' THEN 1 ELSE 0 END)::BIGINT AS n_texts, 'PDF · ' || count(*) || ' pages' AS caption FROM k GROUP BY conv_id""")
def document_records(spark, d):
    path = F.concat(F.lit("/lake/c"), "conv_id", F.lit(".pdf")).alias("path")
    turns = B.read(spark, d, "conversations")
    box = F.array(*[F.lit(float(x)) for x in (0, 0, 9, 9)])
    page = F.struct(F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("text"), F.array_repeat(box, F.expr(BOXES).cast("int")).alias("boxes"))
    papers = turns.groupBy(path).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"]).alias("pages"))
    container = f"{shared_folder(spark)}/archivelake/pages-{uuid.uuid4().hex}"
    papers.select(F.to_json(F.struct("path", "pages"))).write.text(container)
    spark.dataSource.register(PagesSource)
    pages = spark.read.format("archive_pages").schema("path string, page_index int, text string, boxes array<array<double>>").option("path", container.replace("file:/", "file:///").replace("file://///", "file:///")).load()
    files = turns.select(path).distinct().select("path", F.lit("sha256:0").alias("sha256"), F.lit(0).cast("bigint").alias("size_bytes"))
    made = records.documents(files, pages, M.Models())
    shown = records.summaries(made).select("path", "caption")
    regions = F.aggregate("pages", F.lit(0).cast("bigint"), lambda n, p: n + F.size(p["regions"]))
    texts = F.size(F.filter("pages", lambda p: F.exists(p["text_vector"], lambda x: x != 0)))
    rows = made.select("path", F.col("n_pages").cast("bigint").alias("n_pages"), F.array_join(F.transform("pages", lambda p: p["page_type"]), ",").alias("page_types"), regions.alias("n_regions"), texts.cast("bigint").alias("n_texts"))
    return rows.join(shown, "path")


@query("SELECT '/lake/d' || doc_id || '.png' AS path, lang AS label, source AS tag, length(text) AS n FROM documents")
def json_import(spark, d):
    """Records written as JSON and read again."""
    back = records.from_json(records.to_json(B.lake(spark, d).where("kind = 'image'")))
    return back.select("path", F.get("objects.label", 0).alias("label"), F.get("scene.tags", 0).alias("tag"), F.length("ocr.full_text").cast("bigint").alias("n"))


# duplicates and ingest

P = "WITH " + B.PHASHES + "\n"


@query(P + """, u AS (SELECT ph, min(id) AS id, count(*) AS n FROM phashes GROUP BY 1)
SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, bit_count(xor(x.ph, y.ph))::INTEGER AS distance, CASE WHEN x.id < y.id THEN x.n ELSE y.n END AS n_a, CASE WHEN x.id < y.id THEN y.n ELSE x.n END AS n_b
FROM u x JOIN u y ON x.ph < y.ph AND bit_count(xor(x.ph, y.ph)) <= 10""")
def phash_near_pairs(spark, d):
    return dedup.near_classes(B.phashes(spark, d))


OLD, NEW = "id % 2 = 0", "id % 2 = 1"
LOOKUP = """o AS (SELECT * FROM phashes WHERE id % 2 = 0), n AS (SELECT * FROM phashes WHERE id % 2 = 1),
t1 AS (SELECT sha256, min(id) AS d1 FROM o GROUP BY 1), t2 AS (SELECT pixel_hash, min(id) AS d2 FROM o GROUP BY 1),
t3 AS (SELECT a.ph, min(b.id) AS d3 FROM (SELECT DISTINCT ph FROM n) a, o b WHERE bit_count(xor(a.ph, b.ph)) <= 10 GROUP BY 1),
hit AS (SELECT n.id, coalesce(d1, d2, d3) AS duplicate_of, CASE WHEN d1 IS NOT NULL THEN 'sha256' WHEN d2 IS NOT NULL THEN 'pixel_hash' WHEN d3 IS NOT NULL THEN 'phash' END AS tier FROM n LEFT JOIN t1 USING (sha256) LEFT JOIN t2 USING (pixel_hash) LEFT JOIN t3 USING (ph))"""


def _index(spark, d):
    return B.phashes(spark, d).where(OLD).select(F.col("id").alias("asset_id"), F.concat(F.lit("/f/"), "id").alias("path"), "sha256", "pixel_hash", "phash")


@query(P + "," + LOOKUP + " SELECT id, duplicate_of, tier FROM hit")
def dedup_lookup_tiers(spark, d):
    return dedup.lookup(B.phashes(spark, d).where(NEW), _index(spark, d))


@query(P + "SELECT pixel_hash AS group_key, min(id) AS first, count(*) AS n FROM phashes GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups_exact(spark, d):
    return dedup.exact_groups(B.phashes(spark, d))


@query()
def duplicate_groups_near(spark, d):
    return dedup.near_groups(B.phashes(spark, d))


def _candidates(spark, d):
    """All odd documents under new paths, and every fourth under the path of an indexed one, some with changed bytes."""
    own = B.phashes(spark, d)
    new = own.where(NEW).withColumn("path", F.concat(F.lit("/g/"), "id"))
    known = own.where("id % 4 = 0").withColumn("path", F.concat(F.lit("/f/"), "id")).withColumn("sha256", F.when(F.col("id") % 8 == 0, F.concat("sha256", F.lit("x"))).otherwise(F.col("sha256")))
    return new.unionByName(known).withColumn("skip", F.col("id") % 13 == 0)


@query()
def batch_dedup_plan(spark, d):
    return dedup.batch_plan(_candidates(spark, d), _index(spark, d))


DECIDE = LOOKUP + """, s AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'skipped' WHEN tier IS NOT NULL THEN 'duplicate' ELSE 'indexed' END AS status, tier || '->' || duplicate_of AS t FROM hit
UNION ALL SELECT id, CASE WHEN id % 13 = 0 THEN 'skipped' WHEN id % 8 = 0 THEN 'updated' ELSE 'unchanged' END, NULL FROM phashes WHERE id % 4 = 0)"""


@query(P + "," + DECIDE + " SELECT id, status, CASE WHEN status = 'duplicate' THEN t ELSE '' END AS detail FROM s")
def ingest_decision(spark, d):
    return dedup.ingest_decision(_candidates(spark, d), _index(spark, d))


@query(P + "," + DECIDE + " SELECT status, count(*) AS n FROM s GROUP BY 1")
def ingest_tally(spark, d):
    return reporting.tally(ingest_decision(spark, d))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 1 THEN 'insert' ELSE 'update' END AS action FROM documents WHERE doc_id % 2 = 1 OR doc_id % 4 = 0")
def force_plan(spark, d):
    return dedup.batch_plan(_candidates(spark, d), _index(spark, d), force=True)


# lifecycle


def _versions(spark, d):
    """Customers as assets, their orders as later versions; urgent orders delete."""
    first = B.read(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.lit(0).cast("bigint").alias("version"), F.lit("insert").alias("op"), F.col("c_acctbal").alias("value"))
    later = B.read(spark, d, "orders").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderpriority") == "1-URGENT", "delete").otherwise("update").alias("op"), F.col("o_totalprice").alias("value"))
    return first.unionByName(later)


VERSIONS = "v AS (SELECT c_custkey AS asset_id, 0 AS version, 'insert' AS op, c_acctbal AS value FROM customer UNION ALL SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'delete' ELSE 'update' END, o_totalprice FROM orders), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY version DESC) AS r FROM v) WHERE r = 1 AND op <> 'delete')"


@query("WITH " + VERSIONS + " SELECT asset_id, version, op, value FROM l")
def upsert_latest(spark, d):
    return lifecycle.latest(_versions(spark, d))


@query("SELECT s_suppkey AS asset_id, s_acctbal AS value, 7 AS version, 'insert' AS op, TRUE AS indexed FROM supplier")
def lifecycle_insert(spark, d):
    new = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.col("s_acctbal").alias("value"))
    return lifecycle.insert(new, new, 7)


@query("WITH " + VERSIONS + " SELECT s_suppkey AS asset_id, s_acctbal AS value, 7 AS version, 'update' AS op, TRUE AS indexed FROM supplier WHERE s_suppkey IN (SELECT asset_id FROM l)")
def lifecycle_update(spark, d):
    new = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.col("s_acctbal").alias("value"))
    return lifecycle.update(lifecycle.latest(_versions(spark, d)), new, 7)


@query("WITH " + VERSIONS + " SELECT asset_id, version, value FROM l WHERE asset_id NOT IN (SELECT s_suppkey FROM supplier)")
def lifecycle_delete(spark, d):
    versions = _versions(spark, d)
    ids = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"))
    gone = lifecycle.delete(lifecycle.latest(versions), ids, 10**12).select("asset_id", F.col("version").cast("bigint"), "op", "value")
    return lifecycle.latest(versions.unionByName(gone)).select("asset_id", "version", "value")


@query(A + f", e AS (SELECT asset_id AS id, text AS txt FROM assets WHERE state = 'active' AND NOT indexed), {B.embedded('x', 'e')} SELECT asset_id, TRUE AS indexed, (SELECT count(DISTINCT b) FROM x WHERE x.id = asset_id) AS filled FROM assets WHERE state = 'active' AND NOT indexed")
def recover_rows(spark, d):
    derive = lambda rows: rows.select("asset_id", F.size(F.filter(H.hash_embedding(F.col("text")), lambda x: x != 0)).cast("bigint").alias("filled"))
    fixed, vectors = lifecycle.recover(B.assets(spark, d), derive)
    return fixed.select("asset_id", "indexed").join(vectors, "asset_id")


@query("""WITH own AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'updated ' ELSE '' END || s_name AS text FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 1)
SELECT 'asset' AS kind, id, text FROM own UNION ALL SELECT 'vector', id, NULL FROM own""")
def store_lifecycle(spark, d):
    """Insert, update, delete and insert again in a store on disk; its rows, and the assets of its vectors."""
    derive = lambda rows: rows.select(F.lit("text").alias("space"), F.col("asset_id").alias("vec_id"), "asset_id", H.hash_embedding(F.col("text")).alias("embedding"))
    store = Store(spark, f"{shared_folder(spark)}/archivelake/store-{uuid.uuid4().hex}", derive)
    own = B.read(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.col("s_name").alias("text"))
    store.insert(own)
    store.update(own.where("asset_id % 5 = 0").withColumn("text", F.concat(F.lit("updated "), "text")))
    store.delete(own.where("asset_id % 3 = 0"))
    back = own.where("asset_id % 3 = 0 and asset_id % 2 = 1")
    store.insert(back.withColumn("text", F.when(F.col("asset_id") % 5 == 0, F.concat(F.lit("updated "), "text")).otherwise(F.col("text"))))
    assets = store.assets().select(F.lit("asset").alias("kind"), F.col("asset_id").alias("id"), "text")
    return assets.unionByName(store.vectors().select(F.lit("vector").alias("kind"), F.col("asset_id").alias("id"), F.lit(None).cast("string").alias("text")))


@query("""WITH own AS (SELECT c_custkey AS id, c_name || CASE WHEN c_custkey % 4 = 1 THEN ' late' WHEN c_custkey % 4 = 2 THEN ' twice' ELSE '' END AS text FROM customer WHERE c_custkey % 4 <> 3 AND c_custkey % 10 <> 0)
SELECT 'asset' AS kind, id, text FROM own UNION ALL SELECT 'vector', id, NULL FROM own UNION ALL SELECT 'folder', count(*), NULL FROM (SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)""")
def store_compaction(spark, d):
    """A snapshot during which others insert and delete: nothing is lost, and the replaced folders are removed. Rows, assets of vectors, and the number of folders left."""
    derive = lambda rows: rows.select(F.lit("text").alias("space"), F.col("asset_id").alias("vec_id"), "asset_id", H.hash_embedding(F.col("text")).alias("embedding"))
    path = f"{shared_folder(spark)}/archivelake/store-{uuid.uuid4().hex}"
    store, other = Store(spark, path, derive), Store(spark, path, derive)
    own = B.read(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("text"))
    store.insert(own.where("asset_id % 4 = 0 or asset_id % 4 = 2"))
    store.update(own.where("asset_id % 4 = 2").withColumn("text", F.concat("text", F.lit(" twice"))))

    def meanwhile():
        other.insert(own.where("asset_id % 4 = 1").withColumn("text", F.concat("text", F.lit(" late"))))
        other.delete(own.where("asset_id % 10 = 0"))

    store.compact(meanwhile)
    store.vacuum(0)
    found, rows = store.vectors(), store.assets()
    assets = rows.select(F.lit("asset").alias("kind"), F.col("asset_id").alias("id"), "text")
    none = F.lit(None).cast("string").alias("text")
    left = spark.range(1).select(F.lit("folder").alias("kind"), F.lit(len(store._names("assets"))).cast("bigint").alias("id"), none)
    return assets.unionByName(found.select(F.lit("vector").alias("kind"), F.col("asset_id").alias("id"), none)).unionByName(left)


def _vectors(spark, d):
    return B.read(spark, d, "embeddings").select(F.lit("clip").alias("space"), F.col("vec_id"), F.when(F.col("vec_id") % 17 != 0, F.col("vec_id") * 3).alias("asset_id"))


ORPHANS = "o AS (SELECT vec_id FROM embeddings WHERE (CASE WHEN vec_id % 17 <> 0 THEN vec_id * 3 ELSE vec_id END) NOT IN (SELECT asset_id FROM assets WHERE state = 'active'))"


@query(A + "," + ORPHANS + " SELECT vec_id FROM o")
def orphan_vectors(spark, d):
    return V.orphans(_vectors(spark, d), B.assets(spark, d)).select("vec_id")


@query(A + "," + ORPHANS + " SELECT (SELECT count(*) FROM assets WHERE state = 'deleted') AS tombstones_finished, (SELECT count(*) FROM o) AS orphans_purged")
def reconcile_counts(spark, d):
    return lifecycle.reconcile(B.assets(spark, d), _vectors(spark, d))


@query(A + "SELECT asset_id FROM assets WHERE state = 'active'")
def active_assets(spark, d):
    return B.assets(spark, d).where("state = 'active'").select("asset_id")


@query(A + "SELECT asset_id FROM assets WHERE state = 'active' AND indexed")
def active_indexed_ids(spark, d):
    return B.assets(spark, d).where("state = 'active' and indexed").select("asset_id")


@query(A + "SELECT item_id, path, kind FROM benchmark LEFT JOIN (SELECT * FROM assets WHERE state = 'active') ON asset_id = item_id")
def asset_lookup(spark, d):
    asked = B.read(spark, d, "benchmark").select("item_id")
    live = B.assets(spark, d).where("state = 'active'").select(F.col("asset_id").alias("item_id"), "path", "kind")
    return asked.join(live, "item_id", "left")


@query(A + "SELECT 'assets' AS name, count(*) FILTER (state = 'active') AS n FROM assets UNION ALL SELECT 'clip', count(*) FROM embeddings UNION ALL SELECT 'text', 0 UNION ALL SELECT 'visual', 0")
def index_stats(spark, d):
    return V.stats(B.assets(spark, d), _vectors(spark, d))


@query(A + "SELECT asset_id, path, kind, CASE WHEN caption = '' THEN 'PDF' ELSE caption END AS caption, has_text FROM assets WHERE state = 'active' AND indexed ORDER BY asset_id % 60 DESC, asset_id LIMIT 100 OFFSET 20")
def library_listing(spark, d):
    rows = B.assets(spark, d).withColumn("updated_at", F.timestamp_seconds(F.col("asset_id") % 60))
    return lifecycle.listing(rows, 100, 20).select("asset_id", "path", "kind", F.coalesce(F.nullif("caption", F.lit("")), F.lit("PDF")).alias("caption"), "has_text")


# reports

STAGE = "CASE event_type WHEN 'click' THEN 'extract' WHEN 'view' THEN 'vlm' WHEN 'purchase' THEN 'finalize' ELSE event_type END"


@query(f"SELECT s.stage, count(value) AS n, coalesce(round(1000 * avg(value), 2), 0) AS avg_ms, coalesce(round(sum(value), 3), 0) AS total_s FROM (SELECT unnest(['extract','vlm','finalize','write']) AS stage) s LEFT JOIN (SELECT {STAGE} AS stage, value FROM events) e USING (stage) GROUP BY 1")
def stage_timings(spark, d):
    stage = F.expr(STAGE)
    return reporting.stage_timings(B.read(spark, d, "events").select(stage.alias("stage"), F.col("value").alias("seconds")))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """The windowed count of the file stream, over a whole table."""
    return watch.windowed_counts(B.read(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("SELECT event_type, count(*) AS n, round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) ELSE 0 END, 3) AS per_s FROM events GROUP BY 1")
def throughput(spark, d):
    rows = B.read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("wall"))
    return rows.select("event_type", "n", reporting.throughput(F.col("n"), F.col("wall")).alias("per_s"))
