"""The model's tables as views of the test tables, in DataFrames and in the same words in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


EXT = ("JPG", "txt", "png", "PDF", "gif", "webp")


def assets(spark: SparkSession, d: str) -> DataFrame:
    """Documents as assets: the first line is the caption, source and language are labels."""
    rows = read(spark, d, "documents")
    caption = F.substring(F.substring_index("text", "\n", 1), 1, 300)
    return rows.select(
        F.col("doc_id").alias("asset_id"), "text", "source", "lang", caption.alias("caption"), F.array("source", "lang").alias("labels"),
        F.concat(F.lit("/lake/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.get(F.array(*map(F.lit, EXT)), (F.col("doc_id") % 6).cast("int"))).alias("path"),
        F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("image").alias("kind"),
        F.when(F.col("doc_id") % 11 == 0, "deleted").otherwise("active").alias("state"),
        (F.col("doc_id") % 7 != 0).alias("indexed"),
        F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("sha256"),
        (F.length(T.strip(F.col("text"))) > 0).alias("has_text"),
    )


ASSETS = """assets AS (
  SELECT doc_id AS asset_id, text, source, lang, substr(split_part(text, chr(10), 1), 1, 300) AS caption, [source, lang] AS labels,
    '/lake/' || source || '/' || doc_id || '.' || ['JPG','txt','png','PDF','gif','webp'][doc_id % 6 + 1] AS path,
    CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'image' END AS kind, CASE WHEN doc_id % 11 = 0 THEN 'deleted' ELSE 'active' END AS state,
    doc_id % 7 <> 0 AS indexed, 'sha256:' || sha256(text) AS sha256, length(trim(text)) > 0 AS has_text
  FROM documents)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Text and visual vectors of all assets by the hash embedder."""
    own = assets(spark, d)
    visual = T.visual_input(F.col("caption"), F.col("labels"), no_labels())
    both = [own.select(F.lit(s).alias("space"), F.col("asset_id").alias("vec_id"), "asset_id", F.col("asset_id").alias("entity"), H.hash_embedding(x).alias("embedding")) for s, x in (("text", F.col("text")), ("visual", visual))]
    return both[0].unionByName(both[1])


def no_labels():
    return F.array().cast("array<string>")


def lake(spark: SparkSession, d: str) -> DataFrame:
    """Nested assets: documents as images, conversations as paged files whose even turns hold a region."""
    rows = read(spark, d, "documents")
    label = lambda c: F.struct(c.alias("label"))
    images = rows.select(
        F.concat(F.lit("d"), "doc_id").alias("asset_id"), F.concat(F.lit("/lake/d"), "doc_id", F.lit(".png")).alias("path"), F.lit("image").alias("kind"),
        F.when(F.col("doc_id") % 11 == 0, "deleted").otherwise("active").alias("state"), F.array(label(F.col("lang"))).alias("objects"),
        F.struct(F.substring(F.substring_index("text", "\n", 1), 1, 300).alias("caption"), F.array("source").alias("tags")).alias("scene"),
        F.struct(F.col("text").alias("full_text"), (F.length(T.strip(F.col("text"))) > 0).alias("has_text")).alias("ocr"),
    )
    region = F.struct(F.struct(F.col("role").alias("caption")).alias("scene"), F.array(label(F.col("role"))).alias("objects"))
    page = F.struct(F.col("turn").cast("int").alias("page_index"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("text"), F.when(F.col("turn") % 2 == 0, F.array(region)).otherwise(F.filter(F.array(region), lambda _: F.lit(False))).alias("regions"))
    files = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    files = files.select(
        F.concat(F.lit("c"), "conv_id").alias("asset_id"), F.concat(F.lit("/lake/c"), "conv_id", F.lit(".pdf")).alias("path"), F.lit("pdf").alias("kind"),
        F.when(F.col("conv_id") % 11 == 0, "deleted").otherwise("active").alias("state"), "pages",
    )
    return images.unionByName(files, allowMissingColumns=True)


def lake_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of ``lake``: texts of images and pages, and the visual inputs of images and regions."""
    own = lake(spark, d)
    none = F.lit(None).cast("int")
    images = own.where("kind = 'image'").select("asset_id", F.inline(F.array(
        F.struct(F.lit("text").alias("space"), F.col("ocr.full_text").alias("txt")),
        F.struct(F.lit("visual").alias("space"), T.visual_input(F.col("scene.caption"), F.col("scene.tags"), F.transform("objects", lambda o: o["label"])).alias("txt")),
    ))).select("space", F.col("asset_id").alias("vec_id"), "asset_id", none.alias("page_index"), "txt")
    pages = own.where("kind = 'pdf'").select("asset_id", F.explode("pages").alias("p")).withColumn("page_id", F.concat("asset_id", F.lit("#p"), "p.page_index"))
    texts = pages.select(F.lit("text").alias("space"), F.col("page_id").alias("vec_id"), "asset_id", "p.page_index", F.col("p.text").alias("txt"))
    regions = pages.select("asset_id", "page_id", "p.page_index", F.posexplode("p.regions").alias("region_index", "r"))
    visual = T.visual_input(F.col("r.scene.caption"), no_labels(), F.transform("r.objects", lambda o: o["label"]))
    regions = regions.select(F.lit("visual").alias("space"), F.concat("page_id", F.lit("#r"), "region_index").alias("vec_id"), "asset_id", "page_index", visual.alias("txt"))
    every = images.unionByName(texts).unionByName(regions)
    return every.select("space", "vec_id", "asset_id", "page_index", H.hash_embedding(F.col("txt")).alias("embedding"))


def embedded(name: str, source: str) -> str:
    """CTEs of sparse unit vectors name(id, b, x) from source(id, txt)."""
    return f"""{name}_t AS (SELECT id, unnest(list_filter(string_split_regex(lower(txt), '\\s+'), lambda x: x <> '')) AS t FROM {source}),
{name}_b AS (SELECT id, CAST('0x' || right(sha256(t), 2) AS INTEGER) % 64 AS b, count(*) AS c FROM {name}_t GROUP BY 1, 2),
{name}_n AS (SELECT id, sqrt(sum(c * c)) AS n FROM {name}_b GROUP BY 1),
{name} AS (SELECT id, b, c / n AS x FROM {name}_b JOIN {name}_n USING (id))"""


def ranked(name: str, queries: str, corpus: str, k: int = 50) -> str:
    """CTE of the k most similar corpus vectors per query."""
    return f"""{name}_s AS (SELECT q.id AS query_id, c.id AS entity, round(sum(q.x * c.x), 6) AS sim FROM {queries} q JOIN {corpus} c USING (b) GROUP BY 1, 2),
{name}_z AS (SELECT query_id, entity, sim FROM {name}_s UNION ALL
  SELECT q.id, c.id, 0.0 FROM (SELECT DISTINCT id FROM {queries}) q, (SELECT DISTINCT id FROM {corpus}) c WHERE NOT EXISTS (SELECT 1 FROM {name}_s s WHERE s.query_id = q.id AND s.entity = c.id)),
{name} AS (SELECT * FROM (SELECT query_id, entity, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, entity) AS rank FROM {name}_z) WHERE rank <= {k})"""


FUSED = """ranks AS (SELECT 'text' AS source, query_id, entity, rank FROM rt UNION ALL SELECT 'visual', query_id, entity, rank FROM rv),
every AS (SELECT query_id, count(DISTINCT source) AS n FROM ranks GROUP BY 1),
fused AS (SELECT query_id, entity, round(sum(1.0::DOUBLE / (60 + rank)) + (any_value(n) - count(*)) / 111.0::DOUBLE, 6) AS score FROM ranks JOIN every USING (query_id) GROUP BY 1, 2)"""


def search_ctes() -> str:
    return ",\n".join(
        [
            ASSETS, "dt AS (SELECT asset_id AS id, text AS txt FROM assets)", "dv AS (SELECT asset_id AS id, array_to_string(list_filter([caption, source, lang], lambda x: x <> ''), ' ') AS txt FROM assets)",
            "bq AS (SELECT item_id AS id, text AS txt FROM benchmark)", embedded("et", "dt"), embedded("ev", "dv"), embedded("eq", "bq"), ranked("rt", "eq", "et"), ranked("rv", "eq", "ev"), FUSED,
        ]
    )


def lake_ctes() -> str:
    """CTEs of ``lake``: ents (live images and pages), ranks per space and fused."""
    return ",\n".join(
        [
            """pg AS (SELECT 'c' || conv_id AS asset, 'c' || conv_id || '#p' || turn AS id, turn, role, conv_id, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS txt FROM conversations)""",
            """ents AS (SELECT 'd' || doc_id AS entity, '/lake/d' || doc_id || '.png' AS path, CAST(NULL AS INTEGER) AS page, 'image' AS kind, substr(split_part(text, chr(10), 1), 1, 300) AS caption, lang AS objects, [lang] AS labels,
  length(trim(text)) > 0 AS has_text, substr(split_part(text, chr(10), 1), 1, 300) || ' ' || source || ' ' || lang || ' ' || text AS ce FROM documents WHERE doc_id % 11 <> 0
UNION ALL SELECT id, '/lake/' || asset || '.pdf', CAST(turn AS INTEGER), 'pdf', CASE WHEN txt <> '' THEN substr(txt, 1, 120) WHEN turn % 2 = 0 THEN role ELSE 'page ' || (turn + 1) END, CASE WHEN turn % 2 = 0 THEN role ELSE '' END,
  list(role) FILTER (turn % 2 = 0) OVER (PARTITION BY conv_id), length(trim(txt)) > 0, txt || CASE WHEN turn % 2 = 0 THEN ' ' || role || ' ' || role ELSE '' END FROM pg WHERE conv_id % 11 <> 0)""",
            "dt AS (SELECT 'd' || doc_id AS id, text AS txt FROM documents UNION ALL SELECT id, txt FROM pg)",
            "dv AS (SELECT 'd' || doc_id AS id, array_to_string(list_filter([substr(split_part(text, chr(10), 1), 1, 300), source, lang], lambda x: x <> ''), ' ') AS txt FROM documents UNION ALL SELECT id || '#r0', role || ' ' || role FROM pg WHERE turn % 2 = 0)",
            "bq AS (SELECT item_id AS id, text AS txt FROM benchmark)", embedded("et", "dt"), embedded("ev", "dv"), embedded("eq", "bq"), ranked("rt", "eq", "et"), ranked("rv", "eq", "ev"),
            """ranks AS (SELECT 'text' AS source, query_id, entity, rank FROM rt UNION ALL SELECT 'visual', query_id, replace(entity, '#r0', ''), rank FROM rv)""",
            FUSED.split("\n", 1)[1],
            """hits AS (SELECT f.query_id, f.entity, f.score, path, page, kind, caption, objects, labels, has_text, ce, CASE WHEN n = 2 THEN 'visual,text' ELSE src END AS matched
  FROM fused f JOIN ents USING (entity) JOIN (SELECT query_id, entity, count(*) AS n, any_value(source) AS src FROM ranks GROUP BY 1, 2) USING (query_id, entity))""",
        ]
    )


def texts_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks per space of all benchmark items over all assets."""
    from ..operators import retrieval as R

    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), H.hash_embedding(F.col("text")).alias("embedding"))
    asked = asked.withColumn("space", F.explode(F.array(F.lit("text"), F.lit("visual"))))
    near = R.knn(asked, vectors(spark, d))
    return near.select("query_id", F.col("space").alias("source"), F.col("vec_id").alias("entity"), "rank", "sim")


def phashes(spark: SparkSession, d: str) -> DataFrame:
    """A 64-bit hash per document: whether a token bucket holds more than the next one."""
    v = H.hash_embedding(F.col("text"))
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get("v", i) > F.get("v", (i + 1) % 64), "1").otherwise("0")), "")
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text", v.alias("v")).withColumn("bits", bits)
    return rows.select("id", "source", F.conv("bits", 2, -10).cast("bigint").alias("phash"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("sha256"), F.concat(F.lit("px:"), F.sha2(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), 256)).alias("pixel_hash"))


PHASHES = (
    "hd AS (SELECT doc_id AS id, text AS txt FROM documents),\n"
    + embedded("he", "hd")
    + """,
hl AS (SELECT i.id, list(coalesce(c, 0) ORDER BY i.b) AS c FROM (SELECT id, unnest(range(64)) AS b FROM hd) i LEFT JOIN he_b USING (id, b) GROUP BY 1),
phashes AS (SELECT hl.id, source, list_sum(list_transform(range(64), lambda i: CASE WHEN c[i + 1] > c[(i + 1) % 64 + 1] THEN (1::HUGEINT << (63 - i)::INTEGER) ELSE 0::HUGEINT END))::HUGEINT AS ph,
  'sha256:' || sha256(text) AS sha256, 'px:' || sha256(lower(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS pixel_hash
  FROM hl JOIN documents d ON d.doc_id = hl.id)"""
)
