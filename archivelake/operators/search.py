"""Searches: fuse, validate against live assets, filter, cut to the pool, limit. Filters stay above the top-k on purpose."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval as R


def pool_size(limit: int) -> int:
    return max(3 * limit, 20)


def assemble(fused: DataFrame, assets: DataFrame, limit: int = 10, kind: str | None = None, with_text: bool | None = None, label: str | None = None) -> DataFrame:
    """Ranked results of live assets (asset_id, state, kind, has_text, labels): rows (query_id, rank, entity, score).

    ``fused`` has query_id, entity, asset_id and score. Order: validation, filters, pool, limit.
    """
    return pooled(fused.join(assets.where("state = 'active'"), "asset_id"), limit, kind, with_text, label).where(F.col("rank") <= limit)


def pooled(rows: DataFrame, limit: int, kind: str | None = None, with_text: bool | None = None, label: str | None = None) -> DataFrame:
    """Valid rows (query_id, entity, score, kind, has_text, labels) through the filters, then the best of each query up to the pool's size."""
    if kind in ("image", "pdf"):
        rows = rows.where(F.col("kind") == kind)
    if with_text:
        rows = rows.where("has_text")
    if label and label.strip():
        rows = rows.where(F.array_contains(F.transform("labels", F.lower), label.strip().lower()))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool_size(limit))


def doc_labels():
    """Labels of an asset and of all regions of its pages."""
    regions = F.flatten(F.transform("pages", lambda p: F.flatten(F.transform(p["regions"], lambda r: F.transform(r["objects"], lambda o: o["label"])))))
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(F.transform("objects", lambda o: o["label"]), none), F.coalesce(regions, none))


def facts(assets: DataFrame, with_text: bool | None = None, label: str | None = None) -> DataFrame:
    """What the filters in force ask of live assets, in narrow columns: kind, and only where it is asked for labels, or which pages hold text. Nested pages stay behind."""
    own = [F.col("asset_id"), F.coalesce("kind", F.lit("image")).alias("kind")]
    if label and label.strip():
        own.append(doc_labels().alias("labels"))
    if with_text:
        own += [F.coalesce("ocr.has_text", F.lit(False)).alias("_own"), F.transform("pages", lambda p: F.struct(p["page_index"].alias("at"), (~T.is_blank(p["text"])).alias("text"))).alias("_texts")]
    return assets.where("state = 'active'").select(*own)


def drawn(hits: DataFrame, assets: DataFrame, limit: int, kind: str | None = None, with_text: bool | None = None, label: str | None = None) -> DataFrame:
    """Hits (query_id, entity, score, asset_id, page_index, ...) on live assets through the filters, cut to the pool; their contents are fetched afterwards."""
    rows = hits.join(facts(assets, with_text, label), "asset_id")
    is_page = F.col("page_index").isNotNull()
    rows = rows.withColumn("kind", F.when(is_page, "pdf").otherwise(F.col("kind")))
    if with_text:
        rows = rows.withColumn("has_text", F.when(is_page, F.coalesce(F.exists("_texts", lambda t: (t["at"] == F.col("page_index")) & t["text"]), F.lit(False))).otherwise(F.col("_own")))
    return pooled(rows, limit, kind, with_text, label).select(*hits.columns, "rank")


def described(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """Hits (asset_id, page_index, ...) on live nested assets, with what a result shows and what filters and re-ranking need:
    path, page, kind, caption, objects, labels, has_text and text."""
    live = assets.where("state = 'active'")
    rows = hits.join(live.select("asset_id", "path", F.coalesce("kind", F.lit("image")).alias("kind"), "scene", "objects", "ocr", "pages", doc_labels().alias("labels")), "asset_id")
    page = F.try_element_at(F.filter("pages", lambda p: p["page_index"] == F.col("page_index")), F.lit(1))
    rows = rows.withColumn("_p", page)
    empty = lambda c: F.coalesce(c, F.lit(""))
    names = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    captions = names(F.transform(F.col("_p.regions"), lambda r: empty(r["scene"]["caption"])))
    found = names(F.flatten(F.transform(F.col("_p.regions"), lambda r: F.transform(r["objects"], lambda o: o["label"]))))
    own = names(F.transform("objects", lambda o: o["label"]))
    is_page, text = F.col("page_index").isNotNull(), empty(F.col("_p.text"))
    number = F.concat(F.lit("page "), F.col("page_index") + 1)
    caption = F.coalesce(F.nullif(F.substring(text, 1, 120), F.lit("")), F.try_element_at(F.filter(captions, lambda c: c != ""), F.lit(1)), number)
    joined = lambda *parts: T.strip(F.array_join(F.array(*parts), " "))
    page_text = T.strip(F.array_join(F.concat(F.array(text), captions, F.array(F.array_join(found, " "))), " "))
    image_text = joined(empty(F.col("scene.caption")), F.array_join(names(F.col("scene.tags")), " "), F.array_join(own, " "), empty(F.col("ocr.full_text")))
    return rows.select(
        *hits.columns, "path", F.col("page_index").alias("page"), F.when(is_page, "pdf").otherwise(F.col("kind")).alias("kind"), F.when(is_page, caption).otherwise(empty(F.col("scene.caption"))).alias("caption"),
        F.when(is_page, found).otherwise(own).alias("objects"), "labels", F.when(is_page, ~T.is_blank(text)).otherwise(F.coalesce(F.col("ocr.has_text"), F.lit(False))).alias("has_text"),
        F.when(is_page, page_text).otherwise(image_text).alias("text"),
    )


def ranked_entities(asked: DataFrame, vectors: DataFrame, top_k: int = R.TOP_K) -> DataFrame:
    """(query_id, source, entity, rank, asset_id, page_index): the best rank of each image or page in each space."""
    near = R.knn(asked, vectors, top_k)
    held = vectors.select("space", "vec_id", "asset_id", "page_index")
    rows = near.join(held, ["space", "vec_id"]).withColumnRenamed("space", "source")
    entity = F.when(F.col("page_index").isNull(), F.col("asset_id")).otherwise(F.concat("asset_id", F.lit("#p"), "page_index"))
    return rows.groupBy("query_id", "source", entity.alias("entity"), "asset_id", "page_index").agg(F.min("rank").alias("rank"))


def results(ranks: DataFrame, assets: DataFrame, queries: DataFrame | None = None, limit: int = 10, top_k: int = R.TOP_K, rerank=None, gap: float | None = None, **filters) -> DataFrame:
    """Rank lists to result rows: query_id, rank, id, path, page, kind, score, caption, objects, matched, reranked.

    Fuse, validate against live assets, filter, cut to the pool; then, if ``rerank`` is given (pool with query and text -> pool with a new
    ``rank``) and a pool has two rows or more and its gap is below ``gap`` (always, if that is None), order the pool anew and blend in
    the rank of the clip space; then limit. The score stays that of the fusion.
    """
    fused = R.fuse(ranks, top_k)
    by_source = ranks.groupBy("query_id", "entity").agg(
        F.first("asset_id").alias("asset_id"), F.first("page_index").alias("page_index"), F.min(F.when(F.col("source") == "clip", F.col("rank"))).alias("clip_rank"), F.collect_set("source").alias("sources")
    )
    hits = fused.join(by_source, ["query_id", "entity"])
    pool = described(drawn(hits, assets, limit, **filters), assets).withColumnRenamed("rank", "position")
    matched = F.array_join(F.filter(F.array(*map(F.lit, ("visual", "text", "clip"))), lambda s: F.array_contains("sources", s)), ",")
    pool = pool.withColumn("matched", matched)
    if rerank is None:
        out = pool.withColumn("rank", F.col("position")).withColumn("reranked", F.lit(False))
    else:
        every = Window.partitionBy("query_id")
        best = lambda n: F.max(F.when(F.col("position") == n, F.col("score"))).over(every)
        close = F.lit(True) if gap is None else F.when(best(1) > 0, (best(1) - best(2)) / best(1)).otherwise(1.0) < gap
        pool = pool.withColumn("reranked", best(2).isNotNull() & close).withColumn("_clip", F.max(F.col("clip_rank").isNotNull()).over(every))
        named = pool.join(queries.select("query_id", F.col("text").alias("query")), "query_id").where("reranked")
        again = rerank(named)
        blended = R.clip_blend(again.withColumn("position", F.col("rank")), top_k=top_k)
        order = blended.select("query_id", "entity", F.when(F.col("_clip"), F.col("rank")).otherwise(F.col("position")).alias("_new"))
        out = pool.join(order, ["query_id", "entity"], "left").withColumn("rank", F.coalesce("_new", "position"))
    return out.where(F.col("rank") <= limit).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("entity").alias("id"), "path", "page", "kind", "score", "caption", "objects", "matched", "reranked")


def text_search(queries: DataFrame, vectors: DataFrame, assets: DataFrame, embed, limit: int = 10, embed_clip=None, rerank=None, gap: float | None = None, **filters) -> DataFrame:
    """Queries (query_id, text) against the spaces of ``vectors`` (space, vec_id, asset_id, page_index, embedding); blank queries give nothing.

    ``embed`` makes the vector for the visual and text spaces, ``embed_clip`` the one for clip, which is left out without it. ``assets`` are nested ones."""
    asked = queries.where(~T.is_blank(F.col("text"))).withColumn("embedding", embed(F.col("text")))
    own = asked.select("query_id", "embedding", F.explode(F.array(F.lit("visual"), F.lit("text"))).alias("space"))
    if embed_clip is not None:
        own = own.unionByName(asked.select("query_id", embed_clip(F.col("text")).alias("embedding"), F.lit("clip").alias("space")))
    return results(ranked_entities(own, vectors), assets, queries, limit, rerank=rerank, gap=gap, **filters)


def image_search(queries: DataFrame, vectors: DataFrame, assets: DataFrame, limit: int = 20, **filters) -> DataFrame:
    """Queries (query_id, embedding) against the clip space only, never re-ranked."""
    return results(ranked_entities(queries.select("query_id", "embedding", F.lit("clip").alias("space")), vectors.where("space = 'clip'")), assets, limit=limit, **filters)


def similar(vectors: DataFrame, asset_ids: DataFrame, assets: DataFrame, limit: int = 12) -> DataFrame:
    """More like this: limit + 1 nearest by the stored vector, without any entity of the asset itself."""
    asked = vectors.join(asset_ids.select(F.col("asset_id")), "asset_id", "left_semi").select(F.col("asset_id").cast("bigint").alias("query_id"), "space", "embedding")
    near = R.knn(asked, vectors, limit + 1).join(vectors.select("space", "vec_id", "asset_id"), ["space", "vec_id"])
    near = near.where(F.col("query_id") != F.col("asset_id").cast("bigint")).join(assets.where("state = 'active'").select("asset_id"), "asset_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def page_results(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Caption of a page hit: its first 120 characters, else its first region caption, else its number."""
    joined = hits.join(pages, ["asset_id", "page_index"], "left")
    caption = F.coalesce(
        F.nullif(F.substring(F.coalesce("page_text", F.lit("")), 1, 120), F.lit("")),
        F.try_element_at(F.filter("region_captions", lambda c: c != ""), F.lit(1)),
        F.concat(F.lit("page "), F.col("page_index") + 1),
    )
    return joined.withColumn("caption", caption)


def agent_rows(found: DataFrame) -> DataFrame:
    """The six fields that an agent is given."""
    return found.select("query_id", "rank", "id", "kind", "page", "caption", "score", "matched")


NOTHING = "(no matching items)"
UNAVAILABLE = "The answering model is unavailable; these are the sources."


def ask(found: DataFrame, texts: DataFrame, queries: DataFrame, model=None, top: int = 5) -> DataFrame:
    """(query_id, answer, context, sources): a model's answer from the best results of each query; one without results is asked with a note in their place.

    ``found`` are result rows, ``texts`` (id, text) their full texts. ``model()`` is loaded once per Python worker and maps (question, context)
    to an answer; if it is missing, can't be loaded or fails, the answer says so and the sources stand.
    """
    hits = found.where(F.col("rank") <= top).join(texts, "id", "left").withColumn("page_index", F.col("page")).withColumn("labels", F.col("objects"))
    sources = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("sources"))
    rows = queries.select("query_id", F.col("text").alias("question")).join(rag_context(hits.withColumn("text", F.coalesce("text", F.lit("")))), "query_id", "left").join(sources, "query_id", "left")
    rows = rows.withColumns({"context": F.coalesce("context", F.lit(NOTHING)), "sources": F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType))})
    if model is None:
        return rows.select("query_id", F.lit(UNAVAILABLE).alias("answer"), "context", "sources")

    @F.pandas_udf("string")
    def answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            own = model()
        except Exception:  # noqa: BLE001 - any failure means no model
            own = None
        for questions, contexts in batches:
            out = []
            for q, c in zip(questions, contexts, strict=True):
                try:
                    out.append(own(q, c) if own else UNAVAILABLE)
                except Exception:  # noqa: BLE001
                    out.append(UNAVAILABLE)
            yield pd.Series(out, dtype=object)

    return rows.select("query_id", answer("question", "context").alias("answer"), "context", "sources")


def rag_context(hits: DataFrame) -> DataFrame:
    """One context text per query from (query_id, rank, path, page_index, caption, labels, text)."""
    line = F.concat(
        F.lit("["), F.col("rank"), F.lit("] "), T.basename(F.col("path")), F.coalesce(F.concat(F.lit(" p"), F.col("page_index") + 1), F.lit("")), F.lit(": "),
        F.col("caption"), F.lit(" "), F.array_join("labels", ", "), F.lit(" "), F.substring("text", 1, 300),
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return hits.groupBy("query_id").agg(F.array_join(lines, "\n").alias("context"))
