"""Index engine: scalar rules, fusion, duplicates, lifecycle, sources and streams on small inputs."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivelake import cli, models, schema
from archivelake.archive import Archive
from archivelake.functions import hashing as H
from archivelake.functions import text as T
from archivelake.operators import dedup, lifecycle, records, reporting, search
from archivelake.operators import retrieval as R
from archivelake.operators import vectors as V
from archivelake.sources import scan
from archivelake.sources.store import Store
from archivelake.streaming import watch


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalar_rules(spark):
    cases = {(200, 0): "born_digital_text", (200, 1): "mixed", (5, 1): "scanned", (5, 3): "figure", (0, 0): "born_digital_text", (40, 0): "born_digital_text", (39, 1): "scanned"}
    assert one(spark, *[T.page_type(F.lit(a), F.lit(b)) for a, b in cases]) == tuple(cases.values())
    ramp = F.array(*[F.lit(72 - i) for i in range(72)])
    assert one(spark, H.bits_to_hex(H.dhash_bits(ramp)), H.bits_to_hex(H.dhash_bits(F.reverse(ramp)))) == ("f" * 16, "0" * 16)
    assert one(spark, H.hamming(F.lit("f" * 16), F.lit("0" * 15 + "1")), H.hamming(F.lit(""), F.lit("0" * 16))) == (63, 64)
    assert one(spark, H.seed_of(F.lit("a.png")), H.stub_labels(F.lit("docs/c.pdf"))) == (2131169845, ["person"])
    assert one(spark, reporting.workers(F.lit(12288), F.lit(64)), reporting.workers(F.lit(100), F.lit(8))) == (7, 1)
    v = one(spark, H.hash_embedding(F.lit("madrid metro timetable")), H.hash_embedding(F.lit(" \n")))
    assert [i for i, x in enumerate(v[0]) if x] == [33, 62, 63] and not any(v[1])
    r = one(spark, T.parse_response(F.lit("x\nCaption: A dog\ntags: dog; park , ")), T.parse_response(F.lit("\n A red car on the street \n")))
    assert tuple(r[0]) == ("A dog", ["dog", "park"]) and tuple(r[1]) == ("A red car on the street", ["red", "car", "street"])
    assert one(spark, T.entity(F.lit("d#p3#r1")), T.entity(F.lit("d"))) == (("d#p3", "d", 3), ("d", "d", None))


def fused(spark, ranks, **options):
    rows = [(1, s, e, r) for s, own in ranks.items() for e, r in own.items()]
    return {r["entity"]: r["score"] for r in R.fuse(spark.createDataFrame(rows, "query_id bigint, source string, entity string, rank int"), **options).collect()}


def test_fusion_golden_values(spark):
    drone = {"visual": {"drone": 1, "dual": 2}, "text": {"dual": 50}}
    assert fused(spark, {"visual": {"a": 1, "b": 2}, "text": {"b": 1, "a": 3}}) == pytest.approx({"b": 0.032522, "a": 0.032266}, abs=2e-6)
    assert fused(spark, drone) == pytest.approx({"drone": 0.025402, "dual": 0.025220}, abs=2e-6)
    assert fused(spark, drone, absentee=False) == pytest.approx({"dual": 0.025220, "drone": 0.016393}, abs=2e-6)


def test_gate(spark):
    lists = {1: [0.9, 0.1], 2: [0.5, 0.495], 3: [0.9], 4: [0.5, 0.45]}
    df = spark.createDataFrame([(q, i + 1, s) for q, v in lists.items() for i, s in enumerate(v)], "query_id bigint, rank int, score double")
    assert {r["query_id"]: r["rerank"] for r in R.gap(df).collect()} == {1: False, 2: True, 3: False, 4: False}
    assert {r["query_id"]: r["rerank"] for r in R.gap(df, 0.3).collect()}[4]


def test_filters_come_after_validation_and_before_the_pool(spark):
    f = spark.createDataFrame([(1, f"e{i:02}", f"e{i:02}", 1 - i / 100) for i in range(40)], "query_id bigint, entity string, asset_id string, score double")
    a = spark.createDataFrame([(f"e{i:02}", "deleted" if i == 0 else "active", "pdf" if i % 2 else "image", i % 3 == 0, ["Dog"]) for i in range(40)], "asset_id string, state string, kind string, has_text boolean, labels array<string>")
    top = lambda **k: [r["entity"] for r in search.assemble(f, a, 3, **k).orderBy("rank").collect()]
    assert top() == ["e01", "e02", "e03"] and top(kind="image") == ["e02", "e04", "e06"] and top(kind="other") == ["e01", "e02", "e03"]
    assert top(with_text=True) == ["e03", "e06", "e09"] and top(label=" dOG ") == ["e01", "e02", "e03"] and top(label="cat") == []


def test_band_join_finds_every_near_pair(spark):
    r = random.Random(2)
    hashes = [r.getrandbits(64) for _ in range(40)]
    for _ in range(120):
        h = r.choice(hashes)
        for b in r.sample(range(64), r.randint(0, 11)):
            h ^= 1 << b
        hashes.append(h)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    got = {(x["a"], x["b"]): x["distance"] for x in dedup.near_pairs(spark.createDataFrame(list(enumerate(signed)), "id bigint, phash bigint")).collect()}
    want = {(i, j): d for j in range(len(hashes)) for i in range(j) if (d := (hashes[i] ^ hashes[j]).bit_count()) <= 10}
    assert got == want


def nested(spark, rows):
    """Nested assets from (asset_id, state, caption, text, labels, pages of (index, text, region captions))."""
    kind = "asset_id string, path string, kind string, state string, scene struct<caption:string,tags:array<string>>, objects array<struct<label:string>>, ocr struct<full_text:string,has_text:boolean>,"
    kind += " pages array<struct<page_index:int,text:string,regions:array<struct<scene:struct<caption:string>,objects:array<struct<label:string>>>>>>"
    made = []
    for asset, state, caption, text, labels, pages in rows:
        own = [(i, t, [((c,), [(c.upper(),)]) for c in caps]) for i, t, caps in pages] if pages else None
        made.append((asset, f"/x/{asset}", "pdf" if pages else "image", state, (caption, ["tag"]), [(x,) for x in labels], (text, bool(text)), own))
    return spark.createDataFrame(made, kind)


def ranks_of(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, source string, entity string, rank int, asset_id string, page_index int")


def test_result_rows_of_images_and_pages(spark):
    assets = nested(spark, [("a", "active", "a cat", "on a mat", ["Cat"], None), ("p", "active", "", "", [], [(0, "", ["chart"]), (1, "words " * 40, []), (2, " ", [])]), ("gone", "deleted", "x", "y", [], None)])
    ranks = ranks_of(spark, [(1, "text", "p#p1", 1, "p", 1), (1, "text", "gone", 2, "gone", None), (1, "visual", "a", 1, "a", None), (1, "text", "a", 3, "a", None), (1, "visual", "p#p0", 2, "p", 0), (1, "text", "p#p2", 9, "p", 2)])
    top = lambda **k: {r["id"]: r for r in search.results(ranks, assets, **k).collect()}
    got = top()
    assert set(got) == {"a", "p#p0", "p#p1", "p#p2"} and got["a"]["matched"] == "visual,text" and got["p#p1"]["matched"] == "text"
    assert [got[i]["caption"] for i in ("a", "p#p0", "p#p1", "p#p2")] == ["a cat", "chart", ("words " * 40)[:120], " "]
    assert (got["p#p0"]["page"], got["p#p0"]["kind"], got["p#p0"]["path"], got["p#p0"]["objects"]) == (0, "pdf", "/x/p", ["CHART"]) and got["a"]["objects"] == ["Cat"]
    assert got["a"]["rank"] == 1 and not got["a"]["reranked"]
    assert set(top(with_text=True)) == {"a", "p#p1"} and set(top(kind="pdf")) == {"p#p0", "p#p1", "p#p2"}
    assert set(top(label="chart")) == {"p#p0", "p#p1", "p#p2"} and set(top(label="cat ")) == {"a"} and top(label="dog") == {}


def test_rerank_reorders_the_pool_across_the_limit(spark):
    assets = nested(spark, [(f"i{n:02}", "active", f"thing {'wanted words' if n == 15 else ''}", "", [], None) for n in range(25)])
    ranks = ranks_of(spark, [(1, "text", f"i{n:02}", n + 1, f"i{n:02}", None) for n in range(25)])
    asked = spark.createDataFrame([(1, "wanted words")], "query_id bigint, text string")
    go = lambda **k: [(r["id"], r["reranked"]) for r in search.results(ranks, assets, asked, 3, **k).orderBy("rank").collect()]
    assert go() == [("i00", False), ("i01", False), ("i02", False)]
    assert go(rerank=R.lexical_rerank) == [("i15", True), ("i00", True), ("i01", True)]
    assert go(rerank=R.lexical_rerank, gap=1e-9) == go() and go(rerank=R.lexical_rerank, gap=0.5)[0] == ("i15", True)
    scorer = lambda: lambda pairs: [1.0 if "thing" in t and i == 2 else 0.0 for i, (q, t) in enumerate(pairs)]
    again = go(rerank=lambda pool: R.neural_rerank(pool.coalesce(1), scorer))
    assert len(again) == 3 and all(x[1] for x in again)
    clip = ranks.unionByName(ranks_of(spark, [(1, "clip", "i02", 1, "i02", None)]))
    blended = [r["id"] for r in search.results(clip, assets, asked, 3, rerank=R.lexical_rerank).orderBy("rank").collect()]
    assert blended[:2] == ["i02", "i15"]  # 2 / 62 + 1 / 61 beats 2 / 61 + 1 / 111


def test_text_search_end_to_end(spark):
    assets = nested(spark, [("a", "active", "madrid metro", "", [], None), ("b", "active", "", "madrid metro timetable", [], None), ("p", "active", "", "", [], [(0, "warehouse safety", []), (1, "madrid metro timetable", [])])])
    rows = [("visual", "a", "a", None, "madrid metro"), ("text", "b", "b", None, "madrid metro timetable"), ("text", "p#p0", "p", 0, "warehouse safety"), ("text", "p#p1", "p", 1, "madrid metro timetable")]
    vectors = spark.createDataFrame(rows, "space string, vec_id string, asset_id string, page_index int, txt string").withColumn("embedding", H.hash_embedding(F.col("txt")))
    asked = spark.createDataFrame([(1, "madrid metro timetable"), (2, " \n")], "query_id bigint, text string")
    got = search.text_search(asked, vectors, assets, H.hash_embedding).orderBy("rank").collect()
    assert {r["query_id"] for r in got} == {1} and [r["id"] for r in got if r["matched"] == "text"][:2] == ["b", "p#p1"] and got[0]["score"] > got[-1]["score"]
    found = search.text_search(asked, vectors, assets, H.hash_embedding, kind="pdf")
    assert {r["id"] for r in found.collect()} == {"p#p0", "p#p1"}
    texts = spark.createDataFrame([("b", "madrid metro timetable"), ("p#p1", "page words")], "id string, text string")
    found = search.text_search(asked, vectors, assets, H.hash_embedding)
    silent = search.ask(found, texts, asked).first()
    assert silent["answer"] == search.UNAVAILABLE and "page words" in silent["context"] and silent["sources"][0] in ("a", "b", "p#p1")
    assert search.ask(found, texts, asked, lambda: lambda q, c: f"{q}: {len(c) > 5}").first()["answer"] == "madrid metro timetable: True"

    def broken():
        raise OSError("no model")

    assert search.ask(found, texts, asked, broken).first()["answer"] == search.UNAVAILABLE
    assert search.agent_rows(found).columns == ["query_id", "rank", "id", "kind", "page", "caption", "score", "matched"]


@pytest.mark.parametrize("n", [10, 10**6, 10**12])
def test_every_scheme_of_bands_is_exact(spark, n):
    """Few wide bands, as taken for many hashes, find the same pairs as many narrow ones."""
    r = random.Random(n)
    base = [r.getrandbits(64) for _ in range(6)]
    hashes = set(base)
    for _ in range(25):
        h = r.choice(base)
        for b in r.sample(range(64), r.randint(0, 12)):
            h ^= 1 << b
        hashes.add(h)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame([(h,) for h in signed], "p bigint")
    got = {(x["p"], x["q"]): x["distance"] for x in dedup.close_hashes(df, df.withColumnRenamed("p", "q"), 10, n).collect()}
    want = {(a, b): d for a in signed for b in signed if (d := ((a ^ b) % (1 << 64)).bit_count()) <= 10}
    assert got == want
    # buckets in pieces; each pair once
    rows = dedup.close_hashes(df.repartition(3), df.withColumnRenamed("p", "q"), 10, n, below=True, chunk=4).collect()
    assert len(rows) == len({(x["p"], x["q"]) for x in rows}) and {(x["p"], x["q"]): x["distance"] for x in rows} == {(a, b): d for (a, b), d in want.items() if a < b}
    for threshold in (0, 3, 15):
        got = {(x["p"], x["q"]) for x in dedup.close_hashes(df, df.withColumnRenamed("p", "q"), threshold, n).collect()}
        assert got == {(a, b) for a in signed for b in signed if ((a ^ b) % (1 << 64)).bit_count() <= threshold}


def test_near_classes_and_long_chains(spark):
    rows = [(i, 0) for i in range(300)] + [(1000 + i, 1) for i in range(5)] + [(2000, 1 << 40)]
    df = spark.createDataFrame(rows, "id bigint, phash bigint")
    assert {tuple(r) for r in dedup.near_classes(df).collect()} == {(0, 1000, 1, 300, 5), (0, 2000, 1, 300, 1), (1000, 2000, 2, 5, 1)}
    chain = spark.createDataFrame([(i,) for i in range(12)], "id bigint")
    steps = spark.createDataFrame([(i, i + 1) for i in range(11)], "a bigint, b bigint")
    assert {r["id"]: r["leader"] for r in dedup.leaders(chain, steps).collect()} == {i: i - i % 2 for i in range(12)}


def test_batch_plan_is_the_sequential_rule(spark):
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(6)]

    def item(i):
        h = r.choice(base)
        for b in r.sample(range(63), r.randint(0, 8)):
            h ^= 1 << b
        none = r.random() < 0.15
        sha = f"s{r.randint(0, 5)}" if none else f"s{h}-{r.randint(0, 1)}"  # equal bytes have equal pixels
        return (i, f"/{r.randint(0, 60)}-{i}", sha, "" if none else f"p{h}", None if none else h)

    items, index = [item(i) for i in range(40)], [("old%d" % i, *item(100 + i)[1:]) for i in range(2)]
    items[3] = (3, index[0][1], "changed", "", None)
    items[4] = (4, index[1][1], index[1][2], "", None)
    want, seen = {}, [(x[2], x[3], x[4]) for x in index]
    for i, path, sha, px, ph in items:
        known = [x for x in index if x[1] == path]
        if known:
            want[i] = "unchanged" if known[0][2] == sha else "update"
        elif any(sha == s or (px and px == p) or (ph is not None and q is not None and (ph ^ q).bit_count() <= 10) for s, p, q in seen):
            want[i] = "duplicate"
        else:
            want[i] = "insert"
            seen.append((sha, px, ph))
    c = spark.createDataFrame(items, "id bigint, path string, sha256 string, pixel_hash string, phash bigint")
    x = spark.createDataFrame(index, "asset_id string, path string, sha256 string, pixel_hash string, phash bigint")
    assert {r["id"]: r["action"] for r in dedup.batch_plan(c, x).collect()} == want


def test_greedy_groups_are_not_transitive(spark):
    rows = [(1, "a", "", 0), (2, "b", "", (1 << 8) - 1), (3, "c", "", (1 << 16) - 1), (4, "d", "", 1 << 40), (5, "d", "", 0)]
    got = dedup.near_groups(spark.createDataFrame(rows, "id bigint, sha256 string, pixel_hash string, phash bigint"))
    assert {(r["leader"], r["id"]) for r in got.collect()} == {(1, 1), (1, 2)}


def clustered(r, n, base, most):
    """Signed hashes around ``base`` centres, up to ``most`` bits away."""
    centres, out = [r.getrandbits(64) for _ in range(base)], []
    for _ in range(n):
        h = r.choice(centres)
        for b in r.sample(range(64), r.randint(0, most)):
            h ^= 1 << b
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


@pytest.mark.parametrize("block", [40, 10_000])
def test_greedy_by_blocks_is_the_sequential_rule(spark, block):
    hashes = [*clustered(random.Random(block), 150, 12, 12), None, None]
    want, leads = {}, []
    for i, h in enumerate(hashes):
        first = next((j for j in leads if h is not None and ((h ^ hashes[j]) % (1 << 64)).bit_count() <= 10), i)
        want[i] = first
        if first == i and h is not None:
            leads.append(i)
    files = spark.createDataFrame(list(enumerate(hashes)), "id bigint, phash bigint")
    assert {r["id"]: r["leader"] for r in dedup.greedy(files.repartition(3), block=block).collect()} == want
    named = files.select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), "phash")
    assert {r["id"]: r["leader"] for r in dedup.greedy(named, block=block).collect()} == {f"f{i:04}": f"f{j:04}" for i, j in want.items()}


def test_greedy_writes_no_pairs(spark, monkeypatch):
    """Tables that near groups keep grow with the files, not with the pairs: 400 files around one hash have some 80,000."""
    sizes, keep = [], dedup.kept
    monkeypatch.setattr(dedup, "kept", lambda df: (out := keep(df), sizes.append(out.count()))[0])
    hashes = clustered(random.Random(1), 400, 1, 5)
    rows = [(i, f"s{i}", "", h) for i, h in enumerate(hashes)]
    got = dedup.near_groups(spark.createDataFrame(rows, "id bigint, sha256 string, pixel_hash string, phash bigint"))
    assert got.count() == 400 and got.select("leader").distinct().count() == 1
    assert max(sizes) <= 400


def test_tiles_give_every_class_pair_once(spark, monkeypatch):
    """Several blocks, ids of both kinds, and no pair is shuffled: the plan joins nothing."""
    monkeypatch.setattr(dedup, "BLOCK", 40)
    monkeypatch.setattr(dedup, "few_meet", lambda *_: False)
    hashes = sorted(set(clustered(random.Random(3), 130, 9, 9)))
    random.Random(4).shuffle(hashes)
    rows = [(i, h, 1 + i % 3) for i, h in enumerate(hashes)]
    classes = spark.createDataFrame(rows, "id bigint, phash bigint, n bigint")
    want = sorted((a, b, d, n, m) for a, p, n in rows for b, q, m in rows if a < b and (d := ((p ^ q) % (1 << 64)).bit_count()) <= 10)
    found = dedup.class_pairs(classes, 10)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    named = classes.withColumn("id", F.concat(F.lit("é"), F.lpad(F.col("id").cast("string"), 4, "0")))
    assert sorted((int(r["a"][1:]), int(r["b"][1:]), *r[2:]) for r in dedup.class_pairs(named, 10).collect()) == want


@pytest.mark.parametrize("sizes", [(0, 5), (1, 1), (17, 9000), (40, 8192)])
def test_near_and_earliest_hashes(sizes):
    rng = np.random.default_rng(sum(sizes))
    p, q = (rng.integers(0, 1 << 8, n).astype(np.uint64) for n in sizes)
    every = np.bitwise_count(p[:, None] ^ q) <= 2
    got = [x for r, c, d in dedup.near(p, q, 2, most=50) for x in zip(r.tolist(), c.tolist(), d.tolist(), strict=True)]
    assert sorted(got) == [(r, c, int(p[r] ^ q[c]).bit_count()) for r, c in np.argwhere(every).tolist()]
    assert dedup.earliest(p, q, 2).tolist() == [int(e.argmax()) if e.any() else -1 for e in every]


def test_lookup_meets_in_slices(spark, monkeypatch):
    """The smallest near asset is found without a list of pairs: the join that gives one isn't called."""
    monkeypatch.setattr(dedup, "close_hashes", None)
    hashes = clustered(random.Random(8), 120, 10, 9)
    rows = [(i, f"s{i}", f"p{i}", h) for i, h in enumerate(hashes)]
    asked = spark.createDataFrame(rows[:60], "id bigint, sha256 string, pixel_hash string, phash bigint")
    index = spark.createDataFrame(rows[60:], "asset_id bigint, sha256 string, pixel_hash string, phash bigint")
    near = {i: min((j for j in range(60, 120) if ((hashes[i] ^ hashes[j]) % (1 << 64)).bit_count() <= 10), default=None) for i in range(60)}
    assert {r["id"]: r["duplicate_of"] for r in dedup.lookup(asked, index).collect()} == near and any(near.values())


def test_lifecycle(spark):
    v = spark.createDataFrame([("a", 1, "insert", 1.0), ("a", 3, "update", 3.0), ("b", 2, "insert", 2.0), ("b", 4, "delete", 2.0)], "asset_id string, version bigint, op string, value double")
    assert [tuple(r) for r in lifecycle.latest(v).collect()] == [("a", 3, "update", 3.0)]
    back = lifecycle.upsert(v, spark.createDataFrame([("b", 9.0)], "asset_id string, value double"), 5)
    assert {r["asset_id"]: r["value"] for r in back.collect()} == {"a": 3.0, "b": 9.0}
    assets = spark.createDataFrame([("a", "active"), ("b", "deleted")], "asset_id string, state string")
    vec = spark.createDataFrame([("text", "a", "a"), ("text", "x", None), ("text", "b", "b")], "space string, vec_id string, asset_id string")
    assert {r["vec_id"] for r in V.orphans(vec, assets).collect()} == {"x", "b"}
    assert tuple(lifecycle.reconcile(assets, vec).first()) == (1, 2)


def derive(assets):
    return assets.select(F.lit("text").alias("space"), F.col("asset_id").alias("vec_id"), "asset_id", H.hash_embedding(F.col("text")).alias("embedding"))


def test_store_never_shows_an_interrupted_commit(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "asset_id string, text string, state string")
    store = Store(spark, f"file://{tmp_path}/s", derive)
    store.commit(make([("a", "one", "active"), ("b", "two", "deleted")]))
    assert store.vectors().count() == 1

    def crash():
        raise RuntimeError("crash")

    with pytest.raises(RuntimeError):
        store.commit(make([("c", "x", "active")]), crash)
    assert store.assets().count() == 2
    again = Store(spark, f"file://{tmp_path}/s", derive)
    assert len(os.listdir(tmp_path / "s/assets")) == 1 and again.assets().count() == 2


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "asset_id string, text string, state string, indexed boolean")


def test_store_keeps_a_running_commit_and_both_of_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/two"
    first = Store(spark, path, derive)
    first.insert(rows_of(spark, [("a", "one", "active", True)]))

    def another():
        other = Store(spark, path, derive)  # opened, recovered and written to while the first one is at work
        other.recover()
        assert other.assets().count() == 1
        other.insert(rows_of(spark, [("c", "three", "active", True)]))

    first._write(rows_of(spark, [("b", "two", "active", True)]), "insert", False, another)
    assert {r["asset_id"] for r in first.assets().collect()} == {"a", "b", "c"} == {r["asset_id"] for r in first.vectors().collect()}
    assert len(first.commits()) == 3


def test_store_lifecycle_on_disk(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/life", derive)
    assert store.assets() is None and store.vectors() is None and store.reconcile() == {"tombstones_finished": 0, "orphans_purged": 0}
    store.insert(rows_of(spark, [("a", "one", "active", True), ("b", "two", "active", True)]))
    before = {r["vec_id"]: r["embedding"] for r in store.vectors().collect()}
    store.update(rows_of(spark, [("a", "another text", "active", True), ("zzz", "not there", "active", True)]))
    after = {r["vec_id"]: r["embedding"] for r in store.vectors().collect()}
    assert set(after) == {"a", "b"} and after["b"] == before["b"] and after["a"] != before["a"]
    store.delete(spark.createDataFrame([("b",)], "asset_id string"))
    assert [r["asset_id"] for r in store.assets().collect()] == ["a"] == [r["asset_id"] for r in store.vectors().collect()]
    store.insert(rows_of(spark, [("b", "back", "active", True)]))  # a deleted path comes back
    assert store.vectors().count() == 2
    store._write(rows_of(spark, [("d", "dead", "deleted", True), ("e", "half", "active", False)]), "insert", False, vectors=False)
    assert store.recover() == {"abandoned": 0, "reindexed": 1} and store.assets().where("not indexed").count() == 0
    assert {r["asset_id"] for r in store.vectors().collect()} == {"a", "b", "e"}
    assert store.reconcile() == {"tombstones_finished": 1, "orphans_purged": 2}
    assert store.reconcile() == {"tombstones_finished": 0, "orphans_purged": 0} and len(store.commits()) == 1
    assert {r["asset_id"] for r in store.assets().collect()} == {"a", "b", "e"} == {r["asset_id"] for r in store.vectors().collect()}
    # files of a writer that died go by age
    rows_of(spark, [("x", "lost", "active", True)]).write.parquet(f"file://{tmp_path}/life/assets/lost")
    assert store.recover()["abandoned"] == 0 and store.recover(older_than=0)["abandoned"] == 1


def test_entities_and_answers_of_odd_shape(spark):
    assert one(spark, T.entity(F.lit("a#photo.jpg")), T.entity(F.lit("d#p12345678901"))) == (("a#photo.jpg", "a", None), ("d#p12345678901", "d", None))
    r = one(spark, T.parse_response(F.lit("x\rCaption: A dog\u2028tags: dog, park")))
    assert tuple(r[0]) == ("A dog", ["dog", "park"])


def png(pixels, width, height, level):
    raw = b"".join(b"\0" + bytes(v for x in range(width) for v in pixels(x, y)) for y in range(height))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def test_scan_hashes_and_watch(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    grad = lambda x, y: (4 * x % 256, 4 * y % 256, 2 * (x + y) % 256)
    (folder / "a.PNG").write_bytes(png(grad, 64, 64, 1))
    (folder / "sub/b.png").write_bytes(png(grad, 64, 64, 9))
    (folder / "c.jpg").write_bytes(b"junk")
    (folder / "d.txt").write_bytes(b"text")
    found = scan.hashed(scan.files(spark, f"file://{folder}"))
    assert {os.path.basename(r["path"]) for r in found.collect()} == {"a.PNG", "b.png", "c.jpg"}
    px = {os.path.basename(r["path"]): r for r in scan.images(spark, f"file://{folder}").collect()}
    assert px["a.PNG"]["pixel_hash"] == px["b.png"]["pixel_hash"] != "" and px["a.PNG"]["phash"] == px["b.png"]["phash"]
    assert px["c.jpg"]["pixel_hash"] == "" and px["c.jpg"]["phash"] == ""
    known = spark.createDataFrame(found.collect(), found.schema)
    assert watch.watch_once(spark, f"file://{folder}", known).count() == 0
    (folder / "c.jpg").write_bytes(b"other")
    assert [os.path.basename(r["path"]) for r in watch.watch_once(spark, f"file://{folder}", known).collect()] == ["c.jpg"]
    seen = []
    watch.stream(spark, f"file://{folder}", str(tmp_path / "check"), lambda df, _: seen.extend(r["path"] for r in df.collect()), 2).awaitTermination()
    assert len(seen) == 3


def test_watch_loop_and_late_events(spark, tmp_path):
    folder = folder_of(tmp_path, a_png=png(noise(1), 48, 48, 6))
    empty = spark.createDataFrame([], "path string, sha256 string")
    seen, known = [], [empty]

    def ingest(df):
        rows = df.select("path", "sha256").collect()
        seen.append(len(rows))
        known[0] = known[0].unionByName(spark.createDataFrame(rows, empty.schema))

    watch.watch(spark, f"file://{folder}", lambda: known[0], ingest, 0.0, lambda: len(seen) == 2)
    assert seen == [1, 0]
    source, n = tmp_path / "events", iter(range(9))
    write = lambda rows: spark.createDataFrame(rows, "ts string, event_type string").coalesce(1).write.mode("append").parquet(f"file://{source}/{next(n)}")
    for part in ([("2024-01-01 10:05:00", "a"), ("2024-01-01 10:50:00", "a")], [("2024-01-01 13:00:00", "b")], [("2024-01-01 10:06:00", "a")]):  # the last one is too late
        write(part)
        rows = spark.readStream.schema("ts string, event_type string").option("recursiveFileLookup", "true").parquet(f"file://{source}")
        watch.windowed_counts(rows).writeStream.format("parquet").outputMode("append").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert [(str(r["start"]), r["event_type"], r["n"]) for r in got] == [("2024-01-01 10:00:00", "a", 2)]


def test_model_stage_falls_back_per_row(spark):
    def load():
        return lambda path: {"a": "A"}[path]

    stage = models.stage(load, lambda p: f"stub {p}", "model")
    got = spark.createDataFrame([("a",), ("b",)], "p string").select(stage("p").alias("r")).select("r.*").collect()
    assert {tuple(r) for r in got} == {("A", "model"), ("stub b", "stub")}


def test_entry_and_reports(spark, tiny):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    timings = {r["stage"]: r["n"] for r in e.queries()["stage_timings"](spark, tiny).collect()}
    assert set(timings) == set(reporting.STAGES) and timings["write"] == 0
    assert set(e.oracle_sql()) <= set(e.queries())


GRADIENT = lambda shift: lambda x, y: ((4 * x + shift) % 256, 4 * y % 256, 2 * (x + y) % 256)


def noise(seed):
    r = random.Random(seed)
    rows = [[r.randrange(256) for _ in range(48 * 3)] for _ in range(48)]
    return lambda x, y: rows[y][3 * x : 3 * x + 3]


def folder_of(tmp_path, **files):
    folder = tmp_path / "files"
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / name.replace("_", ".")).write_bytes(data)
    return folder


def pages_reader():
    """Of test documents: pages divided by form feeds, each text and number of images after a bar."""
    def read(data):
        if data.startswith(b"broken"):
            raise ValueError("broken")
        return [(t, [[0.0, 0.0, 10.0, 10.0]] * int(n)) for t, n in (p.split("|") for p in data.decode().split("\f"))]

    return read


def test_archive_end_to_end(spark, tmp_path):
    text = "Quarterly figures of the harbour, with tables and notes."
    folder = folder_of(tmp_path, a_png=png(noise(1), 48, 48, 6), b_png=png(noise(2), 48, 48, 6), copy_png=png(noise(1), 48, 48, 1), doc_pdf=f"{text}|0\fscan|1\f|12".encode(), bad_pdf=b"broken")
    own = Archive(spark, f"file://{tmp_path}/archive", reader=pages_reader())
    report = own.index(f"file://{folder}")
    assert report["stats"] == {"indexed": 4, "duplicate": 1} and report["processed"] == 4 and set(report["timings"]) == set(reporting.STAGES)
    assert own.index(f"file://{folder}")["stats"] == {"unchanged": 4, "duplicate": 1}
    doc = own.asset(f"{folder}/doc.pdf")
    assert [p["page_type"] for p in doc["pages"]] == ["born_digital_text", "scanned", "figure"] and [len(p["regions"]) for p in doc["pages"]] == [0, 1, 8]
    assert doc["pages"][0]["text_input"] == text and doc["pages"][1]["regions"][0]["region_id"].endswith("doc.pdf#p1#r0") and doc["n_pages"] == 3
    assert own.asset(f"{folder}/bad.pdf")["pages"] is None
    image = own.asset(f"{folder}/b.png")
    assert image["models_used"] == {"objects": "stub", "faces": "disabled", "scene": "stub", "ocr": "stub"} and image["resolution"] == {"width": 48, "height": 48} and image["format"] == "PNG"
    stats = own.stats()
    assert stats["assets"] == 4 and stats["text"] == 2 and stats["visual"] == 2 + 9 and stats["clip"] == 0
    best = own.search("quarterly harbour figures").orderBy("rank").collect()
    assert any(r["id"].endswith("doc.pdf#p0") and r["page"] == 0 and r["caption"] == text[:120] for r in best) and not any(r["reranked"] for r in best)
    assert {r["kind"] for r in own.search("quarterly harbour figures", kind="image").collect()} == {"image"}
    assert {r["id"] for r in own.search("quarterly", has_text="on").collect()} <= {f"{folder}/doc.pdf#p0", f"{folder}/doc.pdf#p1"}
    listed = {r["id"]: r for r in own.library().collect()}
    assert listed[f"{folder}/doc.pdf"]["caption"] == "PDF · 3 pages" and listed[f"{folder}/b.png"]["n_faces"] == 0
    back = records.from_json(records.to_json(own.assets().where("kind = 'pdf'")))
    assert back.schema.simpleString() == records.to_schema(own.assets()).schema.simpleString() and back.where("n_pages = 3").first()["pages"][0]["text"] == text
    own.delete(f"{folder}/doc.pdf#p1")
    assert own.asset(f"{folder}/doc.pdf") is None and own.stats()["text"] == 0
    (folder / "b.png").write_bytes(png(noise(3), 48, 48, 6))
    assert own.index(f"file://{folder}")["stats"] == {"unchanged": 2, "updated": 1, "indexed": 1, "duplicate": 1}
    name = own.start(lambda a: a.index(f"file://{folder}", force=True))
    assert own.jobs[name].wait()["state"] == "done" and own.status(name)["processed"] == 5 and own.status("x") == {"state": "unknown"}
    exact = own.duplicates(f"file://{folder}")["exact"].collect()
    assert [r["n"] for r in exact] == [2]
    assert own.settings("yes")["enable_faces"] and not own.settings("no")["enable_faces"] and own.health()["scene"] is False


def test_archive_with_models(spark, tmp_path):
    """Models in place of the stand-ins: their labels are recorded, a failing one falls back for its row, faces come only where enabled."""
    folder = folder_of(tmp_path, a_png=png(noise(1), 48, 48, 6), b_png=png(noise(2), 48, 48, 6))

    def objects():
        return lambda path: [("crane", 0.5, [1, 2, 3, 4])] if path.endswith("a.png") else 1 / 0

    def ocr():
        return lambda path: [{"rec_texts": ["Pier", "", "7"]}] if path.endswith("a.png") else [[[[0, 0], ("north", 0.9)], None, "x"]]

    pixels = lambda: lambda path: [1.0, 0.0] if path.endswith("a.png") else [0.6, 0.8]
    own = Archive(spark, f"file://{tmp_path}/m", models.Models(
        objects=models.Model(objects, "detector"), ocr=models.Model(ocr, "reader"), scene=models.Model(lambda: lambda p: "Caption: A pier\nTags: pier; sea", "captioner"),
        faces=models.Model(lambda: lambda p: [([0.1, 0.2], [0, 0, 1, 1], 0.9)], "faces"), clip=models.Model(pixels, "pixels"), clip_text=models.Model(lambda: lambda t: [0.6, 0.8], "pixels"), enable_faces=True,
    ))
    assert own.index(f"file://{folder}")["processed"] == 2
    a, b = own.asset(f"{folder}/a.png"), own.asset(f"{folder}/b.png")
    assert a["models_used"] == {"objects": "detector", "faces": "faces", "scene": "captioner", "ocr": "reader"} and b["models_used"]["objects"] == "stub"
    assert a["ocr"] == {"full_text": "Pier\n7", "text_blocks": ["Pier", "7"], "has_text": True} and b["ocr"]["full_text"] == "north"
    assert a["faces"][0]["face_id"] == "a.png#0" and a["scene"] == {"caption": "A pier", "tags": ["pier", "sea"]} and a["embeddings"]["visual_input"] == "A pier pier sea crane"
    found = own.search("a pier", label="CRANE").collect()
    assert [r["id"] for r in found] == [f"{folder}/a.png"] and found[0]["matched"] == "visual,text,clip"
    assert [r["id"] for r in own.search_image([0.5, 0.9]).orderBy("rank").collect()] == [f"{folder}/b.png", f"{folder}/a.png"]
    assert [r["id"] for r in own.similar(f"{folder}/a.png").collect()] == [f"{folder}/b.png"]
    uploaded = own.process("../c.png", png(noise(4), 48, 48, 6))
    assert uploaded["processed"] == 1 and uploaded["path"].endswith("/c.png") and own.stats()["assets"] == 3


def test_no_pages_are_carried_to_the_pool(spark, tiny):
    """Filters see narrow facts; nested pages meet the rows of the pool only."""
    from archivelake.plans import tables as B

    assets = B.lake(spark, tiny)
    assert search.facts(assets).columns == ["asset_id", "kind"]
    hits = spark.createDataFrame([(1, "c1#p1", 0.5, "c1", 1), (1, "c1#p0", 0.4, "c1", 0), (1, "d1", 0.3, "d1", None), (1, "c1#p99", 0.2, "c1", 99)], "query_id bigint, entity string, score double, asset_id string, page_index int")
    for options in ({}, {"with_text": True}, {"label": "user"}, {"kind": "pdf", "with_text": True}):
        pool = search.drawn(hits, assets, 10, **options)
        assert pool.columns == [*hits.columns, "rank"]
        joins = [x for x in pool._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
        assert len(joins) == 1
        plan = pool._jdf.queryExecution().optimizedPlan().toString()
        assert "pages#" not in plan[: plan.index("Join ")]
        whole = search.pooled(search.described(hits, assets), 10, options.get("kind"), options.get("with_text"), options.get("label"))
        assert sorted((r["entity"], r["rank"]) for r in pool.collect()) == sorted((r["entity"], r["rank"]) for r in whole.collect())


def test_cli(spark, tmp_path, capsys):
    folder = folder_of(tmp_path, a_png=png(noise(1), 48, 48, 6))
    store = ["--store", f"file://{tmp_path}/cli"]
    run = lambda *a: (cli.main([*store, *a], spark), capsys.readouterr().out)[1]
    assert run("version").strip() == schema.VERSION
    assert '"indexed": 1' in run("watch", f"file://{folder}", "--rounds", "2", "--seconds", "0")
    assert '"unchanged": 1' in run("index", f"file://{folder}")
    assert "a.png" in run("search", "a street view scene room landscape", "--kind", "image") and run("search", "x", "--kind", "pdf").strip() == "no results"
    assert "assets 1" in run("stats") and "orphans_purged" in run("reconcile") and "processed  1" in run("bench", f"file://{folder}", "--force", "--warm-up")
    assert "nothing to index" in run("index", f"file://{tmp_path}/cli/commits")
