"""Ranked lexical search against a brute-force ranking."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("archivelake.llm")

from archivelake.llm import lexical  # noqa: E402
from archivelake.llm.common import session_settings  # noqa: E402
from archivelake.llm.queries import QUERIES  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id bigint, text string, score bigint, rank int, q int, size int", "item_id bigint, text string, doc_id string, q int"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in own:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def awkward(seed=5, n=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["The", "THE", "é", "É", "x_y", "a-b", "漢字", "　", "🙂", "it's", "10"]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(r.randint(0, 40)))) for i in range(0, 3 * n, 3)]
    docs += [(i, "w1 w2 copied text of many") for i in range(1, 200, 3)]  # ties
    docs += [(None, None), (None, "w1 w2 w3 nobody"), (None, "w1 w2 copied text of many"), (6, docs[2][1]), (6, docs[2][1]), (9, None), (12, ""), (15, " \x00\x01 ")]
    docs += [(7001, "w3 " * 5000 + "w4"), (7002, "rare\x00w5\x00rare")]
    r.shuffle(docs)
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 15)))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "-- !!"), (43, "unknownterm"), (44, "w1 w2"), (44, "w1 w2"), (None, "copied W3 w3 w3"), (45, "rare"), (46, "text of many copied")]
    return docs, items


@pytest.mark.parametrize(("docs_per_shard", "block_words"), [(4096, 200_000), (16, 10), (1, 200_000)])
def test_against_brute_force(spark, monkeypatch, docs_per_shard, block_words):
    monkeypatch.setattr(lexical, "SHARD_DOCS", docs_per_shard)  # travels to the tasks with the code that closes shards
    docs, items = awkward()
    left = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    for k in (20, 3):
        assert got(lexical.search(left, right, spark, k=k, block_words=block_words)) == brute(docs, items, k)


def test_whole_table(spark, tiny):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    assert got(QUERIES["op12_lexical_search"](spark, tiny)) == brute(docs, items)


def test_tree_holds_both_orders():
    r = random.Random(2)
    shard = lexical.Shard()
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 30))) for _ in range(77)]
    ids = r.sample(range(1000), 77)
    shard.add(ids[:40], texts[:40])
    shard.add(ids[40:], texts[40:])
    total = sum(len(t.split()) for t in texts)
    tree = lexical.Tree(shard.row(77, total))
    assert tree.ids.tolist() == sorted(ids)
    top = tree.impacts[: tree.n]
    for a, z in zip(tree.offsets, tree.offsets[1:]):
        assert (np.diff(top[a:z]) <= 0).all()
    # the leaves, from left to right, hold the documents by doc_id: the tree ends with one interval for each document
    assert tree.height == 7 and len(tree.impacts) == 8 * tree.n


def test_bounds_leave_documents_out(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(vocab[min(2999, int(r.paretovariate(0.6)))] for _ in range(60))) for i in range(4000)]
    items = [(i, docs[i * 37][1]) for i in range(20)]
    left, right = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), spark.createDataFrame(items, "item_id bigint, text string")
    entered = spark.sparkContext.accumulator(0)
    found = lexical.search(left, right, spark, counter=entered)
    assert got(found) == brute(docs, items)
    assert entered.value < 0.5 * len(docs) * len(items)


def test_index_is_stored_and_opened_again(spark, tmp_path):
    docs, items = awkward(9, 60)
    left = spark.createDataFrame(docs, "doc_id bigint, text string")
    lexical.Index.build(left, spark, f"file://{tmp_path}/index")
    again = lexical.Index.open(spark, f"file://{tmp_path}/index")
    assert got(again.search(spark.createDataFrame(items, "item_id bigint, text string"))) == brute(docs, items)


def test_small_batches_and_empty_tables(spark):
    docs, items = awkward(11, 50)
    left, right = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    with session_settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": 2}):
        assert got(lexical.search(left, right, spark)) == brute(docs, items)
    assert lexical.search(left.limit(0), right, spark).count() == 0
    assert lexical.search(left, right.limit(0), spark).count() == 0
