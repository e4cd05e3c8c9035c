import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import data
from tidemark.llm import treap_search as treap

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return TERMS.findall(data.low(text))


def ranked(docs, items, k=treap.BEST):
    """Rows of every item, scoring all documents."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [c.total() for _, c in counts if c]
    n_docs, n_terms = len(sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in counts:
            if c:
                m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
                w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) & c.keys()}
                scores.append((-sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in w), i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(x for x in scores if x[0])[:k], 1)]
    return out


def found(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(data.documents(), data.SCHEMA).repartition(3)


def items():
    texts = [t for _, t, *_ in data.documents() if t]
    some = [(i, " ".join(terms(t)[:30])) for i, t in enumerate(texts[::3])]
    return [*some, some[0], (0, "x two"), (None, texts[1]), (90, None), (91, ""), (92, "nothing alike"), (93, "A\x1cB é")]


def test_every_rank_equals_scoring_all_documents(spark, docs, monkeypatch):
    rows = [(i, t) for i, t, *_ in data.documents()]
    for shard, nodes, block in [(treap.SHARD_BYTES, treap.WALK_NODES, 4096), (3000, 50, 3)]:
        monkeypatch.setattr(treap, "SHARD_BYTES", shard)
        monkeypatch.setattr(treap, "WALK_NODES", nodes)
        monkeypatch.setattr(treap, "BLOCK_QUERIES", block)
        got = found(treap.search(docs, spark.createDataFrame(items(), ITEMS), k=7))
        assert got == sorted(ranked(rows, items(), 7), key=repr)


def test_ties_stand_by_doc_id_and_copies_are_documents(spark):
    rows = [(i, "same words here") for i in [9, 4, None, 7, 4, 1]] + [(i, f"other {i}") for i in range(20, 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = found(treap.search(frame, spark.createDataFrame([(1, "words")], ITEMS), k=5))
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == [1, 4, 4, 7, 9]
    assert got == sorted(ranked(rows, [(1, "words")], 5), key=repr)


def test_no_documents_or_queries_no_rows(spark, docs):
    assert treap.search(docs.limit(0), spark.createDataFrame(items(), ITEMS)).count() == 0
    assert treap.search(docs, spark.createDataFrame([], ITEMS)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, " - "), (3, "")], "doc_id long, text string")
    assert treap.search(nothing, spark.createDataFrame(items(), ITEMS)).count() == 0


def _shard(n, seed=0):
    rnd = random.Random(seed)
    queries = treap.Queries([(q, " ".join(f"t{rnd.randint(0, 30)}" for _ in range(6))) for q in range(20)])
    texts = [[rnd.choice(list(queries.vocabulary)) for _ in range(rnd.randint(1, 25))] for _ in range(n)]
    df = Counter(queries.vocabulary[t] for x in texts for t in set(x))
    queries.weigh(n, sum(map(len, texts)), df)
    held = [np.array([queries.vocabulary[t] for t in x]) for x in texts]
    return queries, treap.Shard(queries, list(range(n)), [len(x) for x in texts], held)


def test_treaps_hold_both_orders_and_every_posting():
    _, shard = _shard(200)
    kept = defaultdict(list)

    def visit(node, low, high, most):
        if node >= 0:
            assert low <= shard.doc[node] < high and shard.rank[node] <= most
            visit(shard.left[node], low, shard.doc[node], shard.rank[node])
            kept["docs"].append(shard.doc[node])
            visit(shard.right[node], shard.doc[node] + 1, high, shard.rank[node])

    total = 0
    for t, root in enumerate(shard.root):
        kept.clear()
        visit(root, 0, shard.size, 1 << 62)
        assert kept["docs"] == sorted(kept["docs"]) and len(kept["docs"]) == shard.count[t]
        total += shard.count[t]
    assert total == len(shard.doc)


def test_descent_finds_the_root_of_a_range():
    _, shard = _shard(150, 1)
    rnd = random.Random(2)
    for t, root in enumerate(shard.root):
        for _ in range(20):
            low, high = sorted((rnd.randint(0, 150), rnd.randint(0, 150)))
            mine = [i for i in _nodes(shard, root) if low <= shard.doc[i] < high]
            got = shard.descend(np.array([root]), np.array([low]), np.array([high]))[0]
            assert got == max(mine, key=lambda i: shard.rank[i], default=-1)


def _nodes(shard, node):
    return [] if node < 0 else [node, *_nodes(shard, shard.left[node]), *_nodes(shard, shard.right[node])]


def test_ranges_that_cannot_enter_are_not_walked(monkeypatch):
    """With few results asked for, most documents are never scored."""
    queries, shard = _shard(3000, 3)
    scored = []
    add = treap.Best.add
    monkeypatch.setattr(treap.Best, "add", lambda self, query, score, ids: (scored.append(len(query)), add(self, query, score, ids)))
    treap.search_shard(shard, queries, treap.Best(len(queries.ids), 3))
    few = sum(scored)
    scored.clear()
    treap.search_shard(shard, queries, treap.Best(len(queries.ids), 3000))
    assert few < sum(scored) / 3
