r"""Ranked lexical search over inverted treaps.

Each shard of documents holds a treap for every query term: its nodes are the
documents with the term, in search order by doc_id and in heap order by impact
(the term's share of the document's score), so the root of any subtree has the
largest impact of its range. A search walks the treaps of all its terms at once
over a range of documents. The sum of the roots bounds every score in the range;
where it cannot enter the best k, the range is dropped with all its subtrees.
Else the document at the heaviest root is scored and splits the range, and each
treap is followed into both sides. The ranges of all searches of a shard advance
together, one numpy step for each level. A task carries its best k from shard to
shard, so later shards are pruned from their roots on.

Terms are the maximal matches of
``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` after A-Z is lower-cased.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow

BEST = 50
#: Queries that are searched together: their number, and bytes of their texts.
BLOCK_QUERIES = 4096
BLOCK_BYTES = 1 << 20
#: Documents of a shard, in UTF-8 bytes; a longer one is a shard of its own.
SHARD_BYTES = 8 << 20
#: Treap nodes (of one query and document) that are walked together, at most.
WALK_NODES = 1 << 20

#: Any other byte parts terms; those of characters beyond ASCII never do.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Stands for a null doc_id, which ranks behind all others.
_NO_ID = (1 << 63) - 1


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


class Queries:
    """A block of queries: their ids, their vocabulary, and each one's terms."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        met = [sorted({self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms_of(text)}) for _, text in rows]
        sizes = np.fromiter(map(len, met), np.int64, len(met))
        self.query = np.repeat(np.arange(len(met)), sizes)
        self.term = np.fromiter((t for x in met for t in x), np.int64, int(sizes.sum()))
        self.weight = np.zeros(len(self.vocabulary), np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        """Set each term's weight from the counts of the whole corpus."""
        self.n_docs, self.n_terms = n_docs, n_terms
        for t in range(len(self.vocabulary)):
            self.weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))


def query_blocks(queries: DataFrame) -> Iterator[Queries]:
    """Queries in blocks of a bounded size; the driver holds one at a time."""
    rows = queries.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
        if size >= BLOCK_BYTES or len(block) == BLOCK_QUERIES:
            yield Queries(block)
            block, size = [], 0
    if block:
        yield Queries(block)


def _counts(docs: DataFrame, queries: Queries) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all terms, and the documents of each query term."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches):
        known, df = vocabulary.value, Counter()
        wanted, n_docs, n_terms = set(known), 0, 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                if words := terms_of(text):
                    n_docs, n_terms = n_docs + 1, n_terms + len(words)
                    df.update(wanted.intersection(words))
        found = {-1: n_docs, -2: n_terms} | {known[t]: n for t, n in df.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    # no more rows than the block has terms
    told = map_arrow(docs.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r["term"]: r["n"] for r in told.collect()}
    return n.pop(-1, 0), n.pop(-2, 0), n


class Shard:
    """Treaps of the query terms over some documents."""

    def __init__(self, queries: Queries, ids: list[int], lengths: list[int], terms: list[np.ndarray]):
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        self.ids = np.array(ids, np.int64)[order]
        self.size = n = len(ids)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        held = np.repeat(place, np.fromiter(map(len, terms), np.int64, n))
        key, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *terms]) * n + held, return_counts=True)
        term, doc = np.divmod(key, n)
        length = np.array(lengths, np.int64)[order]
        # in 64-bit integers; documents without terms have no postings
        m = 100 - 50 + (50 * length * queries.n_docs) // max(1, queries.n_terms)
        impact = queries.weight[term] * ((1000000000 * tf) // (1000 * tf + 20 * m[doc]))
        some = np.flatnonzero(impact > 0)
        self.doc, self.impact, term = doc[some], impact[some], term[some]
        self.count = np.bincount(term, minlength=len(queries.weight))
        self._grow(term)

    def _grow(self, term: np.ndarray) -> None:
        """Children of every node, and each term's root (-1: none).

        Equal impacts are ordered by a random number: no long chains of them."""
        n = len(term)
        luck = np.random.default_rng(n).integers(0, 1 << 20, n)
        self.rank = self.impact << 20 | luck
        left, right, root = [-1] * n, [-1] * n, {}
        rank, path, now = self.rank.tolist(), [], -1
        for i, t in enumerate(term.tolist()):
            if t != now:
                if path:
                    root[now] = path[0]
                path, now = [], t
            x, last = rank[i], -1
            while path and rank[path[-1]] < x:
                last = path.pop()
            left[i] = last
            if path:
                right[path[-1]] = i
            path.append(i)
        if path:
            root[now] = path[0]
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.root = np.full(len(self.count), -1, np.int64)
        self.root[list(root)] = list(root.values())

    def descend(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each subtree, the root of its part with low <= doc < high, or -1."""
        node = node.copy()
        live = np.flatnonzero(node >= 0)
        while len(live):
            at = node[live]
            doc = self.doc[at]
            under, over = doc < low[live], doc >= high[live]
            live, at = live[under | over], np.where(under, self.right[at], self.left[at])[under | over]
            node[live] = at
            live = live[at >= 0]
        return node


class Best:
    """The k best documents of each query so far, and the score that the k-th has."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.ones(n, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        new = score >= self.least[query]
        query, score, ids = query[new], score[new], ids[new]
        if not len(query):
            return
        touched = np.zeros(len(self.least), bool)
        touched[query] = True
        old = touched[self.query]
        query, score, ids = (np.concatenate(x) for x in ((self.query[old], query), (self.score[old], score), (self.id[old], ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        last = place == self.k - 1
        self.least[query[last]] = score[last]
        top = place < self.k
        self.query, self.score, self.id = (
            np.concatenate(x) for x in ((self.query[~old], query[top]), (self.score[~old], score[top]), (self.id[~old], ids[top]))
        )


def walk(shard: Shard, query: np.ndarray, term: np.ndarray, best: Best) -> None:
    """Search one shard for queries given as (query, term) pairs, query ascending."""
    node = shard.root[term]
    query, node = query[node >= 0], node[node >= 0]
    if not len(node):
        return
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    of = query[starts]  # of each range its query and bounds; of each node its range
    low, high = np.zeros(len(of), np.int64), np.full(len(of), shard.size)
    at = np.repeat(np.arange(len(of)), np.diff(np.append(starts, len(node))))
    while len(node):
        bound = np.add.reduceat(shard.impact[node], starts)
        open_ = bound >= best.least[of]
        node, at = node[open_[at]], (np.cumsum(open_) - 1)[at[open_[at]]]
        of, low, high = of[open_], low[open_], high[open_]
        if not len(node):
            return
        starts = np.searchsorted(at, np.arange(len(of)))
        rank = shard.rank[node]
        heaviest = np.flatnonzero(rank == np.maximum.reduceat(rank, starts)[at])
        heaviest = heaviest[np.append(True, np.diff(at[heaviest]) > 0)]
        doc = shard.doc[node[heaviest]]
        here, split = shard.doc[node], doc[at]
        before, after = here < split, here > split
        # the child on the far side of the split; on the other side a root stays
        far = np.where(before, shard.right[node], shard.left[node])
        hit = np.where(before | after, shard.descend(np.where(before | after, far, -1), split, split + 1), node)
        score = np.bincount(at, np.where(hit >= 0, shard.impact[hit], 0), len(of)).astype(np.int64)
        best.add(of, score, shard.ids[doc])
        lefts = np.where(before, node, shard.descend(np.where(before, -1, shard.left[node]), low[at], split))
        rights = np.where(after, node, shard.descend(np.where(after, -1, shard.right[node]), split + 1, high[at]))
        node = np.concatenate([lefts[lefts >= 0], rights[rights >= 0]])
        at = np.concatenate([at[lefts >= 0], at[rights >= 0] + len(of)])
        if not len(node):
            return
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        live = at[starts]
        at = np.repeat(np.arange(len(live)), np.diff(np.append(starts, len(node))))
        of, low, high = np.append(of, of)[live], np.append(low, doc + 1)[live], np.append(doc, high)[live]


def search_shard(shard: Shard, queries: Queries, best: Best) -> None:
    """All queries of a block over one shard, some at a time."""
    cost = np.cumsum(np.bincount(queries.query, shard.count[queries.term], len(queries.ids)))
    group = (cost / WALK_NODES).astype(np.int64)[queries.query]
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for a, b in zip(edges, np.append(edges[1:], len(group)), strict=True):
        walk(shard, queries.query[a:b], queries.term[a:b], best)


def _search_block(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        block = sent.value
        best, known = Best(len(block.ids), k), block.vocabulary.get
        ids, lengths, terms, size = [], [], [], 0

        def close():
            if ids:
                search_shard(Shard(block, ids, lengths, terms), block, best)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                if ids and size + len(text) > SHARD_BYTES:
                    close()
                    ids, lengths, terms, size = [], [], [], 0
                ids.append(_NO_ID if doc_id is None else doc_id)
                lengths.append(len(words))
                terms.append(np.array([t for t in map(known, words) if t is not None], np.int64))
                size += len(text)
        close()
        found = [np.arange(len(block.ids))[best.query], best.id, best.score]
        names = pa.array(block.ids, pa.int64()).take(pa.array(best.query))
        gone = pa.array(found[1], mask=found[1] == _NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), names, gone, pa.array(found[2])], ["query", "item_id", "doc_id", "score"])

    found = map_arrow(docs, run, "query long, item_id long, doc_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score for
    every query, of those with a score above 0; ``docs`` has doc_id and text,
    ``queries`` has item_id and text.

    Rank counts from 1; equal scores stand by ascending doc_id, a null one last.
    Null and empty texts have no terms, are not counted, and neither find nor are
    found. Repeated document rows are documents of their own. Query rows that
    repeat id and text are one query; those of one id with other texts, and those
    without an id, are ranked apart. Queries go out in blocks of a bounded size,
    one after the other, each against all documents. Other columns are ignored;
    no documents or no queries, no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = []
    for block in query_blocks(queries):
        block.weigh(*_counts(docs, block))
        found.append(_search_block(docs, block, k))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(w) * n_docs) // n_terms) AS m FROM d, total),
scores AS (
  SELECT b.item_id, m.r, m.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM b JOIN tf USING (term) JOIN weights USING (term) JOIN m USING (r) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
