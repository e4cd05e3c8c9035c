"""Benchmark decontamination with an FM-index for each shard of documents.

A shard's words become symbols, its suffix array gives the Burrows-Wheeler
transform, and a wavelet matrix answers rank queries on it. All test phrases
are searched backward at once; occurrences are located by walking to sampled
suffix positions, and their word spans merge into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.common import arrow_column, fresh, struct_array

#: Words in a test phrase.
WINDOW = 13
#: A document is contaminated from one hit word in this many.
SHARE = 20
#: UTF-8 bytes of the texts of one index.
SHARD_BYTES = 2_000_000
#: Every so many positions of a shard keep their place in the suffix array.
SAMPLE = 8
#: Test phrases in a block at most.
PHRASES_PER_BLOCK = 500_000


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and hashes of the lower-cased words of packed texts."""
    data = tb.LOWERED[data]
    starts, stops = tb.runs(tb.ALNUM[data])
    return starts, stops, tb.Rolling(data).spans(starts, stops)


class FMIndex:
    """Words as symbols 1..n; 0 ends every run of words that no phrase holds.

    Zeros sort by position, as if each were a sign of its own, so a suffix is
    compared up to the next zero at most.
    """

    def __init__(self, s: np.ndarray, n_symbols: int):
        self.s = s
        self.sa = self._suffix_array(s)
        before = s[self.sa - 1]
        before[self.sa == 0] = 0
        self._wavelet(before, n_symbols)
        counts = np.bincount(s, minlength=n_symbols + 2)
        self.c = np.concatenate(([0], np.cumsum(counts)))
        # places whose predecessor is a zero end a walk, so they are kept too
        kept = (self.sa % SAMPLE == 0) | (before == 0)
        self.kept = kept
        self.kept_rank = np.concatenate(([0], np.cumsum(kept)))
        self.samples = self.sa[kept]

    @staticmethod
    def _suffix_array(s: np.ndarray) -> np.ndarray:
        n = len(s)
        zero = s == 0
        n_zero = int(zero.sum())
        sa = np.argsort(s, kind="stable")
        rank = np.empty(n, np.int64)
        rank[sa[:n_zero]] = np.arange(n_zero)
        word = sa[n_zero:]
        new = np.ones(len(word), bool)
        new[1:] = s[word[1:]] != s[word[:-1]]
        heads = np.flatnonzero(new)
        # a rank is the row of its group's first member
        rank[word] = n_zero + heads[np.cumsum(new) - 1]
        h = 1
        single = np.append(new[1:], True) & new
        todo = np.flatnonzero(~single) + n_zero  # rows
        while len(todo):
            at = sa[todo]
            # a suffix that is still open has only words in its first h places
            key = rank[at] * (n + 1) + rank[np.minimum(at + h, n - 1)]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            sa[todo] = at
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            rank[at] = todo[np.flatnonzero(new)[np.cumsum(new) - 1]]
            single = np.append(new[1:], True) & new
            todo = todo[~single]
            h *= 2
        return sa

    def _wavelet(self, bwt: np.ndarray, n_symbols: int) -> None:
        self.levels = []
        row = bwt
        for bit in range(max(1, int(n_symbols).bit_length()) - 1, -1, -1):
            one = (row >> bit & 1).astype(bool)
            ones = np.zeros(len(row) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            zeros = len(row) - int(ones[-1])
            self.levels.append((bit, ones, zeros))
            row = np.concatenate([row[~one], row[one]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands in the first i places of the transform."""
        lo, hi = np.zeros_like(i), i
        for bit, ones, zeros in self.levels:
            one = (c >> bit & 1).astype(bool)
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo

    def step(self, rows: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that begin one place earlier."""
        lo, hi, c = np.zeros_like(rows), rows, np.zeros_like(rows)
        for bit, ones, zeros in self.levels:
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            one = ones[hi + 1] > ones[hi]
            c |= one.astype(np.int64) << bit
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return self.c[c] + hi - lo

    def search(self, symbols: np.ndarray, stops: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with their row ranges, by backward search.

        Phrase k is ``symbols[stops[k] - sizes[k] : stops[k]]``."""
        which = np.arange(len(stops))
        lo, hi = np.zeros(len(stops), np.int64), np.full(len(stops), len(self.sa), np.int64)
        done: list[tuple] = []
        k = 0
        while len(which):
            over = sizes[which] == k
            if over.any():
                done.append((which[over], lo[over], hi[over]))
                which, lo, hi = which[~over], lo[~over], hi[~over]
            c = symbols[stops[which] - 1 - k]
            if k == 0:
                lo, hi = self.c[c], self.c[c + 1]
            else:
                lo, hi = self.c[c] + self.rank(c, lo), self.c[c] + self.rank(c, hi)
            there = hi > lo
            which, lo, hi = which[there], lo[there], hi[there]
            k += 1
        if not done:
            return which, lo, hi
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all rows in the ranges, and which range each is of."""
        sizes = hi - lo
        of = np.repeat(np.arange(len(lo)), sizes)
        rows = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[of]
        out = np.zeros(len(rows), np.int64)
        walk, steps = np.arange(len(rows)), 0
        while len(walk):
            kept = self.kept[rows]
            out[walk[kept]] = self.samples[self.kept_rank[rows[kept]]] + steps
            walk, rows = walk[~kept], rows[~kept]
            rows = self.step(rows)
            steps += 1
        return out, of


class Vocabulary:
    """The words of a block of phrases, as symbols 1..n; 0 is any other word."""

    def __init__(self, hashes: np.ndarray):
        self.words = np.unique(hashes)

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)


class Phrases:
    """A block of benchmark items: its distinct windows, each with its items."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.items = [None if i is None else str(i) for i, _ in items]
        data, begins = tb.pack(tb.encode([t for _, t in items]))
        starts, _, self.hashes = split_words(data)
        item = np.searchsorted(begins, starts, "right") - 1
        counts = np.bincount(item, minlength=len(items))
        first = np.cumsum(counts) - counts
        n_windows = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
        of = np.repeat(np.arange(len(items)), n_windows)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        sizes = np.minimum(counts, window)[of]
        begin = first[of] + k
        # equal windows are one phrase: their words' hashes, size by size
        words = np.zeros((len(of), window), np.uint64)
        for j in range(window):
            there = j < sizes
            words[there, j] = self.hashes[begin[there] + j]
        _, one, phrase = np.unique(words, axis=0, return_index=True, return_inverse=True)
        self.sizes, self.begins = sizes[one], begin[one]
        pairs = np.unique(np.stack([phrase.reshape(-1), of], 1), axis=0)
        self.item_of = pairs[:, 1]
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))
        self.vocabulary = Vocabulary(self.hashes)
        self.symbols, self.hashes = self.vocabulary.symbols_of(self.hashes), None

    def items_of(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``phrases``, item) of all items of these phrases."""
        sizes = self.item_from[phrases + 1] - self.item_from[phrases]
        of = np.repeat(np.arange(len(phrases)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.item_from[phrases][of]
        return of, self.item_of[at]


def shard_hits(raws: list[bytes], blocks: Iterable[Phrases]) -> dict[str, list]:
    """n_words, n_hit, spans (merged, in bytes) and items of each text.

    Blocks of phrases are met one after the other, each by an index over its own
    words; what they hit is counted by place, over all of them."""
    data, begins = tb.pack(raws)
    starts, stops, hashes = split_words(data)
    doc = np.searchsorted(begins, starts, "right") - 1
    counts = np.bincount(doc, minlength=len(raws))
    # one zero after the words of each text: no phrase reaches over it
    size, place = len(starts) + len(raws), np.arange(len(starts)) + doc
    items: list[set] = [set() for _ in raws]
    ends = np.cumsum(counts + 1)
    depth = np.zeros(size + 1, np.int32)
    for phrases in blocks:
        s = np.zeros(size, np.int64)
        s[place] = phrases.vocabulary.symbols_of(hashes)
        if not s.any():
            continue
        index = FMIndex(s, len(phrases.vocabulary.words))
        which, lo, hi = index.search(phrases.symbols, phrases.begins + phrases.sizes, phrases.sizes)
        if not len(which):
            continue
        at, of = index.locate(lo, hi)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + phrases.sizes[which[of]], -1)
        met = np.unique(np.searchsorted(ends, at, "right") * len(which) + of)
        text, phrase = np.divmod(met, len(which))
        held, item = phrases.items_of(which[phrase])
        for d, i in np.unique(np.stack([text[held], item], 1), axis=0).tolist():
            if phrases.items[i] is not None:
                items[d].add(phrases.items[i])
    hit = np.cumsum(depth) > 0
    n_hit = np.bincount(np.searchsorted(ends, np.flatnonzero(hit), "right"), minlength=len(raws)).tolist()
    spans: list[list] = [[] for _ in raws]
    lo, hi = tb.runs(hit)
    d = np.searchsorted(ends, lo, "right")
    found = np.stack([starts[lo - d] - begins[d], stops[hi - d - 1] - begins[d]], 1) if len(lo) else np.zeros((0, 2), np.int64)
    for k, span in zip(d.tolist(), found.tolist(), strict=True):
        spans[k].append(span)
    return {"n_words": counts.tolist(), "n_hit": n_hit, "spans": spans, "items": items}


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Phrases]:
    """The test phrases in blocks of a bounded number, one at a time."""
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("string"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"] or "") // 2 + 1
        if size >= PHRASES_PER_BLOCK:
            yield Phrases(block, window)
            block, size = [], 0
    if block:
        yield Phrases(block, window)


def _one_at_a_time(sent: list) -> Iterator[Phrases]:
    """Broadcast blocks; where there are several, a task holds one of them only
    and reads it again from its file for the next texts."""
    for block in sent:
        yield block.value
        if len(sent) > 1:
            block.__dict__.pop("_value", None)


HITS = "struct<n_words: bigint, n_hit: bigint, spans: array<array<int>>, items: array<string>, cut: string>"
KINDS = {"n_words": pa.int64(), "n_hit": pa.int64(), "spans": pa.list_(pa.list_(pa.int32())), "items": pa.list_(pa.string())}


def hits_of(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cut: bool = False) -> Column:
    """A struct column with n_words, n_hit, spans (merged removal spans, UTF-8
    byte offsets), items (item_ids as strings with an occurring window) and, if
    asked for, cut: the text without its spans where it has some and stays.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. A
    window is ``window`` words of an item in a row; a shorter item, if it has a
    word, is one window. Null or empty texts have no words and no hits; items
    without words match nothing; repeated item rows count once by their id, and
    the words of an item without an id are hits of no listed item. An empty
    benchmark leaves every text clean. Phrases go out in broadcast blocks of a
    bounded size: the driver and a task hold one block at a time.
    """
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(b) for b in _blocks(benchmark, window)]

    def run(batches):
        for texts in batches:
            raws = tb.encode(texts.to_pylist())
            found: dict[str, list] = {"n_words": [], "n_hit": [], "spans": [], "items": []}
            for a, b in tb.groups(raws, SHARD_BYTES):
                for k, x in shard_hits(raws[a:b], _one_at_a_time(sent)).items():
                    found[k] += x
            found["items"] = [sorted(x) for x in found["items"]]
            left: list[str | None] = [None] * len(raws)
            for k, spans in enumerate(found["spans"] if cut else ()):
                if spans and SHARE * found["n_hit"][k] < found["n_words"][k]:
                    left[k] = _cut(raws[k], spans).decode()
            columns = {k: pa.array(x, KINDS[k]) for k, x in found.items()}
            yield struct_array(columns | {"cut": pa.array(left, pa.string())})

    return arrow_column(docs.sparkSession, run, HITS, F.col("text").cast("string"))


def is_contaminated(hits: str) -> Column:
    return (F.col(f"{hits}.n_hit") > 0) & (SHARE * F.col(f"{hits}.n_hit") >= F.col(f"{hits}.n_words"))


def _cut(raw: bytes, spans: list[list[int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents, and without the removal spans in
    the others: same columns, text cut, n_chars (if there) counted anew.

    Spans begin and end at words, so no character is cut. Null texts stay null.
    Other columns pass as they are, whatever their names."""
    held = fresh(docs.columns, "_hits")
    clean = docs.withColumn(held, hits_of(docs, benchmark, cut=True)).where(~is_contaminated(held))
    whole = clean.withColumn("text", F.coalesce(f"{held}.cut", "text")).drop(held)
    return whole.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else whole


def judge_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    ``n_hit`` counts the words inside any occurrence of a window; a document is
    contaminated if there is one and ``SHARE * n_hit >= n_words``. Without
    items, items_sha256 is that of the empty string. Each input row gives one;
    a null doc_id stays null.
    """
    found = docs.select(F.col("doc_id").cast("long"), hits_of(docs, benchmark).alias("hits"))
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated("hits").alias("contaminated"),
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT item_id, least(len(w), 13) AS n,
    unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2), lambda i: array_to_string(w[i : i + least(len(w), 13) - 1], ' '))) AS phrase
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM phrases),
grams AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT g.r, g.p, g.n, ph.item_id
  FROM (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS phrase FROM grams) g JOIN phrases ph USING (n, phrase)),
words AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS i FROM hits) GROUP BY r),
items AS (
  SELECT r, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
