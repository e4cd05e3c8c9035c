"""Suffix dedup: ranks of byte strings by prefix doubling over sampled positions.

A 50-byte string is ranked as a pair of ranks of 25 bytes, and only positions
whose shorter rank is not unique go on to the next round:

1. 25 bytes. Of the 26 positions where a 25-byte string of a window begins, the
   one with the least hash (the leftmost of equals) is the window's anchor.
   Equal windows have equal anchors at equal offsets, so ranking anchors ranks
   all windows. Anchors that stand in one document alone are dropped.
2. The bytes of all windows in a row that share an anchor. Where an anchor has
   one such extension, the smallest document with it settles all its windows.
3. 50 bytes, for anchors with several extensions: the windows of the smallest
   document of each extension, each as the pair of the ranks of its 25-byte
   halves.

What is sorted where: Spark deals ranks by their upper bits into buckets, which is
the outer order of the sort; numpy sorts a part's ranks before they are sent and
each bucket's ranks when they meet there. A rank is a hash of its string (of 25
bytes, then the pair of two such), not its place in the whole order, so there is
no reranking of all positions.

Every round is a Spark exchange by rank. A part (the rows of one hash of doc_id
and text) sends its distinct ranks in ascending order, those of one bucket packed
into one row, so a passage that many documents share costs one entry for each
part. The answer says one bit for each entry, in the order in which it came;
the part ranks its texts again to read it. Texts are shuffled once, by part;
all rounds reuse that exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.common import bound_batches, map_arrow

#: Bytes of a string that counts as repeated.
LENGTH = 50
#: Bytes of the first round's strings.
HALF = LENGTH // 2
ANCHORS = LENGTH - HALF + 1
#: A text longer than this is scanned in overlapping pieces.
PIECE_BYTES = 8 << 20
#: UTF-8 bytes of the texts of one part; ranks that meet in one bucket come
#: from so many bytes of all parts.
PART_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
PARTS_IN_TASK = 3
#: Stands for a null doc_id: no document is larger.
NO_ID = 2**63 - 1

#: UTF-8 bytes scanned together.
GROUP_BYTES = 1 << 20

_POS = np.uint64((1 << 24) - 1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)

#: Answers by round: the bits of one part and bucket.
SIDE = "part int, round int, bucket int, first binary, second binary"
#: Entries: ranks, further ranks, least doc_ids, and whether several documents
#: of the part have the rank.
ENTRIES = "bucket int, part int, ranks binary, more binary, docs binary, several binary"


class Scan:
    """Windows of some text pieces, in runs of one anchor."""

    def __init__(self, docs: np.ndarray, offsets: np.ndarray, raws: list[bytes]):
        data, begins = tb.pack(raws)
        self.rolling = tb.Rolling(data)
        short = self.rolling.windows(HALF)
        n = len(data)
        value = np.full(n + ANCHORS, ~np.uint64(0))
        value[: len(short)] = (short & ~_POS) | np.arange(len(short), dtype=np.uint64)
        size = 1
        while size * 2 <= ANCHORS:  # least of 1, 2, 4 ... values from each position
            value = np.minimum(value[:-size], value[size:])
            size *= 2
        rest = ANCHORS - size
        least = np.minimum(value[: len(value) - rest], value[rest:])[:n]
        lengths = np.diff(begins) - 1
        piece = np.repeat(np.arange(len(raws)), np.maximum(lengths - LENGTH + 1, 0))
        counts = np.maximum(lengths - LENGTH + 1, 0)
        starts = np.arange(len(piece)) - (np.cumsum(counts) - counts)[piece] + begins[piece]
        least = least[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        self.lo, self.hi = starts[first], starts[last] if len(first) else starts[:0]
        # mixed again: the least of many hashes are all small, and buckets are
        # cut from the upper bits
        self.key = tb.mix(short[(least[first] & _POS).astype(np.int64)])
        self.piece = piece[first]
        self.doc = docs[self.piece]
        #: what to take from a place to have its offset in the text
        self.shift = begins[:-1] - offsets

    def run_hashes(self, at: np.ndarray) -> np.ndarray:
        return self.rolling.spans(self.lo[at], self.hi[at] + LENGTH)

    def window_starts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All window starts of these runs, and the run of each."""
        sizes = self.hi[at] - self.lo[at] + 1
        of = np.repeat(at, sizes)
        return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.lo[of], of

    def window_ranks(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pair of ranks of a window's halves, as 128 bits: the first rank
        is kept, the other one mixed with it, to deal pairs evenly."""
        one, two = self.rolling.spans(starts, starts + HALF), self.rolling.spans(starts + HALF, starts + LENGTH)
        return tb.mix(one * _PAIR + two), one


def scans(raws: list[bytes]) -> Iterator[Scan]:
    pieces = [
        (i, at, raw[at : at + PIECE_BYTES + LENGTH - 1])
        for i, raw in enumerate(raws)
        for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE_BYTES)
        if len(raw) >= LENGTH
    ]
    for a, b in tb.groups([p[2] for p in pieces], GROUP_BYTES):
        some = pieces[a:b]
        yield Scan(np.array([p[0] for p in some]), np.array([p[1] for p in some]), [p[2] for p in some])


def _ids(column) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], np.int64)


def _pack48(ranks: np.ndarray) -> bytes:
    return ranks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _planes(x: np.ndarray) -> bytes:
    """64-bit values by byte place: equal upper bytes then pack to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view("<i8")


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields]
    )


def _cut(ranks: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending ranks: the upper bits say the bucket."""
    bucket = ((ranks >> np.uint64(40)) * np.uint64(n_buckets) >> np.uint64(24)).astype(np.int64)
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=False))


class Ranks:
    """Distinct ranks of one round in a part, ascending, with the least and the
    largest doc_id of each, and the entry of every ranked place."""

    def __init__(self, docs: np.ndarray, ranks: np.ndarray, more: np.ndarray | None = None):
        order = np.argsort(ranks, kind="stable") if more is None else np.lexsort((more, ranks))
        ranks, docs = ranks[order], docs[order]
        new = np.append(True, ranks[1:] != ranks[:-1])[: len(ranks)]
        if more is not None:
            more = more[order]
            new[1:] |= more[1:] != more[:-1]
        heads = np.flatnonzero(new)
        self.entry = np.empty(len(ranks), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.ranks, self.more = ranks[heads], None if more is None else more[heads]
        self.least = np.minimum.reduceat(docs, heads) if len(heads) else docs
        self.largest = np.maximum.reduceat(docs, heads) if len(heads) else docs

    def rows(self, part: int, n_buckets: int, with_docs: bool, whole: bool = False) -> list[tuple]:
        """Entries of 48 bits beside their bucket, or of all 64 if they decide."""
        several = self.least != self.largest
        return [
            (
                bucket,
                part,
                self.ranks[a:b].tobytes() if whole else _pack48(self.ranks[a:b]),
                b"" if self.more is None else self.more[a:b].tobytes(),
                _planes(self.least[a:b]) if with_docs else b"",
                _bits(several[a:b]),
            )
            for bucket, a, b in _cut(self.ranks, n_buckets)
        ]

    def answers(self, side: dict, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The two bits of every ranked place."""
        first, second = np.zeros(len(self.ranks), bool), np.zeros(len(self.ranks), bool)
        for bucket, a, b in _cut(self.ranks, n_buckets):
            if bucket in side:
                first[a:b] = _unbits(side[bucket][0], b - a)
                second[a:b] = _unbits(side[bucket][1], b - a)
        return first[self.entry], second[self.entry]


class Part:
    """The texts of one part, ranked as far as the answers of earlier rounds go."""

    def __init__(self, raws: list[bytes], ids: np.ndarray, side: dict[int, dict], n_buckets: int):
        self.scans, self.n_buckets, self.side = list(scans(raws)), n_buckets, side
        join = lambda f, kind: np.concatenate([np.zeros(0, kind), *map(f, self.scans)])
        self.key = join(lambda s: s.key, np.uint64)
        self.text = join(lambda s: s.doc, np.int64)
        self.doc = ids[self.text]
        self.begin = np.cumsum([0, *(len(s.key) for s in self.scans)])

    def anchors(self) -> Ranks:
        return Ranks(self.doc, self.key)

    def runs(self) -> tuple[np.ndarray, Ranks]:
        """Runs whose anchor several documents have, and the ranks of those."""
        shared, _ = self.anchors().answers(self.side.get(1, {}), self.n_buckets)
        found = [s.run_hashes(np.flatnonzero(shared[a : a + len(s.key)])) for s, a in zip(self.scans, self.begin, strict=False)]
        at = np.flatnonzero(shared)
        return at, Ranks(self.doc[at], self.key[at], np.concatenate([np.zeros(0, np.uint64), *found]))

    def judged(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs that a smaller document has too, and runs whose windows are open."""
        at, ranks = self.runs()
        earlier, open_ = ranks.answers(self.side.get(2, {}), self.n_buckets)
        later = earlier | (self.doc[at] > ranks.least[ranks.entry])
        return at[later], at[~later & open_]

    def windows(self, open_: np.ndarray) -> tuple[list, Ranks]:
        """(scan, starts, runs) of the open windows, and their ranks."""
        found, docs, ranks, more = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for s, a in zip(self.scans, self.begin, strict=False):
            mine = open_[(open_ >= a) & (open_ < a + len(s.key))] - a
            starts, of = s.window_starts(mine)
            found.append((s, starts, of))
            pair = s.window_ranks(starts)
            ranks.append(pair[0])
            more.append(pair[1])
            docs.append(self.doc[a + of])
        return found, Ranks(*map(np.concatenate, (docs, ranks, more)))

    def removed(self, n_texts: int) -> list[list[tuple[int, int]]]:
        """Merged removal spans of each text."""
        closed, open_ = self.judged()
        found, ranks = self.windows(open_)
        earlier, _ = ranks.answers(self.side.get(3, {}), self.n_buckets)
        text, lo, hi = [], [], []
        done = 0
        for (s, starts, of), a in zip(found, self.begin, strict=False):
            doc = self.doc[a + of]
            entry = ranks.entry[done : done + len(starts)]
            hit = earlier[done : done + len(starts)] | (doc > ranks.least[entry])
            done += len(starts)
            mine = closed[(closed >= a) & (closed < a + len(s.key))] - a
            for run, x, y in ((mine, s.lo[mine], s.hi[mine]), (of[hit], starts[hit], starts[hit])):
                shift = s.shift[s.piece[run]]
                text.append(s.doc[run])
                lo.append(x - shift)
                hi.append(y - shift + LENGTH)
        out: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
        if not text:
            return out
        text, lo, hi = map(np.concatenate, (text, lo, hi))
        order = np.lexsort([lo, text])
        for d, a, b in zip(text[order].tolist(), lo[order].tolist(), hi[order].tolist(), strict=True):
            spans = out[d]
            if spans and a <= spans[-1][1]:
                if b > spans[-1][1]:
                    spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        return out


def _part(docs: pa.Table | pa.RecordBatch, side: pa.Table | None, n_buckets: int) -> Part:
    answers: dict[int, dict] = {}
    if side is not None:
        for r, bucket, first, second in zip(*(side[c].to_pylist() for c in ("round", "bucket", "first", "second")), strict=True):
            answers.setdefault(r, {})[bucket] = first, second
    return Part(tb.encode(docs["text"].to_pylist()), _ids(docs["doc_id"]), answers, n_buckets)


def _number(docs: pa.Table) -> int:
    return docs["part"][0].as_py()


def _send_anchors(n_buckets: int):
    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            docs = pa.Table.from_batches(held)
            rows = _part(docs, None, n_buckets).anchors().rows(_number(docs), n_buckets, False)
            held.clear()
            return _batch(rows, ENTRIES)

        for batch in batches:  # sorted by part
            part = batch["part"].to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    if held and held[0]["part"][0].as_py() != part[a]:
                        yield flush()
                    held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return run


def _send_runs(n_buckets: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        rows = _part(docs, side, n_buckets).runs()[1].rows(_number(docs), n_buckets, True) if docs.num_rows else []
        return pa.Table.from_batches([_batch(rows, ENTRIES)])

    return run


def _send_windows(n_buckets: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            part = _part(docs, side, n_buckets)
            rows = part.windows(part.judged()[1])[1].rows(_number(docs), n_buckets, True, True)
        return pa.Table.from_batches([_batch(rows, ENTRIES)])

    return run


def _answer(round_: int):
    """All entries of a bucket: round 1 asks whether another document has the
    rank, round 2 whether a smaller one has it (and whether the anchor has other
    runs), round 3 whether a smaller one has it."""

    def run(entries: pa.Table) -> pa.Table:
        read = _unpack48 if round_ < 3 else lambda x: np.frombuffer(x, "<u8")
        ranks = [read(x) for x in entries["ranks"].to_pylist()]
        sizes = [len(r) for r in ranks]
        ranks = np.concatenate(ranks)
        several = np.concatenate([_unbits(x, n) for x, n in zip(entries["several"].to_pylist(), sizes, strict=True)])
        keys, docs = [ranks], None
        if round_ > 1:
            keys.append(np.frombuffer(b"".join(entries["more"].to_pylist()), "<u8"))
            docs = np.concatenate([_unplanes(x) for x in entries["docs"].to_pylist()])
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(ranks, kind="stable")
        new = np.zeros(len(ranks), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        second = np.zeros(len(ranks), bool)
        if round_ == 1:
            count = np.diff(np.append(heads, len(ranks)))
            found = ((count > 1) | np.logical_or.reduceat(several[order], heads))[group]
        else:
            found = docs[order] > np.minimum.reduceat(docs[order], heads)[group]
        if round_ == 2:
            anchor = np.append(True, ranks[order[1:]] != ranks[order[:-1]])
            second[order] = np.add.reduceat(new.astype(np.int64), np.flatnonzero(anchor))[np.cumsum(anchor) - 1] > 1
        first = np.zeros(len(ranks), bool)
        first[order] = found
        stops = np.cumsum(sizes)
        rows = [
            (part, round_, bucket, _bits(first[b - n : b]), _bits(second[b - n : b]))
            for part, bucket, n, b in zip(entries["part"].to_pylist(), entries["bucket"].to_pylist(), sizes, stops, strict=True)
        ]
        return pa.Table.from_batches([_batch(rows, SIDE)])

    return run


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def _finish(extra: list[str], n_buckets: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        raws = tb.encode(docs["text"].to_pylist())
        spans = _part(docs, side, n_buckets).removed(len(raws))
        kept = [_kept(r, s) for r, s in zip(raws, spans, strict=True)]
        out = (
            pa.array([len(r) for r in raws], pa.int64()),
            pa.array([len(r) - len(k) for r, k in zip(raws, kept, strict=True)], pa.int64()),
            pa.array([len(s) for s in spans], pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            # a span may begin or end inside a character: what is left of it goes
            pa.array([None if t is None else k.decode("utf-8", "ignore") for t, k in zip(docs["text"].to_pylist(), kept, strict=True)], pa.string()),
        )
        return pa.table({c: docs[c] for c in ("doc_id", *extra)} | dict(zip(RESULTS, out, strict=True)))

    return run


def _judged(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """doc_id, further columns under the names in the dict, and RESULTS."""
    spark = docs.sparkSession
    bound_batches(spark)
    others = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts = max(shuffles, -(-total // PART_BYTES))
    n_tasks = max(shuffles, n_parts // PARTS_IN_TASK)
    n_buckets = max(shuffles, -(-total // BUCKET_BYTES))
    task = F.pmod(F.col("part"), F.lit(n_tasks)).cast("int")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[F.col(f"`{c}`").alias(e) for c, e in others.items()],
        # with the text, so that rows without an id don't meet in one part
        F.pmod(F.xxhash64(F.col("doc_id"), F.col("text").cast("string")), F.lit(n_parts)).cast("int").alias("part"),
    )
    # parts and buckets are dealt by their numbers, so that all tasks are alike
    texts = texts.withColumn("task", task).repartitionById(n_tasks, F.col("task")).sortWithinPartitions("task", "part")

    def dealt(side: DataFrame) -> DataFrame:
        return side.repartitionById(n_tasks, F.col("task"))

    def cogroup(sides: list[DataFrame], fn, schema: str) -> DataFrame:
        # a union has no partitioning of its own, so its few bits are dealt again
        side = sides[0] if len(sides) == 1 else dealt(reduce(DataFrame.unionAll, sides))
        return texts.groupBy("task", "part").cogroup(side.groupBy("task", "part")).applyInArrow(fn, schema)

    def answer(entries: DataFrame, round_: int) -> DataFrame:
        by_bucket = entries.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket")
        # an exchange that later rounds reuse
        return dealt(by_bucket.applyInArrow(_answer(round_), SIDE).withColumn("task", task))

    one = answer(map_arrow(texts, _send_anchors(n_buckets), ENTRIES), 1)
    two = answer(cogroup([one], _send_runs(n_buckets), ENTRIES), 2)
    three = answer(cogroup([one, two], _send_windows(n_buckets), ENTRIES), 3)
    kinds = dict(docs.select(*[F.col(f"`{c}`") for c in others]).dtypes) if others else {}
    own = "".join(f", {e} {kinds[c]}" for c, e in others.items())
    schema = f"doc_id long{own}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return cogroup([one, two, three], _finish(list(others.values()), n_buckets), schema), others


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but text, with n_bytes, n_removed, n_spans,
    kept_sha256 and kept_text; input columns of these names give way to them.

    A byte of a text's UTF-8 form is removed if a LENGTH-byte string that covers
    it also starts in a document with a smaller doc_id; strings are judged on
    the input and never cross documents. ``n_spans`` counts the maximal removed
    runs. Null texts have no bytes (``kept_text`` stays null) and texts under
    LENGTH bytes lose none. Rows with one doc_id never take from each other; a
    null doc_id is larger than any other.
    """
    done, others = _judged(docs)
    return done.select("doc_id", *[F.col(e).alias(c) for c, e in others.items() if c not in RESULTS], *RESULTS)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, text without the bytes that remove_repeats
    removes (and without what is left of a character that was cut), n_chars (if
    there) counted anew."""
    done, others = _judged(docs)
    own = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text")}
    own |= {c: F.col(e) for c, e in others.items()}
    if "n_chars" in others:
        own["n_chars"] = F.length("kept_text").cast("long")
    return done.select(*[own[c].alias(c) for c in docs.columns])


#: Every 50-byte string as hexadecimal text: for small tables.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS k FROM (
  SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS p FROM d)),
m AS (SELECT k, min(doc_id) AS f FROM g GROUP BY k),
bad AS (SELECT doc_id, p FROM g JOIN m USING (k) WHERE f < doc_id),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER w > 50 THEN 1 ELSE 0 END AS new FROM bad WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
grouped AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM grouped GROUP BY doc_id, i),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
