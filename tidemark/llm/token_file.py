"""Token-id files: ORC stripes of run-length encoded ids, ascending doc_id.

Documents are range-partitioned by doc_id, so every file is one shard of the
order. ORC's integer run-length encoding packs the ids; row indexes and a Bloom
filter on doc_id let readers skip stripes and row groups, and stripes split
over tasks. Each row also holds its offset within the shard, so a reader knows
every document's place from the shard totals alone.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.common import map_arrow

#: Layout of the files.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}
SCHEMA = "doc_id long, ids array<int>, shard int, shard_start long, n_ids long"
#: Closes every document.
END_ID = 2
#: Characters of a text by which rows of one id are dealt to shards.
DEALT_CHARS = 8
#: New chunks that the library encodes as one text.
CHUNKS_IN_TEXT = 200
#: Such texts of a group that the library encodes in one call.
TEXTS_IN_CALL = 20
#: Bytes of each generation of kept chunks: their ids are small.
KEPT_BYTES = 96 << 20
#: Bytes of batches whose distinct words are encoded once.
GROUP_BYTES = 16 << 20


def _word_ends(library: Tokenizer) -> np.ndarray:
    """Which ids end a word, if the vocabulary marks them."""
    suffix, known = getattr(library.model, "end_of_word_suffix", None), library.get_vocab()
    closes = np.zeros(max(known.values()) + 1, bool)
    closes[[i for token, i in known.items() if suffix and token.endswith(suffix)]] = True
    return closes


def _packed_ids(vocabulary: str, library: Tokenizer | None = None) -> bpe.Kept:
    """The library's ids of chunks without white space, as bytes. The tokenizer
    drops white space and never joins over it, so those of a text follow.

    Many chunks are encoded as one text. A run of plain letters is one word, so its
    ids end with the only token that ends a word. Between other chunks stands an
    added token of the vocabulary that shows where the ids of each end; a chunk that
    may hold that token itself is encoded alone, as are all where there is none."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if library is None:
        library = bpe.check_vocabulary(Tokenizer.from_file(vocabulary))
    added = library.get_added_tokens_decoder()
    mark, mark_id = min(((t.content, i) for i, t in added.items() if len(t.content) > 2), default=("", None), key=lambda x: x[1])

    closes = _word_ends(library)
    suffix = closes.any()

    def alone(chunk: str) -> bytes:
        return array("i", library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def together(chunks: list[str], between: str, split):
        rows = [chunks[i : i + CHUNKS_IN_TEXT] for i in range(0, len(chunks), CHUNKS_IN_TEXT)]
        texts = map(between.join, rows)
        for row, e in zip(rows, library.encode_batch_fast(list(texts), add_special_tokens=False), strict=True):
            yield from split(row, np.array(e.ids, "<i4"))

    def make(block: list[str]):
        words, plain, kinds = [], [], []
        for c in block:
            if suffix and bpe.is_word(c):
                words.append(c)
                kinds.append(0)
            elif not mark or mark[:2].lower() in c.lower():
                kinds.append(2)
            else:
                plain.append(c)
                kinds.append(1)
        found = together(words, " ", by_ends), together(plain, f" {mark} ", by_marks)
        for c, kind in zip(block, kinds, strict=True):
            yield alone(c) if kind == 2 else next(found[kind])

    def by_ends(row: list[str], ids: np.ndarray):
        stops = np.flatnonzero(closes[ids]) + 1
        if len(stops) != len(row) or stops[-1] != len(ids):  # some chunk is more than one word here
            yield from map(alone, row)
            return
        raw, a = ids.tobytes(), 0
        for b in (4 * stops).tolist():
            yield raw[a:b]
            a = b

    def by_marks(row: list[str], ids: np.ndarray):
        stops = np.append(np.flatnonzero(ids == mark_id), len(ids)).tolist()
        raw, a = ids.tobytes(), 0
        for b in stops:
            yield raw[4 * a : 4 * b]
            a = b + 1

    return bpe.Kept(make, lambda c, value: 200 + 2 * len(c) + len(value), KEPT_BYTES)


class Encoder:
    """The library's ids of whole texts, batches of about GROUP_BYTES at a time.

    Their distinct words, and these are most of all chunks, are encoded once for
    the group, apart from the marks after them; all other chunks are kept."""

    def __init__(self, vocabulary: str):
        library = bpe.check_vocabulary(Tokenizer.from_file(vocabulary))
        self.rest = _packed_ids(vocabulary, library)
        self.words, self.closes = bpe.word_library(library), _word_ends(library)

    def encode(self, group: list[pa.Array], end_id: int):
        """Of each array of texts the ids, each text's with ``end_id`` last, and
        how many each has."""
        found = list(map(bpe.chunk_array, group))
        chunks = pa.concat_arrays([c for c, _, _ in found]).dictionary_encode()
        ids, lengths = self.ids_of(chunks.dictionary)
        ids, lengths = np.append(ids, np.int32(end_id)), np.append(lengths, 1)
        begins, at = np.cumsum(lengths) - lengths, 0
        for c, starts, sizes in found:
            stops = np.cumsum(sizes + 1)  # of the chunks of each text and its end
            inside = np.ones(stops[-1], bool)
            inside[stops - 1] = False
            order = np.full(stops[-1], len(lengths) - 1, np.int32)
            order[inside] = chunks.indices[at : at + len(c)].to_numpy()[bpe.spread(starts, sizes)]
            at += len(c)
            counts = lengths[order]
            yield ids[bpe.spread(begins[order], counts)], np.add.reduceat(counts, stops - sizes - 1)

    def ids_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after the other, and how many each has."""
        if not self.words:
            return self.kept_ids(bpe.strings(chunks))
        parts = pc.extract_regex(chunks, bpe.WORD_AND_MARKS)
        odd = pc.or_(parts.is_null(), pc.match_substring(chunks, "<|"))
        whole = pc.invert(odd)
        words, marks = (pc.struct_field(parts, k).filter(whole).dictionary_encode() for k in ("word", "marks"))
        ids, lengths = self.word_ids(words.dictionary)
        more, more_lengths = self.kept_ids(bpe.strings(marks.dictionary) + bpe.strings(chunks.filter(odd)))
        # a chunk is a word and marks, or another one and nothing
        ids, lengths = np.concatenate([ids, more]), np.concatenate([lengths, more_lengths, [0]])
        n_words, n_marks, odd = len(words.dictionary), len(marks.dictionary), odd.to_numpy(zero_copy_only=False)
        pair = np.full((len(chunks), 2), len(lengths) - 1)
        pair[~odd, 0] = words.indices.to_numpy()
        pair[~odd, 1] = marks.indices.to_numpy() + n_words
        pair[odd, 0] = np.arange(n_words + n_marks, len(lengths) - 1)
        begins, counts = np.cumsum(lengths) - lengths, lengths[pair]
        return ids[bpe.spread(begins[pair].ravel(), counts.ravel())], counts.sum(axis=1)

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k, e in enumerate(self.encodings(words)):
            row = words[k * CHUNKS_IN_TEXT : (k + 1) * CHUNKS_IN_TEXT]
            got = np.array(e.ids, np.int32)
            stops = np.flatnonzero(self.closes[got]) + 1
            counts = np.diff(stops, prepend=0)
            if len(stops) != len(row) or stops[-1] != len(got):  # some word has no end in this vocabulary
                got, counts = self.kept_ids(bpe.strings(row))
            ids.append(got)
            lengths.append(counts)
        return np.concatenate(ids), np.concatenate(lengths)

    def encodings(self, words: pa.Array):
        """One for every CHUNKS_IN_TEXT words; a few of them are held at a time."""
        for a in range(0, len(words), CHUNKS_IN_TEXT * TEXTS_IN_CALL):
            some = bpe.joined(words[a : a + CHUNKS_IN_TEXT * TEXTS_IN_CALL], CHUNKS_IN_TEXT, " ")
            yield from self.words.encode_batch_fast(list(map(bpe.spell, some)), add_special_tokens=False)

    def kept_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of any chunks; what is kept stays bounded, however many there are."""
        raw, lengths = [], [np.zeros(0, np.int64)]
        for a in range(0, len(chunks), bpe.MISS_BLOCK):
            some = chunks[a : a + bpe.MISS_BLOCK]
            values = [*map(self.rest.of([some]).__getitem__, some)]
            raw.append(b"".join(values))
            lengths.append(np.fromiter(map(len, values), np.int64, len(values)) // 4)
        return np.frombuffer(b"".join(raw), "<i4"), np.concatenate(lengths)


def _grouped(batches):
    """Batches of GROUP_BYTES together, a larger one alone; none is empty."""
    group, size = [], 0
    for batch in batches:
        if group and size + batch.nbytes > GROUP_BYTES:
            yield group
            group, size = [], 0
        if batch.num_rows:
            group.append(batch)
            size += batch.nbytes
    if group:
        yield group


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) into ORC files in ``path``
    with the tokenizers library.

    Rows: doc_id, ids (with ``end_id`` last), shard, shard_start (ids of the
    shard before this row), n_ids. Shards and the rows in them ascend by doc_id, null
    ids first; rows with the same doc_id keep their texts' order. A null text
    is empty and holds ``end_id`` alone. Other columns of ``docs`` are ignored.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        # rows of one id, or of none, are dealt on by how their texts begin
        .repartitionByRange(F.col("doc_id"), F.substring("text", 1, DEALT_CHARS))
        .sortWithinPartitions("doc_id", "text")
        .withColumn("shard", F.spark_partition_id())
    )

    def run(batches):
        encoder = bpe.kept(vocabulary, "ids", lambda: Encoder(vocabulary))
        before: dict[int, int] = {}
        for group in _grouped(batches):
            encoded = encoder.encode([batch["text"] for batch in group], end_id)
            for batch, (ids, sizes) in zip(group, encoded, strict=True):
                shard = batch["shard"][0].as_py()
                stops = np.concatenate(([0], np.cumsum(sizes)))
                starts = before.get(shard, 0) + stops[:-1]
                before[shard] = before.get(shard, 0) + int(stops[-1])
                ids = pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], ids, batch["shard"], pa.array(starts), pa.array(sizes)],
                    ["doc_id", "ids", "shard", "shard_start", "n_ids"],
                )

    rows = map_arrow(ordered, run, SCHEMA)
    rows.write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Rows of token files; a condition on doc_id prunes stripes and row groups."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if where is None else rows.where(where)


def shard_offsets(rows: DataFrame) -> DataFrame:
    """Ids before each shard: one row for every file."""
    totals = rows.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_ids")).alias("ids_in_shard"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("ids_in_shard").over(before), F.lit(0)).alias("before"))


def describe_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the
    crc32 of its ids as little-endian unsigned 32-bit integers. No files' rows,
    no result rows.
    """
    rows = read_token_files(spark, path)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch["ids"]
            raw = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4").tobytes()
            stops = np.concatenate(([0], np.cumsum(np.diff(ids.offsets.to_numpy())))) * 4
            stops = stops.tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(stops, stops[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(np.diff(stops) // 4, pa.int64()),
                    pa.array(crc, pa.int64()),
                    batch["shard"],
                    batch["shard_start"],
                ],
                ["doc_id", "n_tokens", "ids_crc32", "shard", "shard_start"],
            )

    schema = "doc_id long, n_tokens long, ids_crc32 long, shard int, shard_start long"
    # one row for each shard: bounded by the number of files
    return map_arrow(rows.drop("n_ids"), run, schema).join(shard_offsets(rows), "shard").select(
        "doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )
