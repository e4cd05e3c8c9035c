"""Cross-tokenizer alignment: where two tokenizers cut the same bytes.

The texts of a slice stand one after the other with their byte offsets. The ends
of all A tokens and all B tokens are counted once over these bytes; where both
end, the slice is cut into groups. Between two ends that follow each other lies
exactly one A token and one B token, so every such stretch is a link. Prefix sums
over the ends, taken at the texts' offsets, give each text its own figures.

Links are counted over the corpus by pairs of ids. Slices are gathered in blocks. A
block sends each of its distinct pairs once, with a count; sums over all blocks
come back to the block that sent them and are added up there for each text.

Texts are tokenized in units: neither tokenizer joins over a space that follows
anything but white space, which is checked for the files given. Units that a
worker meets again are not encoded again.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.common import map_arrow, materialize

#: UTF-8 bytes whose pairs are sent together; a longer text is sent alone.
BLOCK_BYTES = 4 << 20
#: UTF-8 bytes that are cut, encoded and aligned together; a longer text alone.
#: Strings and arrays of a slice take about 100 times as much.
SLICE_BYTES = 512 << 10
#: What a worker keeps of the units it has met, in each of two generations.
KEPT_BYTES = 64 << 20
#: Units encoded as one text.
UNITS_IN_TEXT = 400
#: A pair's key is its A id above this many bits, its B id below.
ID_BITS = 24
_B_IDS = (1 << ID_BITS) - 1

#: A space after anything but white space (in Python's wide sense), unless it is
#: the last character: B puts no space before nothing.
_CUT = re.compile(r" (?<=\S )(?!\Z)")
_CHECK = "  it's  two \n\n words\t\t  x. "


class Pair:
    """Both tokenizers, and the bytes of all their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        byte_of = {c: b for b, c in enumerate(bpe.byte_symbols())}
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(map(byte_of.__getitem__, token))
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(names)
        ]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.digits = _digits(max(len(self.a_bytes), len(self.b_bytes)))
        free = not any(re.search("[^▁]▁", p) for p in names) and self.a.normalizer is None
        self.by_units = free and "ByteLevel" in str(self.a.pre_tokenizer) and "use_regex=True" in str(self.a.pre_tokenizer)
        a, b = self.encode([_CHECK])
        self.by_units &= self.says(a[0], self.a_bytes) == self.says(b[0], self.b_bytes) == f" {_CHECK}".encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each text: B puts the space there itself."""
        a = self.a.encode_batch_fast([f" {x}" for x in texts], add_special_tokens=False)
        return [x.ids for x in a], self.b.encode(texts, num_threads=1)

    @staticmethod
    def says(ids: list[int], tokens: list[bytes]) -> bytes:
        return b"".join(map(tokens.__getitem__, ids))

    def units(self, text: str | None) -> list[str]:
        """What stands between the cuts of a text; an empty one has none."""
        return [] if not text else _CUT.split(text) if self.by_units else [text]

    def of_units(self, units: list[str]):
        """(A ids, B ids) of each unit as int32 bytes; None where its bytes are
        not those of a space and the unit in both."""
        inner = [u for u in units if u and not u[-1].isspace()]
        texts = [inner[i : i + UNITS_IN_TEXT] for i in range(0, len(inner), UNITS_IN_TEXT)] if self.by_units else []
        done: dict[str, tuple | None] = {}
        for row, a, b in zip(texts, *self.encode([" ".join(x) for x in texts]), strict=True):
            raw = "".join(f" {u}" for u in row).encode()
            if self.says(a, self.a_bytes) != raw or self.says(b, self.b_bytes) != raw:
                continue  # some unit of these; each is encoded alone
            ends = np.cumsum([len(u.encode()) + 1 for u in row])
            split = []
            for ids, size in ((a, self.a_size), (b, self.b_size)):
                ids = np.array(ids, "<i4")
                stops = (np.searchsorted(np.cumsum(size[ids]), ends) + 1).tolist()
                packed = ids.tobytes()
                split.append([packed[4 * i : 4 * j] for i, j in zip([0, *stops], stops, strict=False)])
            done.update(zip(row, zip(*split, strict=True), strict=True))
        rest = [u for u in units if u not in done]
        for u, a, b in zip(rest, *self.encode(rest), strict=True):
            raw = f" {u}".encode()
            same = self.says(a, self.a_bytes) == raw == self.says(b, self.b_bytes)
            done[u] = (np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()) if same else None
        return map(done.__getitem__, units)


_PAIRS: dict[tuple[str, str], tuple[Pair, bpe.Kept]] = {}


def _pair(byte_level: str, pieces: str) -> tuple[Pair, bpe.Kept]:
    """Both tokenizers and the kept units of this worker."""
    if (byte_level, pieces) not in _PAIRS:
        pair = Pair(byte_level, pieces)
        # two byte strings, a tuple, the key and a place in a dictionary
        size = lambda u, v: 330 + 2 * len(u) + sum(map(len, v or ()))
        _PAIRS[byte_level, pieces] = pair, bpe.Kept(pair.of_units, size, KEPT_BYTES)
    return _PAIRS[byte_level, pieces]


def _digits(n: int) -> np.ndarray:
    """Decimal digits of all numbers below n, left-aligned, 0 where there is none."""
    width = len(str(max(0, n - 1)))
    text = "".join(str(i).ljust(width, "\0") for i in range(n))
    return np.frombuffer(text.encode(), np.uint8).reshape(n, width)


class Alignment:
    """The groups and links of texts that stand one after the other."""

    def __init__(self, pair: Pair, tokens: list[tuple[bytes, bytes]]):
        """``tokens``: A ids and B ids of each text, as int32 bytes."""
        a, b = (np.frombuffer(b"".join([t[k] for t in tokens]), "<i4").astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.fromiter((len(t[k]) // 4 for t in tokens), np.int64, len(tokens)) for k in (0, 1))
        a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        total = int(a_end[-1]) if len(a) else 0
        in_a, in_b = (np.bincount(x, minlength=total + 1).astype(np.int8) for x in (a_end, b_end))
        both, either = in_a & in_b, in_a | in_b
        #: bytes before each text: where the last of its A tokens ends
        offset = np.concatenate(([0], np.concatenate(([0], a_end))[np.cumsum(n_a)]))
        cuts = np.cumsum(both, dtype=np.int32)
        links = np.cumsum(either, dtype=np.int32)
        self.n_a, self.n_b = n_a, n_b
        self.n_groups, self.n_links = np.diff(cuts[offset]).astype(np.int64), np.diff(links[offset]).astype(np.int64)
        ends = np.flatnonzero(either)
        a_at, b_at = (np.cumsum(x, dtype=np.int32)[ends - 1] for x in (in_a, in_b))
        self.key = a[a_at] << ID_BITS | b[b_at]
        self._tell(pair.digits, a, b, cuts[a_end - 1], cuts[b_end - 1], both[a_end], both[b_end])

    def _tell(self, digits, a, b, a_group, b_group, a_last, b_last) -> None:
        """The groups of all texts as one string, and where each text's part ends."""
        groups = int(self.n_groups.sum())
        in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        ids, marks = np.empty(len(a) + len(b), np.int32), np.empty(len(a) + len(b), np.uint8)
        place = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[a_group]
        ids[place], marks[place] = a, np.where(a_last, ord("|"), ord(","))
        place = np.arange(len(b)) + np.cumsum(in_a)[b_group]
        ids[place], marks[place] = b, np.where(b_last, ord(";"), ord(","))
        text = np.concatenate([digits[ids], marks[:, None]], 1)
        shown = text > 0
        size = np.cumsum(np.concatenate(([0], shown.sum(1, dtype=np.int64))))
        self.stops = size[np.cumsum(self.n_a + self.n_b)].tolist()
        self.text = text[shown].tobytes()

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text; empty without tokens."""
        # the last mark of a text parts it from the next one
        return [self.text[i : max(i, j - 1)].decode() for i, j in zip([0, *self.stops], self.stops, strict=False)]


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
BLOCKS = (
    "block long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, groups_sha256 array<string>, "
    "n_pairs array<int>, place array<int>, times array<int>, pair array<long>, n array<long>"
)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, int]]:
    """Index ranges of texts that stay under a slice's bytes together, and their bytes."""
    at = size = 0
    for i, length in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > at and size + length > min(SLICE_BYTES, BLOCK_BYTES):
            yield at, i, size
            at, size = i, 0
        size += length
    if at < len(texts):
        yield at, len(texts), size


def _aligned(pair: Pair, store: bpe.Kept, texts: list[str | None], keep_groups: bool) -> dict[str, np.ndarray | list]:
    """Figures of a slice's texts, its distinct pairs with counts, and for each
    text the places of its pairs and how often."""
    units = list(map(pair.units, texts))
    cache = store.of(units)
    tokens = []
    for parts in units:
        got = list(map(cache.__getitem__, parts))
        tokens.append((b"", b"") if None in got else (b"".join([g[0] for g in got]), b"".join([g[1] for g in got])))
    found = Alignment(pair, tokens)
    keys, at, n = np.unique(found.key, return_inverse=True, return_counts=True)
    text = np.repeat(np.arange(len(texts)), found.n_links)
    met, times = np.unique(text * max(1, len(keys)) + at, return_counts=True)
    text, place = np.divmod(met, max(1, len(keys)))
    groups = found.groups()
    digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
    whole = {x: getattr(found, x) for x in FIGURES} | {"groups_sha256": digests, "n_pairs": np.bincount(text, minlength=len(texts))}
    whole |= {"place": place.astype(np.int32), "times": times.astype(np.int32), "pair": keys, "n": n}
    return whole | ({"groups": groups} if keep_groups else {})


def _gathered(slices: list[dict]) -> dict[str, np.ndarray | list]:
    """The slices of a block as one: each distinct pair once."""
    keys, at = np.unique(np.concatenate([x["pair"] for x in slices]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate([x["n"] for x in slices]))
    before = np.cumsum([0, *(len(x["pair"]) for x in slices)]).tolist()
    place = [at[i:j][x["place"]] for i, j, x in zip(before, before[1:], slices, strict=False)]
    lists = {c: list(chain.from_iterable(x[c] for x in slices)) for c in ("doc_id", "groups_sha256", "groups") if c in slices[0]}
    arrays = {c: np.concatenate([x[c] for x in slices]) for c in (*FIGURES, "n_pairs", "times")}
    return lists | arrays | {"place": np.concatenate(place), "pair": keys, "n": n}


def _block_rows(docs: DataFrame, byte_level: str, pieces: str, keep_groups: bool) -> DataFrame:
    """A row for each block of texts: what its slices gather to."""
    schema = BLOCKS + ", groups array<string>" * keep_groups
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"doc_id": pa.int64(), "pair": pa.int64(), "n": pa.int64(), "groups_sha256": pa.string(), "groups": pa.string()}

    def row(block: int, slices: list[dict]) -> pa.RecordBatch:
        whole = _gathered(slices)
        lists = [pa.array([whole[c]], pa.list_(types.get(c, pa.int32()))) for c in names[1:]]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists], names)

    def run(batches):
        pair, store = _pair(byte_level, pieces)
        block, size, slices = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            for i, j, length in _slices(batch["text"]):
                if slices and size + length > BLOCK_BYTES:
                    yield row(block, slices)
                    block, size, slices = block + 1, 0, []
                part = batch.slice(i, j - i)
                ids = {"doc_id": part["doc_id"].to_pylist()}
                slices.append(ids | _aligned(pair, store, part["text"].to_pylist(), keep_groups))
                size += length
        if slices:
            yield row(block, slices)

    return map_arrow(docs, run, schema)


def _read(docs: DataFrame, byte_level: str, pieces: str, keep_groups: bool = False) -> DataFrame:
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # a file has a block for each 4 MB of its task's texts: they are read one by one
    return materialize(_block_rows(whole, byte_level, pieces, keep_groups), "aligned-blocks", rows_in_group=1)


def _count(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): the links of each pair in the corpus; best: no pair with
    the same B id has more."""
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(_B_IDS))
    # one row for each id of the B vocabulary
    most = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _pairs(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", F.posexplode(F.arrays_zip("pair", "n")).alias("at", "x")).select("block", "at", "x.pair", "x.n")


def align_documents(docs: DataFrame, byte_level: str, pieces: str, keep_groups: bool = False) -> DataFrame:
    """Align the tokens of two tokenizers in every whole text of ``docs``.

    ``byte_level`` is a byte-level BPE file of the tokenizers library (A), which
    encodes a space and the text; ``pieces`` a sentencepiece model (B), which adds
    the space. Returns doc_id, n_a, n_b, n_groups, n_links (overlapping A-B
    pairs), n_best (links whose pair has the most links among those of its B id,
    over all documents), count_sum (the sum of their pairs' links over all
    documents) and groups_sha256, and ``groups`` themselves where asked for.

    A text that is null, empty, or whose A or B bytes differ from a space and
    itself has no tokens: zeros and empty strings. A null doc_id stays null;
    repeated rows each give a row and count; other columns are ignored. No
    documents, no rows.
    """
    blocks = _read(docs, byte_level, pieces, keep_groups)
    pairs = _pairs(blocks)
    known = pairs.select("block", "at", "pair").join(_count(pairs), "pair").select(F.col("block").alias("of"), "at", "n", "best")
    figures = [*FIGURES, "n_best", "count_sum"]
    schema = f"doc_id long, {', '.join(f'{x} long' for x in figures)}, groups_sha256 string" + ", groups string" * keep_groups

    def add(held: pa.Table, told: pa.Table) -> pa.Table:
        row = held.combine_chunks()
        values = {c: row[c].combine_chunks().values for c in row.column_names if c != "block"}
        at = told["at"].to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = told["n"].to_numpy(), told["best"].to_numpy(zero_copy_only=False)
        place, times = values["place"].to_numpy(), values["times"].to_numpy().astype(np.int64)
        stops = np.concatenate(([0], np.cumsum(values["n_pairs"].to_numpy())))
        sums = [np.diff(np.concatenate(([0], np.cumsum(times * x[place])))[stops]) for x in (best, n)]
        columns = [values["doc_id"], *[values[x].cast(pa.int64()) for x in FIGURES], *map(pa.array, sums), values["groups_sha256"]]
        columns += [values["groups"]] if keep_groups else []
        return pa.Table.from_arrays(columns, ["doc_id", *figures, "groups_sha256", *["groups"] * keep_groups])

    held = blocks.drop("pair", "n")
    return held.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(add, schema)


def link_counts(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(a_id, b_id, n, best) of every linked pair of ids over all documents: the
    table from which embeddings of one vocabulary are carried to the other."""
    pair: Column = F.col("pair")
    counts = _count(_pairs(_read(docs, byte_level, pieces)))
    return counts.select(F.shiftright(pair, ID_BITS).alias("a_id"), pair.bitwiseAND(F.lit(_B_IDS)).alias("b_id"), "n", "best")
