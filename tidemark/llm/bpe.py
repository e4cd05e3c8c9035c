"""BPE encoding by forced-boundary splitting, and decoding.

Byte pairs that never stand inside any vocabulary token mark certain cuts: no
merge can ever cross them. Pieces are cut there into fragments, all fragments
of a batch are merged side by side in numpy, and their ids are concatenated.
The result equals the tokenizers library's encode and decode of the same file.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm.common import map_arrow

#: What a worker keeps of chunks (runs without white space) that it has met, in
#: bytes of each of two generations; longer chunks are not kept.
KEPT_BYTES = 48 << 20
KEPT_CHARS = 64
#: New chunks encoded together, and their characters.
MISS_BLOCK = 20_000
MISS_CHARS = 200_000
#: Bytes whose fragments are merged side by side.
MERGE_BYTES = 256 << 10

_NONE = np.int32(2**31 - 1)
#: Latin letters, digits and marks that NFC and the case rules treat one by one.
_PLAIN = re.compile(r"[\x21-\x7e¡-įı-ňŊ-ž]*")
#: Python splits at these, the tokenizer's white space does not hold them.
_PLAIN_LINES = re.compile(_PLAIN.pattern.replace("[", "[\\n", 1))
_PLAIN_TEXT = re.compile(_PLAIN.pattern.replace("[", r"[ \t\n\r", 1))
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
#: A whole plain text, in Arrow's dialect.
_PLAIN_ARROW = rf"\A{_PLAIN_TEXT.pattern}\z"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(extra)) for b in range(256)]


def check_vocabulary(library: Tokenizer) -> Tokenizer:
    """The tokenizer, if texts may be encoded by their chunks without white space.

    It has to drop white space, never join over it, and begin its added tokens
    with ``<|``; any other file raises."""

    def ids(text: str) -> list[int]:
        return library.encode(text, add_special_tokens=False).ids

    if ids("one two") != ids("one") + ids("two") or ids(" \tone\n\n") != ids("one") or ids(" \n") != []:
        raise ValueError("this tokenizer keeps white space or joins over it")
    if odd := [t.content for t in library.get_added_tokens_decoder().values() if not t.content.startswith("<|")]:
        raise ValueError(f"added tokens that don't begin with <|: {odd[:3]}")
    return library


class ForcedBoundaryBPE:
    """Encoder and decoder of one ``tokenizers`` BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = check_vocabulary(Tokenizer.from_file(path))
        self.end = model["end_of_word_suffix"] or ""
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.lines = regex.compile(rf"\n|{split}")
        vocab = model["vocab"]
        self.tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        self.added_split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.first = np.array([vocab[c] for c in symbols], np.int32)
        self.last = np.array([vocab[c + self.end] for c in symbols], np.int32)
        self._merge_table(model["merges"], vocab)
        self._cut_table(vocab)
        self.cache: dict[str, tuple] = {}

    def _merge_table(self, merges, vocab) -> None:
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        size = 1 << 20
        self.mask, self.keys = size - 1, np.full(size, -1, np.int64)
        self.rank_at, self.made = np.full(size, _NONE, np.int32), made
        for rank, key in enumerate((left << 17 | right).tolist()):
            slot = self._slot(key)
            while self.keys[slot] != -1:
                slot = slot + 1 & self.mask
            self.keys[slot], self.rank_at[slot] = key, rank

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 13) & self.mask

    def _cut_table(self, vocab) -> None:
        """inside[a * 256 + b]: the byte pair ab stands inside some token."""
        inside = np.zeros(65536, bool)
        for token in vocab:
            b = [self.byte_of[c] for c in token.removesuffix(self.end)]
            for x, y in zip(b, b[1:], strict=False):
                inside[x << 8 | y] = True
        self.inside = inside

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 17 | b
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.rank_at[slot], _NONE)
        open_ = np.flatnonzero((held != key) & (held != -1))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.rank_at[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.first[data]
        ends = np.cumsum(lengths) - 1
        ids[ends] = self.last[data[ends]]
        # A fragment ends with its piece and at every certain cut.
        cut = np.ones(len(data), bool)
        cut[:-1] = ~self.inside[data[:-1].astype(np.int32) << 8 | data[1:]]
        cut[ends] = True
        stops = np.flatnonzero(cut) + 1
        out, left, a = [], np.zeros(len(data), bool), 0
        while a < len(data):  # whole fragments, about MERGE_BYTES of them
            b = int(stops[min(np.searchsorted(stops, a + MERGE_BYTES), len(stops) - 1)])
            got, at = self._merge_fragments(ids[a:b], cut[a:b])
            out.append(got)
            left[at + a] = True
            a = b
        before = np.concatenate(([0], np.cumsum(left)))
        return np.concatenate(out), before[ends + 1] - before[ends + 1 - lengths]

    def _merge_fragments(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids after all merges, in order, and the place where each begins."""
        frag = np.zeros(len(ids), np.int32)
        np.cumsum(cut[:-1], out=frag[1:])
        rank = np.full(len(ids), _NONE, np.int32)
        rank[:-1] = np.where(cut[:-1], _NONE, self._ranks(ids[:-1], ids[1:]))
        done_ids, done_at = [], []
        at = np.arange(len(ids))
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1])))
            sizes = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least != _NONE, sizes)
            least = np.repeat(least, sizes)
            if not live.all():  # fragments without a merge are finished
                done_ids.append(ids[~live])
                done_at.append(at[~live])
                ids, at, frag, rank, least = ids[live], at[live], frag[live], rank[live], least[live]
            if not len(ids):
                break
            hit = rank == least
            if (hit[1:] & hit[:-1]).any():  # of overlapping places (aaa) the leftmost goes first
                run = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), run, 0))
                hit &= (run - begin) % 2 == 0
            spots = np.flatnonzero(hit)
            ids[spots] = self.made[rank[spots]]
            keep = np.ones(len(ids), bool)
            keep[spots + 1] = False
            moved = hit[keep]
            ids, at, frag, rank = ids[keep], at[keep], frag[keep], rank[keep]
            moved[:-1] |= moved[1:]
            t = np.flatnonzero(moved)
            rank[t] = _NONE
            t = t[t + 1 < len(ids)]
            t = t[frag[t] == frag[t + 1]]
            rank[t] = self._ranks(ids[t], ids[t + 1])
        ids, at = np.concatenate(done_ids), np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        return ids[order], at[order]

    def _pieces(self, chunk: str) -> list:
        """Byte pieces of one chunk of any script; an added token stands as its id."""
        out: list = []
        for part in self.added_split.split(chunk) if self.added_split else [chunk]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                    out.append(bytes(self.byte_of[c] for c in piece))
        return out

    def encode_block(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks (no white space inside) one after the other, and
        where each one's ids end."""
        joined = "\n".join(chunks)
        if _PLAIN_LINES.fullmatch(joined) and "<|" not in joined:
            plain, odd = chunks, []
        else:
            is_plain = [bool(_PLAIN.fullmatch(c)) and "<|" not in c for c in chunks]
            plain = [c for c, ok in zip(chunks, is_plain, strict=True) if ok]
            odd = [(i, c) for i, c in enumerate(chunks) if not is_plain[i]]
            joined = "\n".join(plain)
        found = self.lines.findall(joined.lower()) if plain else []
        owner = np.cumsum(np.fromiter(("\n" == p for p in found), np.int64, len(found)))
        pieces = [p.encode() for p in found if p != "\n"]
        owner = owner[np.fromiter(("\n" != p for p in found), bool, len(found))]
        spot = np.arange(len(chunks))
        if odd:
            spot = np.delete(spot, [i for i, _ in odd])
        owner = spot[owner] if len(owner) else owner
        fixed: list[tuple[int, int]] = []  # (number of the piece, id) of added tokens
        more: list[int] = []
        for i, chunk in odd:
            for p in self._pieces(chunk):
                if p.__class__ is int:
                    fixed.append((len(pieces), p))
                    p = b"\0"
                pieces.append(p)
                more.append(i)
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(chunks), np.int64)
        owner = np.concatenate([owner, np.array(more, np.int64)])
        ids, counts = self.merge(pieces)
        firsts = np.cumsum(counts) - counts
        for k, token in fixed:  # the stand-in is one byte, so one id
            ids[firsts[k]] = token
        of = np.repeat(owner, counts)
        if odd:
            order = np.argsort(of, kind="stable")
            ids, of = ids[order], of[order]
        return ids, np.cumsum(np.bincount(of, minlength=len(chunks)))

    def encode(self, text: str | None) -> np.ndarray:
        words = chunks_of(text)
        block = list(set(words))
        ids, stops = self.encode_block(block)
        got = dict(zip(block, np.split(ids, stops[:-1]), strict=True)) if block else {}
        return np.concatenate([np.zeros(0, np.int32), *map(got.__getitem__, words)])

    def decode(self, ids: Iterable[int]) -> str:
        """As the library: without a decoder, token strings joined by a space."""
        return " ".join(map(self.tokens.__getitem__, ids))


def chunks_of(text: str | None) -> list[str]:
    """The runs without white space, which the tokenizer drops. Case is folded
    where the tokenizer's own folding is sure to do the same."""
    if not text:
        return []
    if _PLAIN_TEXT.fullmatch(text) and "<|" not in text:
        return text.lower().split()
    if _ODD_SPACE.search(text):
        return [c for c in re.split(r"[ \t\n\r]+", text) if c]
    return text.split()


def chunk_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``chunks_of`` all texts in one array, where each text's begin in it and how
    many they are; empty chunks may stand among them."""
    texts = pc.fill_null(texts, "")
    plain = pc.and_not(pc.match_substring_regex(texts, _PLAIN_ARROW), pc.match_substring(texts, "<|"))
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(plain)))
    odd = list(map(chunks_of, texts.filter(pc.invert(plain)).to_pylist()))
    is_plain = plain.to_numpy(zero_copy_only=False)
    sizes = np.zeros(len(texts), np.int64)
    sizes[is_plain] = np.diff(lists.offsets.to_numpy())
    sizes[~is_plain] = np.fromiter(map(len, odd), np.int64, len(odd))
    chunks = lists.flatten()
    if odd:
        chunks = pa.concat_arrays([chunks, pa.array(chain.from_iterable(odd), chunks.type)])
    order, starts = np.argsort(~is_plain, kind="stable"), np.zeros(len(texts), np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    return chunks, starts, sizes


def joined(chunks: pa.Array, size: int, between: str) -> list[str]:
    """Chunks joined by ``size``."""
    stops = pa.array([*range(0, len(chunks), size), len(chunks)], pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(stops, chunks), between).to_pylist()


def strings(chunks: pa.Array) -> list[str]:
    """Chunks as a list; they hold no white space."""
    return joined(chunks, len(chunks), "\n")[0].split("\n") if len(chunks) else []


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places in the ranges, one range after the other."""
    stops = np.cumsum(sizes)
    return np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)


def is_word(chunk: str) -> bool:
    """Letters that NFC and the case rules treat one by one, and nothing else."""
    return chunk.isalpha() and (chunk.isascii() or _PLAIN.fullmatch(chunk) is not None)


#: Every letter that a word may have, and a word with the marks after it.
LETTERS = "".join(filter(is_word, map(chr, range(0x180))))
WORD_AND_MARKS = rf"\A(?P<word>[{LETTERS}]+)(?P<marks>[{re.escape(string.punctuation)}]*)\z"
#: Code point of the character that stands for each byte; a space stays.
_SPELLED = np.array(list(map(ord, byte_symbols())), "<u4")
_SPELLED[0x20] = 0x20


def spell(words: str) -> str:
    """Words with a space between them in the characters of a byte-level vocabulary."""
    low = words.lower()
    return low if low.isascii() else _SPELLED[np.frombuffer(low.encode(), np.uint8)].tobytes().decode("utf-32-le")


def word_library(library: Tokenizer) -> Tokenizer | None:
    """The library with the same model for words that are spelled already; None if
    its own rules do more to letters, or don't part a word from marks after it."""

    def pieces(text: str) -> list[str]:
        return [p for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]

    if not (library.normalizer and library.pre_tokenizer and getattr(library.model, "end_of_word_suffix", None)):
        return None
    if pieces(LETTERS) != [spell(LETTERS)] or any(
        pieces(c + m) != [spell(c), *pieces(m)] for c in LETTERS for m in string.punctuation
    ):
        return None
    words = Tokenizer(library.model)
    words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return check_vocabulary(words)


class Kept:
    """What ``make`` gives for chunks, kept in two generations of bounded size.

    Chunks of the older one that are met again move on to the younger; when that
    is full, the older one goes. Chunks over KEPT_CHARS are made for one batch."""

    def __init__(self, make, size, most: int = KEPT_BYTES):
        self.make, self.size, self.most = make, size, most
        self.young, self.old, self.bytes, self.brief = {}, {}, 0, []

    def of(self, texts: list[list[str]]) -> dict:
        """Values of all chunks of these texts, until the next call."""
        for c in self.brief:
            del self.young[c]
        self.brief = []
        if self.bytes > self.most:
            self.old, self.young, self.bytes = self.young, {}, 0
        need = set().union(*texts).difference(self.young)
        again = need & self.old.keys()
        for c in again:
            self.young[c] = self.old.pop(c)
        self.bytes += sum(self.size(c, self.young[c]) for c in again)
        for block in _blocks(sorted(need - again)):
            for c, value in zip(block, self.make(block), strict=True):
                self.young[c] = value
                if len(c) > KEPT_CHARS:
                    self.brief.append(c)
                else:
                    self.bytes += self.size(c, value)
        return self.young


def _blocks(chunks: list[str]):
    block, size = [], 0
    for c in chunks:
        if block and (size + len(c) > MISS_CHARS or len(block) == MISS_BLOCK):
            yield block
            block, size = [], 0
        block.append(c)
        size += len(c)
    if block:
        yield block


_LOADED: dict[tuple[str, str], Kept] = {}


def kept(path: str, use: str, start) -> Kept:
    """One store for each worker, file and kind of value; ``start`` makes it."""
    if (path, use) not in _LOADED:
        _LOADED[path, use] = start()
    return _LOADED[path, use]


def _texts_of_ids(path: str) -> Kept:
    bpe = ForcedBoundaryBPE(path)

    def make(block: list[str]):
        ids, stops = bpe.encode_block(block)
        ids, a = ids.tolist(), 0
        numbers, tokens = list(map(str, ids)), list(map(bpe.tokens.__getitem__, ids))
        for b in stops.tolist():
            yield " ".join(numbers[a:b]), " ".join(tokens[a:b])
            a = b

    # two strings, a tuple, the key and a place in a dictionary
    return Kept(make, lambda c, value: 370 + 2 * len(c) + len(value[0]) + len(value[1]))


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False, keep_decoded: bool = False) -> DataFrame:
    """Encode and decode every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256, and ids or decoded
    themselves where asked for. A null text counts as empty: no tokens, digests
    of the empty string. A null doc_id stays null; repeated rows each give a
    row; other columns of ``docs`` are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_decoded

    def run(batches):
        store = kept(path, "text", lambda: _texts_of_ids(path))
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            texts = list(map(chunks_of, batch["text"].to_pylist()))
            cache = store.of(texts)
            for words in texts:
                got = [g for g in map(cache.__getitem__, words) if g[0]]
                ids = " ".join([g[0] for g in got])
                decoded = " ".join([g[1] for g in got])
                cols[0].append(ids.count(" ") + (ids != ""))
                cols[1].append(hashlib.sha256(ids.encode()).hexdigest())
                cols[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    cols[3].append(np.array(ids.split(), np.int32))
                if keep_decoded:
                    cols[4].append(decoded)
            arrays = [batch["doc_id"], pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:3]]]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(cols[3], pa.list_(pa.int32())))
                names.append("ids")
            if keep_decoded:
                arrays.append(pa.array(cols[4], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
