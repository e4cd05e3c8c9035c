"""Toxicity: a lexicon trie crossed with Levenshtein automata, scored in context.

Insulting words and word stems are learned from labelled texts. The lexicon's
trie and the automata for one edit become one deterministic automaton that runs
over all words of a batch at once, so misspelled terms are met too. Each match
is scored by how often matches of its kind, in its context (plain, in quotation
marks, after a reporting word), stand in toxic texts.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.common import fold, map_arrow, materialize

#: About so many labelled rows of each label are drawn, by a hash of doc_id.
TRAIN_TOXIC = 4000
TRAIN_CLEAN = 16000
MIN_SUPPORT = 3
#: A term's share of toxic texts. Its log-likelihood over the base rate must
#: also exceed the logarithm of the terms tried over CHANCE_TERMS, so that about
#: so many pass by chance at most; each still counts with its own rate only.
MIN_PRECISION = 0.8
CHANCE_TERMS = 8
STEM_SIZES = (4, 5, 6, 7, 8)
#: Words a stem must begin.
STEM_WORDS = 3
#: Terms that a task counts before it sends them on.
COUNTED_TERMS = 100_000
#: Shorter terms must be met exactly.
FUZZY_LETTERS = 5
#: Words before a match in which a reporting word makes it a quotation.
CONTEXT_WORDS = 5
THRESHOLD = 0.3

#: Words that report somebody else's speech.
REPORTING = "said says wrote writes quoted quote called calls claimed told reported sagte schrieb nannte dit dijo".split()
QUOTES = "\"'“”„«»‘’`"

PLAIN, QUOTED, REPORTED = 0, 1, 2
N_CONTEXTS = 3

_CODES = 0x110000


def _lowered() -> np.ndarray:
    out = np.arange(_CODES, dtype=np.uint32)
    for c in range(0x530):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


_LOW = _lowered()
#: Words are of letters, their marks and digits in any script; no other space,
#: sign or punctuation joins them.
_WORD = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(_CODES)), bool, _CODES)
_WORD[:128] = tb.ALNUM[:128]
_QUOTE = np.zeros(_CODES, bool)
_QUOTE[[ord(c) for c in QUOTES]] = True
_WORD &= ~_QUOTE


class Text:
    """Lower-cased words of a batch of texts as code points."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.code = _LOW[raw]
        sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        self.starts, self.stops = tb.runs(_WORD[self.code])
        self.doc = np.searchsorted(begins, self.starts, "right") - 1
        self.n = len(texts)

    def words(self, text_range: np.ndarray | None = None) -> list[str]:
        at = np.arange(len(self.starts)) if text_range is None else text_range
        code = self.code
        return [
            code[a:b].tobytes().decode("utf-32-le", "surrogatepass")
            for a, b in zip(self.starts[at].tolist(), self.stops[at].tolist(), strict=True)
        ]

    def hashes(self) -> np.ndarray:
        n = len(self.code)
        mixed = tb.mix(self.code.astype(np.uint64) + np.uint64(1))
        up, down = tb._powers(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * down[:-1])))
        return (sums[self.stops] - sums[self.starts]) * up[self.starts]


class Automaton:
    """The deterministic automaton of all terms with at most one edit.

    A match is numbered: 1 to n for the n terms (words, then stems) met exactly,
    n + 1 for a word and n + 2 for a stem with one edit; 0 is none."""

    def __init__(self, words: list[str], stems: list[str]):
        children: list[dict[str, int]] = [{}]
        whole: dict[int, int] = {}  # node where a word ends, its number
        begun: dict[int, int] = {}  # node where a stem ends
        fuzzy = set()
        self.n_terms = len(words) + len(stems)
        for number, term in enumerate([*words, *stems], 1):
            node = 0
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                node = children[node][c]
            (whole if number <= len(words) else begun)[node] = number
            if len(term) >= FUZZY_LETTERS:
                fuzzy.add(node)
        letters = sorted({c for node in children for c in node})
        self.cls = np.zeros(_CODES, np.uint8 if len(letters) < 255 else np.uint16)
        for k, c in enumerate(letters, 1):
            self.cls[ord(c)] = k

        def close(places: set) -> frozenset:
            """With the letters that a word may leave out."""
            more = {(child, 1) for node, e in places if e == 0 for child in children[node].values()}
            return frozenset(places | more)

        def ended(places, at: dict, edited: int) -> int:
            """The exact term that ends here if any, else the number for an edit."""
            found = [at[n] if e == 0 else edited for n, e in places if n in at and (e == 0 or n in fuzzy)]
            return min(found, default=0)

        def stem_of(places) -> int:
            return ended(places, begun, self.n_terms + 2)

        def word_of(places) -> int:
            return ended(places, whole, self.n_terms + 1)

        first = (close({(0, 0)}), 0)
        numbers = {(frozenset(), 0): 0, first: 1}
        order = [(frozenset(), 0), first]
        table: list[list[int]] = []
        i = 0
        while i < len(order):
            places, stem = order[i]
            row = []
            for c in ["", *letters]:
                step = set()
                for node, e in places:
                    if c in children[node]:
                        step.add((children[node][c], e))
                    if e == 0:
                        step.add((node, 1))  # a letter too many
                        step.update((child, 1) for child in children[node].values())  # another letter
                now = close(step)
                # an exact path makes the same path with an edit spare
                now = frozenset(p for p in now if p[1] == 0 or (p[0], 0) not in now)
                best = [x for x in (stem, stem_of(now)) if x]
                state = (now, min(best, default=0))
                if state not in numbers:
                    numbers[state] = len(order)
                    order.append(state)
                row.append(numbers[state])
            table.append(row)
            i += 1
        self.table = np.array(table, np.int32)
        self.accept = np.zeros(len(order), np.int32)
        # exact words win, then exact stems, then edits
        for k, (p, s) in enumerate(order):
            found = [x for x in (word_of(p), s) if x]
            self.accept[k] = min(found, default=0)

    def match(self, text: Text) -> np.ndarray:
        """Number of the match of each word; 0 for none."""
        out = np.zeros(len(text.starts), np.int32)
        cls = self.cls[text.code]
        live = np.arange(len(text.starts))
        at, stop = text.starts.copy(), text.stops
        state = np.ones(len(live), np.int32)
        while len(live):
            state = self.table[state, cls[at]]
            at = at + 1
            done = at == stop[live]
            out[live[done]] = self.accept[state[done]]
            keep = ~done & (state != 0)
            live, at, state = live[keep], at[keep], state[keep]
        return out


_REPORTING_HASHES = np.sort(Text([" ".join(REPORTING)]).hashes())


def contexts(text: Text, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Context of the words at these places of the batch."""
    out = np.zeros(len(at), np.int64)
    quoted = _QUOTE[text.code[np.maximum(text.starts[at] - 1, 0)]] | _QUOTE[text.code[text.stops[at]]]
    for back in range(1, CONTEXT_WORDS + 1):
        w = np.maximum(at - back, 0)
        ok = (at >= back) & (text.doc[w] == text.doc[at])
        h = hashes[w]
        k = np.minimum(np.searchsorted(_REPORTING_HASHES, h), len(_REPORTING_HASHES) - 1)
        out[ok & (_REPORTING_HASHES[k] == h)] = REPORTED
    out[quoted] = QUOTED
    return out


def cells(texts: list[str], automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, match number * N_CONTEXTS + context) of a batch."""
    text = Text(texts)
    number = automaton.match(text)
    at = np.flatnonzero(number)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cell = number[at].astype(np.int64) * N_CONTEXTS + contexts(text, at, text.hashes())
    pairs = np.unique(np.stack([text.doc[at], cell], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


@dataclass
class Model:
    automaton: Automaton
    chance: np.ndarray  # that a match of this number in this context is abuse
    base: float  # that a text without a match is toxic

    def score(self, texts: list[str]) -> np.ndarray:
        """The chance of the most telling match; without one, the base chance."""
        doc, cell = cells(texts, self.automaton)
        best = np.full(len(texts), -1.0)
        np.maximum.at(best, doc, self.chance[cell])
        return np.where(best < 0, self.base, best)


def _groups(texts: list[str]):
    return tb.groups([x.encode() for x in texts])


def _places(x: str) -> set[tuple[str, str, str]]:
    """(term, word before, whole word) of the words and stems of a text."""
    text = Text([x])
    words = text.words()
    out = set(zip(words, ["", *words], words, strict=False))
    return out | {(w[:n] + "*", before, w) for w, before, _ in out for n in STEM_SIZES if len(w) > n}


def _count_texts(rows: DataFrame, wanted=None) -> DataFrame:
    """In how many texts each word and stem (each wanted one) stands."""

    def rows_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"]
        )

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for x in batch["text"].to_pylist():
                terms = {t for t, _, _ in _places(x)}
                counts.update(terms if wanted is None else terms & wanted.value)
                if len(counts) > COUNTED_TERMS:
                    yield rows_of(counts)
                    counts.clear()
            yield rows_of(counts)

    return map_arrow(rows.select("text"), run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _count_places(rows: DataFrame, wanted) -> DataFrame:
    """After how many different words each wanted term stands, and in how many
    forms. A passage that many texts share counts once so."""

    def run(batches):
        for batch in batches:
            met: set = set()
            for x in batch["text"].to_pylist():
                met.update(m for m in _places(x) if m[0] in wanted.value)
            columns = list(zip(*met, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["term", "before", "word"])

    places = map_arrow(rows.select("text"), run, "term string, before string, word string")
    return places.groupBy("term").agg(F.count_distinct("before").alias("n"), F.count_distinct("word").alias("forms"))


def _evidence(p: int, n: int, base: float) -> float:
    rate = p / (p + n)
    out = p * math.log(rate / base)
    if n:
        out += n * math.log((1 - rate) / (1 - base))
    return out if rate > base else 0.0


def _lexicon(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    spark = toxic.sparkSession
    # a bounded list: terms of at least MIN_SUPPORT texts of a bounded sample
    p = {r["term"]: r["n"] for r in _count_texts(toxic).where(F.col("n") >= MIN_SUPPORT).collect()}
    sent = spark.sparkContext.broadcast(set(p))
    n = {r["term"]: r["n"] for r in _count_texts(clean, sent).collect()}
    forms = {}
    for r in _count_places(toxic, sent).collect():
        p[r["term"]], forms[r["term"]] = min(p[r["term"]], r["n"]), r["forms"]
    base = n_toxic / (n_toxic + n_clean)
    least, good = math.log(max(2, len(p) / CHANCE_TERMS)), {}
    for term, k in p.items():
        against = n.get(term, 0)
        evidence = _evidence(k, against, base)
        if k / (k + against) >= MIN_PRECISION and evidence >= least:
            good[term] = evidence
    stems: list[str] = []
    for term in sorted((t[:-1] for t in good if t.endswith("*")), key=lambda t: (-good[t + "*"], -len(t), t)):
        related = any(term.startswith(x) or x.startswith(term) for x in stems)
        if forms[term + "*"] >= STEM_WORDS and not related:
            stems.append(term)
    words = [t for t in good if not t.endswith("*") and not t.startswith(tuple(stems))]
    return sorted(words), sorted(stems)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows outside fold 2, a bounded sample of each label.

    Of several texts under one doc_id, the smallest counts; an id with both
    labels counts for both. Without toxic rows, the lexicon is empty and every
    score is 0."""
    usable = labels.select("doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").distinct()
    usable = usable.where(fold(F.col("doc_id")) != 2)
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30))
    rate = [int(min(1, most / max(1, sizes.get(k, 0))) * (1 << 30)) for k, most in ((0, TRAIN_CLEAN), (1, TRAIN_TOXIC))]
    drawn = usable.where(draw < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    # a bounded number of ids, whatever the size of the tables
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    sample = materialize(
        texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"),
        "toxicity-sample",
    )
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    words, stems = _lexicon(toxic, clean, n_toxic, n_clean) if n_toxic and n_clean else ([], [])
    automaton = Automaton(words, stems)
    sent = docs.sparkSession.sparkContext.broadcast(automaton)
    width = (len(words) + len(stems) + 3) * N_CONTEXTS

    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            met: Counter = Counter()
            for a, b in _groups(texts):
                doc, cell = cells(texts[a:b], sent.value)
                met.update(cell.tolist())
                met[-1] += b - a - len(np.unique(doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(met), pa.int64()), pa.array(list(met.values()), pa.int64())], ["cell", "n"]
            )

    def count(part: DataFrame, factor: float) -> np.ndarray:
        out = np.zeros(width + 1)
        summed = map_arrow(part.select("text"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        for row in summed.collect():  # at most one row for each term and context
            out[row["cell"]] = row["n"] * factor
        return out

    pos = count(toxic, sizes.get(1, 0) / max(1, n_toxic))
    neg = count(clean, sizes.get(0, 0) / max(1, n_clean))
    n = [sizes.get(1, 0), sizes.get(0, 0)]
    base = (n[0] + 1) / (sum(n) + 2)
    rate = lambda p, q: (p + base) / (p + q + 1)
    p, q = pos[:-1].reshape(-1, N_CONTEXTS), neg[:-1].reshape(-1, N_CONTEXTS)
    # A term's own rate where it stands plainly; what a context takes from it is
    # learned over all terms.
    plain = rate(p[:, PLAIN], q[:, PLAIN])
    less = np.array([min(1.0, rate(p[:, c].sum(), q[:, c].sum()) / rate(p[:, 0].sum(), q[:, 0].sum())) for c in range(N_CONTEXTS)])
    chance = (plain[:, None] * less[None]).reshape(-1)
    return Model(automaton, chance, float(rate(pos[-1], neg[-1]) if n_toxic else 0.0))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    ``score`` is the chance of the text's most telling match; a text without a
    match, as a null or empty one, has the base chance of such texts.
    ``predicted`` is 1 from THRESHOLD on. ``held_out`` is null without a doc_id.
    Each input row gives one row; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col("doc_id").cast("long"), (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("text").cast("string").alias("text")
    )

    def run(batches):
        fitted = sent.value
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            scores = [fitted.score(texts[a:b]) for a, b in _groups(texts)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["held_out"],
                    pa.array(score, pa.float64()),
                    pa.array((score >= THRESHOLD).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")
