"""Quality rules: counts, and distance of a text's histograms from its language.

Every document's histogram of character classes and of common words is compared
with the reference of its language (the sums over all documents of it) by the
Jensen-Shannon distance. Texts under a minimum length are not judged by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.common import arrow_column, fresh, map_arrow, struct_array

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: Texts with fewer words have no reliable histograms.
MIN_JUDGED_WORDS = 50
#: A language needs this many words over all its documents to be a reference.
MIN_REFERENCE_WORDS = 2000
#: Languages that have a reference at most: those of most words.
MAX_LANGUAGES = 1000
#: Jensen-Shannon distances (base 2 logarithm, 0 to 1) beyond which a text goes.
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.55

#: Frequent function words of four languages.
COMMON_WORDS = (
    "the of and to in a is that it was for on are as with be by this have or an "
    "der die und das ist nicht zu den mit von sich auf für ein eine im dem des "
    "le la les et des du en un une que est pour dans qui pas sur au avec "
    "el los las de y no por con su se del al una lo como más"
).split()

SYMBOLS = b"#*$%&|<>"
#: Character classes: lower, upper, digit, white space, stop marks, other marks,
#: symbols, control, letters of two bytes, other lead bytes, tail bytes.
N_CLASSES = 11
SYMBOL_CLASS = 6
_TAIL = N_CLASSES - 1


def _classes() -> np.ndarray:
    out = np.full(256, 5, np.uint8)
    out[0:32], out[127] = 7, 7
    out[48:58], out[65:91], out[97:123] = 2, 1, 0
    out[[32, 9, 10, 11, 12, 13]] = 3
    out[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    out[list(SYMBOLS)] = 6
    out[0xC0:0xE0], out[0xE0:], out[0x80:0xC0] = 8, 9, _TAIL
    return out


CLASS_OF = _classes()


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    words = sorted(set(COMMON_WORDS))
    data, begins = tb.pack([w.encode() for w in words])
    hashes = tb.Rolling(data).spans(begins[:-1], begins[1:] - 1)
    order = np.argsort(hashes)
    return hashes[order], order


N_WORDS = len(set(COMMON_WORDS))
#: Counts of a histogram: classes, common words, all other words.
WIDTH = N_CLASSES + N_WORDS + 1


def measure(raws: list[bytes]) -> dict[str, np.ndarray]:
    """Counts and histograms of each text; large arrays go as soon as they are used."""
    data, begins = tb.pack(raws)
    n = len(raws)
    of_byte = np.repeat(np.arange(n, dtype=np.int32), np.diff(begins))
    histograms = _histograms(data, of_byte, n)
    inside = tb.SPACED[data]
    starts, stops = tb.runs(inside)
    inside &= CLASS_OF[data] != _TAIL
    word_chars = np.bincount(of_byte[inside], minlength=n)
    del inside
    doc = of_byte[starts]
    n_words = np.bincount(doc, minlength=n)

    rolling = tb.Rolling(data)
    lines = np.flatnonzero(data == 10)
    line_starts = np.concatenate(([0], lines[:-1] + 1))
    # a line has a word if one begins before its end and not before its start
    full = np.searchsorted(starts, lines) > np.searchsorted(starts, line_starts)
    line_starts, lines = line_starts[full], lines[full]
    line_doc = of_byte[line_starts]
    del of_byte
    key = tb.mix(rolling.spans(line_starts, lines) + line_doc.astype(np.uint64))
    first = np.ones(len(key), bool)
    order = np.argsort(key, kind="stable")
    first[order[1:]] = key[order[1:]] != key[order[:-1]]
    n_dup_lines = np.bincount(line_doc[~first], minlength=n)

    window = tb.chain(rolling.spans(starts, stops), REPEAT_WINDOW)
    del rolling
    at = np.flatnonzero(doc[: len(window)] == doc[REPEAT_WINDOW - 1 :]) if len(window) else np.zeros(0, np.int64)
    key = tb.mix(window[at] + doc[at].astype(np.uint64))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    depth = np.zeros(len(starts) + 1, np.int32)
    np.add.at(depth, at[twice], 1)
    np.add.at(depth, at[twice] + REPEAT_WINDOW, -1)
    n_repeat = np.bincount(doc[np.cumsum(depth[:-1]) > 0], minlength=n)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": histograms[:, SYMBOL_CLASS],
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "classes": histograms[:, :N_CLASSES],
        "words": histograms[:, N_CLASSES:],
    }


_COMMON = _common_hashes()


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of two arrays of counts."""
    p = a / np.maximum(a.sum(-1, keepdims=True), 1)
    q = b / np.maximum(b.sum(-1, keepdims=True), 1)
    m = (p + q) / 2

    def part(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(-1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Histograms of each language, summed over all whole texts that have one.

    Of the languages with MIN_REFERENCE_WORDS, the MAX_LANGUAGES with most words
    reach the driver, chosen in Spark, so a column of other values can't fill it.
    """

    def rows_of(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        counts = pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), counts], ["lang", "counts"])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            names = sorted(set(langs))
            number = {x: k for k, x in enumerate(names)}
            which = np.array([number[x] for x in langs], np.int64)
            total = np.zeros((len(names), WIDTH), np.int64)
            raws = tb.encode(batch["text"].to_pylist())
            for a, b in tb.groups(raws):
                data, begins = tb.pack(raws[a:b])
                of_byte = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(begins))
                np.add.at(total, which[a:b], _histograms(data, of_byte, b - a))
            for x, k in number.items():
                sums[x] = sums.get(x, 0) + total[k]
            if len(sums) > MAX_LANGUAGES:
                yield rows_of(sums)
                sums.clear()
        yield rows_of(sums)

    known = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang is not null and text is not null")
    rows = map_arrow(known, run, "lang string, counts array<bigint>")
    total = rows.groupBy("lang").agg(*[F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(WIDTH)])
    n_words = sum((F.col(f"c{i}") for i in range(N_CLASSES, WIDTH)), F.lit(0))
    best = total.where(n_words >= MIN_REFERENCE_WORDS).orderBy(n_words.desc(), "lang").limit(MAX_LANGUAGES)
    return {row[0]: (np.array(row[1 : 1 + N_CLASSES], np.int64), np.array(row[1 + N_CLASSES :], np.int64)) for row in best.collect()}


def _histograms(data: np.ndarray, of_byte: np.ndarray, n: int) -> np.ndarray:
    """Character classes and common words of each text in one row of WIDTH counts."""
    kind = of_byte * np.int32(N_CLASSES)
    kind += CLASS_OF[data]
    classes = np.bincount(kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    del kind
    classes[:, 3] -= 1  # the newline that pack() puts after each text
    low = tb.LOWERED[data]
    a, b = tb.runs(tb.ALNUM[low])
    hashes, order = _COMMON
    found = tb.Rolling(low).spans(a, b)
    slot = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    word = np.where(hashes[slot] == found, order[slot], N_WORDS)
    words = np.bincount(of_byte[a] * np.int64(N_WORDS + 1) + word, minlength=n * (N_WORDS + 1)).reshape(n, N_WORDS + 1)
    return np.concatenate([classes, words], 1)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = [*[f"{k} bigint" for k in COUNTS], "base_failed boolean", "class_distance double", "word_distance double", "kept boolean"]


def verdict_of(docs: DataFrame) -> Column:
    """A struct column with the counts, distances and verdict of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(references(docs))

    def run(batches):
        refs = sent.value
        for texts, langs in batches:
            raws, names = tb.encode(texts.to_pylist()), langs.to_pylist()
            found = [judge(raws[a:b], names[a:b], refs) for a, b in tb.groups(raws)] or [judge([], [], refs)]
            whole = {k: np.concatenate([x[k] for x in found]) for k in found[0]}
            yield struct_array({k: pa.array(x, mask=np.isnan(x) if x.dtype == float else None) for k, x in whole.items()})

    columns = F.col("text").cast("string"), F.col("lang").cast("string")
    return arrow_column(docs.sparkSession, run, f"struct<{', '.join(VERDICT)}>", *columns)


def judge(raws: list[bytes], langs: list[str | None], refs: dict) -> dict[str, np.ndarray]:
    """The fields of the verdict for a group of texts; NaN stands for null."""
    m = measure(raws)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    far = []
    for k, name in enumerate(("classes", "words")):
        d = np.full(len(raws), np.nan)
        for lang in set(langs) & set(refs):
            at = np.array([i for i, x in enumerate(langs) if x == lang])
            d[at] = distance(m[name][at], refs[lang][k][None])
        d[m["n_words"] < MIN_JUDGED_WORDS] = np.nan
        far.append(d)
    away = (far[0] > MAX_CLASS_DISTANCE) | (far[1] > MAX_WORD_DISTANCE)
    counts = {k: m[k].astype(np.int64) for k in COUNTS}
    return {**counts, "base_failed": failed, "class_distance": far[0], "word_distance": far[1], "kept": ~failed & ~away}


def judge_quality(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, class_distance, word_distance and kept; input
    columns of these names give way to them.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``base_failed``: fewer than MIN_WORDS words,
    or over MAX_REPEAT_PERCENT of the words lie in 5-word windows found twice.
    ``kept`` is false if base_failed, or if a text of MIN_JUDGED_WORDS or more
    lies beyond MAX_CLASS_DISTANCE or MAX_WORD_DISTANCE of its language. The
    distances are null where the language is null or has no reference, and for
    short texts; such texts are judged by the base rules alone. Null texts have
    no words. Each input row gives one row.
    """
    fields = [f.split()[0] for f in VERDICT]
    others = [c for c in docs.columns if c not in fields]
    held = fresh(docs.columns, "_verdict")
    return docs.withColumn(held, verdict_of(docs)).select(*[F.col(f"`{c}`") for c in others], f"{held}.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that judge_quality keeps, with their own columns."""
    held = fresh(docs.columns, "_verdict")
    return docs.withColumn(held, verdict_of(docs)).where(F.col(f"{held}.kept")).drop(held)
