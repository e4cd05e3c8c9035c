"""Language identification: averaged hashed subword embeddings, linear softmax.

Byte n-grams inside words are hashed to buckets; a text is the mean of their
embeddings, and a linear softmax on it is trained with the embeddings by
stochastic gradient descent in numpy. A temperature fitted on texts kept back
from training calibrates the scores, and a floor on them rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbytes as tb
from tidemark.llm.common import fold, map_arrow, materialize

BUCKET_BITS = 15
N_BUCKETS = 1 << BUCKET_BITS
DIMENSION = 12
#: About so many labelled rows of each language are drawn, by a hash of doc_id.
TRAIN_ROWS_PER_LANGUAGE = 500
#: Labelled rows of all languages together, about: with very many languages, each
#: has fewer of them.
TRAIN_ROWS = 200_000
EPOCHS = 6
MINIBATCH = 16
RATE = 4.0
#: Share of the sample that calibrates instead of training.
CALIBRATION_PERCENT = 20
#: Of the calibration texts over the floor, at most this share may be wrong.
ACCEPTED_ERROR = 0.01
UNKNOWN = "und"

_FOLDED = tb.LOWERED.copy()
_FOLDED[:65] = 32  # marks, digits and controls separate words
_FOLDED[91:97] = 32
_FOLDED[123:128] = 32


def ngrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3- and 4-byte n-grams within words, and the place of each
    one's second byte, which is never white space. Every text ends with a newline
    and one stands before the first, so a text's grams don't depend on others."""
    data = np.concatenate((np.array([10], np.uint8), data))
    low = _FOLDED[data]
    accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    low[1:][accented] += 32  # Latin capitals with accents
    low = low.astype(np.uint32)
    space = low == 32
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    three = low[:-2] | low[1:-1] << 8 | low[2:] << 16
    in3 = ~space[1:-1] & ~(space[:-2] & space[2:])
    four = three[:-1] | low[3:] << 24
    in4 = ~space[1:-2] & ~space[2:-1]
    shift = np.uint32(32 - BUCKET_BITS)
    a = (three * np.uint32(0x9E3779B1)) >> shift
    b = ((four ^ four >> np.uint32(15)) * np.uint32(0x85EBCA6B)) >> shift
    at3, at4 = np.flatnonzero(in3), np.flatnonzero(in4)
    return np.concatenate([a[at3], b[at4]]).astype(np.int64), np.concatenate([at3, at4])


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # of each bucket for each language
    temperature: float
    floor: float

    def predict(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language of each text and its probability."""
        data, begins = tb.pack(raws)
        buckets, at = ngrams(data)
        of = np.repeat(np.arange(len(raws)), np.diff(begins))[at]
        n = np.maximum(np.bincount(of, minlength=len(raws)), 1)
        k = len(self.languages)
        z = np.stack([np.bincount(of, self.scores[buckets, c], len(raws)) / n for c in range(k)], 1)
        p = softmax(z / self.temperature)
        return p.argmax(1), p.max(1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sample(docs: DataFrame) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, draw 0-99, buckets, counts) of a bounded sample of labelled rows.

    The rate of each language follows from its row count, so about
    TRAIN_ROWS_PER_LANGUAGE rows of each are drawn, or fewer where that would be
    over TRAIN_ROWS in all; rows that repeat a doc_id count once. A text reaches the driver as
    its bucket counts, at most N_BUCKETS of them."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        (fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = materialize(known.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    each = min(TRAIN_ROWS_PER_LANGUAGE, max(1, TRAIN_ROWS // max(1, sizes.count())))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30))
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(100)).cast("int")
    drawn = (
        known.join(sizes, "lang")
        .where(draw * F.col("rows") < F.lit(float(each << 30)))
        .groupBy("lang", "doc_id")
        .agg(F.min("text").alias("text"))
        .select("lang", part.alias("part"), "text")
    )

    def run(batches):
        for batch in batches:
            buckets, counts = [], []
            for raw in tb.encode(batch["text"].to_pylist()):
                b, c = np.unique(ngrams(tb.pack([raw])[0])[0], return_counts=True)
                buckets.append(b.astype(np.int32))
                counts.append(c.astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["lang"], batch["part"], pa.array(buckets, kind), pa.array(counts, kind)],
                ["lang", "part", "buckets", "counts"],
            )

    rows = map_arrow(drawn, run, "lang string, part int, buckets array<int>, counts array<int>").toArrow()
    out = []
    for lang, part, b, c in zip(*(rows[x] for x in rows.column_names), strict=True):
        if len(b):
            out.append((lang.as_py(), part.as_py(), b.values.to_numpy(), c.values.to_numpy()))
    out.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2][:8].tolist()))
    return out


def train(docs: DataFrame, seed: int = 7) -> Model | None:
    """Fit on ``docs`` (doc_id, text, lang); None where no labelled text has a word."""
    rows = _sample(docs)
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    fit = [r for r in rows if r[1] >= CALIBRATION_PERCENT] or rows
    held = [r for r in rows if r[1] < CALIBRATION_PERCENT] or rows
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (N_BUCKETS, DIMENSION))
    linear = rng.normal(0, 0.1, (DIMENSION, len(languages)))
    n_steps = EPOCHS * -(-len(fit) // MINIBATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for i in range(0, len(order), MINIBATCH):
            some = [fit[k] for k in order[i : i + MINIBATCH]]
            y = np.array([languages.index(r[0]) for r in some])
            index = np.concatenate([r[2] for r in some])
            weight = np.concatenate([r[3] / r[3].sum() for r in some])
            of = np.repeat(np.arange(len(some)), [len(r[2]) for r in some])
            heads = np.searchsorted(of, np.arange(len(some)))
            x = np.add.reduceat(embed[index] * weight[:, None], heads)
            p = softmax(x @ linear)
            p[np.arange(len(y)), y] -= 1
            rate = RATE * (1 - step / n_steps) / len(some)
            grad = p @ linear.T
            linear -= rate * x.T @ p
            np.subtract.at(embed, index, rate * 20 * weight[:, None] * grad[of])
            step += 1
    scores = embed @ linear
    z = np.stack([(scores[r[2]] * (r[3] / r[3].sum())[:, None]).sum(0) for r in held])
    y = np.array([languages.index(r[0]) for r in held])
    grid = np.geomspace(0.05, 5, 40)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature)
    top, right = p.max(1), p.argmax(1) == y
    floor = 0.0
    for cut in np.sort(np.append(top, 0.0)):
        over = top >= cut
        if not over.any() or (~right[over]).mean() <= ACCEPTED_ERROR:
            floor = float(cut) if (~right).mean() > ACCEPTED_ERROR else 0.0
            break
    return Model(languages, scores.astype(np.float32), temperature, floor)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every whole text.

    ``held_out``: crc32 of doc_id as text is 2 modulo 4; such rows are never
    learned from, nor are those without a doc_id, where it is null. ``lang_pred`` is the likeliest learned language, or ``und``
    with score 0 where the text is null or has no letter, or where nothing
    could be learned. ``rejected`` marks ``und`` and scores under the model's
    calibrated floor. Each input row gives one row; ties go to the language
    that sorts first; other columns are ignored.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model or train(docs))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (fold(F.col("doc_id")) == 2).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
        "text",
    )

    def run(batches):
        fitted = sent.value
        for batch in batches:
            letters = batch["letters"].to_pylist()
            raws = tb.encode(batch["text"].to_pylist())
            if fitted is None:
                letters = [False] * len(raws)
            pred, score = [], []
            for a, b in tb.groups(raws) if fitted else ():
                best, p = fitted.predict(raws[a:b])
                pred += [fitted.languages[k] for k in best.tolist()]
                score += p.tolist()
            pred = [x if ok else UNKNOWN for x, ok in zip(pred or letters, letters, strict=True)]
            score = [x if ok else 0.0 for x, ok in zip(score or letters, letters, strict=True)]
            rejected = [x == UNKNOWN or s < fitted.floor for x, s in zip(pred, score, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["held_out"],
                    pa.array(pred, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
