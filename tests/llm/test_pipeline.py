import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import data
from tidemark.llm import quality

#: Names that stages use themselves.
CLASHING = ("kept", "items", "n_words", "spans", "part", "hits")


def run(spark, folder, rows, items):
    frame = spark.createDataFrame(rows, data.SCHEMA)
    frame = frame.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASHING})
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage{i}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(frame):
    return sorted(map(repr, frame.select("doc_id", "text").collect()))


def as_rows(rows):
    return sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in rows)


def without(rows, items):
    """Rows that aren't contaminated, without their hit words."""
    out = []
    for i, t in rows:
        n, h, _ = data.hits(t, items)
        if not (h and 20 * h >= n):
            out.append((i, t, h))
    return out


def test_every_stage_equals_a_plain_one(spark, tmp_path):
    rows = data.documents()  # with a repeated row, a row without an id, null and empty texts
    passage = next(r[1] for r in rows if r[1] and len(r[1].split()) > 60)
    items = [(1, " ".join(passage.split()[:30])), (2, None)]
    good, near, cut, clean, ids = run(spark, str(tmp_path), rows, items)

    judged = quality.judge_quality(spark.createDataFrame(rows, data.SCHEMA)).collect()
    kept = []
    for r, (i, t) in zip(judged, [(r["doc_id"], r["text"]) for r in judged], strict=True):
        n, _, _, _, again = data.quality(t)
        assert r["base_failed"] == (n < 10 or 100 * again > 20 * n)
        far = (r["class_distance"] or 0) > quality.MAX_CLASS_DISTANCE or (r["word_distance"] or 0) > quality.MAX_WORD_DISTANCE
        assert r["kept"] == (not r["base_failed"] and not far)
        if r["kept"]:
            kept.append((i, t))
    assert texts(good) == as_rows(kept) and len(kept) > 20
    for frame in (good, near, cut, clean):
        assert set(frame.columns) == {*rows_schema(), *CLASHING}
        held = frame.select("doc_id", *CLASHING).where("doc_id is not null").collect()
        assert all(r[c] == f"{c}{r['doc_id']}" for r in held for c in CLASHING)

    survivors = [(r["doc_id"], r["text"]) for r in near.collect()]
    group = data.components(sorted({x for x in kept if x[0] is not None}), 5)
    whole = {i for i, _ in survivors if i is not None}
    assert whole == {i for i, _ in kept if i is not None and group[i] == i}
    assert set(survivors) <= set(kept)

    expected = [(i, None if t is None else bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")) for (i, t), (_, raw, gone) in zip(survivors, data.without_repeats(survivors), strict=True)]
    assert texts(cut) == as_rows(expected)
    left = without(expected, items)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _, _ in left)
    assert all(x in texts(clean) for x in as_rows([(i, t) for i, t, h in left if not h]))

    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    want = sorted((str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids) for r in clean.collect())
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in ids.collect()) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in ids.collect())
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def rows_schema():
    return [x.split()[0] for x in data.SCHEMA.split(", ")]


def test_stages_take_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], data.SCHEMA)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
