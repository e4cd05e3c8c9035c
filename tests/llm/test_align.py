import hashlib
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import data
from tidemark.llm import token_align as align

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PAIR = align.Pair(*FILES)
ODD = ["▁", "a▁b", "<|endoftext|> <s>", "  two  spaces ", " \n x", "tab\t\tx", "\0 nul", "　 wide", "😀é 日本", "a\n  b", "x \x1c y", "it's  's"]


def cut(text):
    """(A ids, B ids, groups, links) of one whole text, a token at a time."""
    (a,), (b,) = PAIR.encode([text or ""])
    raw = f" {text or ''}".encode()
    if not text or PAIR.says(a, PAIR.a_bytes) != raw or PAIR.says(b, PAIR.b_bytes) != raw:
        return [], [], [], []
    groups, links, i, j, at_a, at_b = [([], [])], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a == at_b and (groups[-1][0] or groups[-1][1]):
            groups.append(([], []))
        if at_a <= at_b:
            lo, at_a = at_a, at_a + len(PAIR.a_bytes[a[i]])
            groups[-1][0].append(a[i])
            i += 1
        else:
            lo, at_b = at_b, at_b + len(PAIR.b_bytes[b[j]])
            groups[-1][1].append(b[j])
            j += 1
    spans = [[(x, p, p + len(t[x])) for x, p in zip(ids, np.cumsum([0, *(len(t[x]) for x in ids)]), strict=False)] for ids, t in ((a, PAIR.a_bytes), (b, PAIR.b_bytes))]
    start = 0
    for x, lo, hi in spans[0]:
        while start < len(b) and spans[1][start][2] <= lo:
            start += 1
        k = start
        while k < len(b) and spans[1][k][1] < hi:
            links.append((x, spans[1][k][0]))
            k += 1
    return a, b, groups, links


def expected(rows):
    cuts = [(i, *cut(t)) for i, t in rows]
    n = Counter(x for *_, links in cuts for x in links)
    most = Counter()
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    out = []
    for i, a, b, groups, links in cuts:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups) if a else ""
        best = sum(n[x] == most[x[1]] for x in links)
        out.append((i, len(a), len(b), len(groups) if a else 0, len(links), best, sum(map(n.__getitem__, links)), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return sorted(out, key=repr), n, most


def test_alignment_equals_a_token_at_a_time(spark, monkeypatch):
    rows = [(i, t) for i, t, *_ in data.documents()] + list(enumerate(ODD, 500)) + [(900, "▁"), (900, "▁ same id")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, n string").repartition(3)
    want, n, most = expected(rows)
    for size in (align.BLOCK_BYTES, 500):  # one block or many
        monkeypatch.setattr(align, "BLOCK_BYTES", size)
        got = sorted(map(tuple, align.align_documents(frame, *FILES, keep_groups=True).collect()), key=repr)
        assert got == want
    counts = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in align.link_counts(frame, *FILES).collect()}
    assert counts == {x: (k, k == most[x[1]]) for x, k in n.items()}


def test_slices_of_a_block_are_gathered(spark, monkeypatch):
    rows = [(i, t) for i, t, *_ in data.documents()] + list(enumerate(ODD, 500)) + [(None, "no id"), (900, "▁"), (900, "▁ same id"), (901, "é  a long text " * 90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want, n, _ = expected(rows)
    monkeypatch.setattr(align, "SLICE_BYTES", 300)  # some texts are longer
    got = sorted(map(tuple, align.align_documents(frame, *FILES, keep_groups=True).collect()), key=repr)
    assert got == want
    assert {(r["a_id"], r["b_id"]): r["n"] for r in align.link_counts(frame, *FILES).collect()} == n


def test_a_worker_holds_a_slice_not_a_block(monkeypatch):
    monkeypatch.setattr(align, "map_arrow", lambda docs, fn, schema: fn)
    monkeypatch.setattr(align, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = [f"{w}{i:x}" for i in range(3000) for w in ("word", "and ", "é")]
    texts = [None, ""] + [" ".join(words[i % 50 :: 20]) for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    run = align._block_rows(None, *FILES, False)
    next(run([batch.slice(0, 20)]))  # the tokenizers are loaded
    tracemalloc.start()
    (row,) = run([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row["doc_id"][0].as_py() == batch["doc_id"].to_pylist()
    assert len(set(row["pair"][0].as_py())) == len(row["pair"][0])
    assert sum(row["n"][0].as_py()) == sum(row["n_links"][0].as_py()) > 1_000_000
    assert peak < 130e6  # 346 MB with arrays and strings of the whole block


def test_blocks_of_a_file_are_read_one_by_one(spark, monkeypatch):
    # Spark reads all rows of a row group, up to 4096, as one batch
    monkeypatch.setattr(align, "BLOCK_BYTES", 500)
    rows = [(i, t) for i, t, *_ in data.documents() if i is not None]
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "2")  # a slice is of one batch
    try:
        blocks = align._read(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), *FILES)
    finally:
        spark.conf.set(setting, before)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in blocks.inputFiles()]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert set(groups) == {1}
    assert len(groups) == blocks.count() > 20
    assert sorted(i for r in blocks.collect() for i in r["doc_id"]) == sorted(i for i, _ in rows)


def test_no_documents_no_rows_and_texts_without_tokens(spark):
    assert align.align_documents(spark.createDataFrame([], data.SCHEMA), *FILES).count() == 0
    frame = spark.createDataFrame([(None, None), (1, ""), (2, "▁")], "doc_id long, text string")
    got = sorted(map(tuple, align.align_documents(frame, *FILES).collect()), key=repr)
    assert got == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i in (None, 1, 2)], key=repr)


def test_units_are_cut_in_both_tokenizers():
    assert PAIR.by_units
    for text in [*ODD, *(t for _, t, *_ in data.documents() if t)]:
        _units_encode_as_the_text(text)


def _units_encode_as_the_text(text):
    units = PAIR.units(text)
    assert " ".join(units) == text
    whole = PAIR.encode([text])
    got = list(PAIR.of_units(units))
    if None in got:
        raw = f" {text}".encode()
        assert PAIR.says(whole[0][0], PAIR.a_bytes) != raw or PAIR.says(whole[1][0], PAIR.b_bytes) != raw
    else:
        assert [[x for g in got for x in np.frombuffer(g[k], "<i4").tolist()] for k in (0, 1)] == [whole[0][0], whole[1][0]]


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=40) | st.text("ab'sT1. \t\n\u0085 \x1c▁<|>é日", min_size=1, max_size=40))
def test_any_text_is_cut_into_units(text):
    _units_encode_as_the_text(text.encode("utf-8", "ignore").decode() or "x")


@pytest.mark.parametrize("n", [1, 10, 11, 50257])
def test_digits(n):
    rows = align._digits(n)
    assert [bytes(r[r > 0]).decode() for r in rows[-3:]] == [str(i) for i in range(n)][-3:]
