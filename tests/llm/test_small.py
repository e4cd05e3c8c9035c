"""Every operator on inputs smaller than its windows, one row a batch."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import data
from tidemark.llm import bpe, decontaminate, language, license_scan, minhash_join, quality, suffix_dedup, token_align, token_file, toxicity, treap_search, url_filter
from tidemark.llm.common import scratch

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PAIR = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOXIC = toxicity.Model(toxicity.Automaton(["stupid"], ["idiot"]), np.full(15, 0.9), 0.1)
SMALL = {
    "one word": [(1, "stupid")],
    "one null": [(None, None)],
    "tiny": [(1, "stupid"), (2, None), (3, ""), (4, "é"), (5, "a b"), (5, "a b")],
}


def token_files(docs, items):
    path = scratch(docs.sparkSession, "small")
    token_file.write_token_files(docs, path, VOCABULARY)
    return token_file.describe_token_files(docs.sparkSession, path)


OPERATORS = {
    "token files": token_files,
    "minhash": lambda docs, items: minhash_join.near_duplicates(docs.select("doc_id", "text"), size=2),
    "licenses": lambda docs, items: license_scan.scan_licenses(docs),
    "bpe": lambda docs, items: bpe.encode_documents(docs, VOCABULARY),
    "quality": lambda docs, items: quality.judge_quality(docs),
    "toxicity": lambda docs, items: toxicity.score_documents(docs, TOXIC),
    "decontaminate": lambda docs, items: decontaminate.judge_documents(docs, items),
    "language": lambda docs, items: language.identify(docs.select("doc_id", "text", "lang")),
    "suffix": lambda docs, items: suffix_dedup.remove_repeats(docs.select("doc_id", "text")),
    "align": lambda docs, items: token_align.align_documents(docs, *PAIR),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("size", SMALL)
def test_small_inputs_give_a_row_each(spark, name, size):
    rows = [(i, t, "en", "src", len(t or "")) for i, t in SMALL[size]]
    docs = spark.createDataFrame(rows, data.SCHEMA).repartition(6)
    got = OPERATORS[name](docs, spark.createDataFrame([(1, "stupid"), (2, None)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0 for r in got)) == sorted(i or 0 for i, _ in SMALL[size])


@pytest.mark.parametrize("size", SMALL)
def test_search_of_small_inputs(spark, size):
    docs = spark.createDataFrame(SMALL[size], "doc_id long, text string").repartition(6)
    got = treap_search.search(docs, spark.createDataFrame([(1, "stupid"), (2, None)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {i for i, t in SMALL[size] if t == "stupid"}


def test_toxicity_is_learned_from_short_texts_in_many_batches(spark):
    words = "you are a stupid idiot said the man today".split()
    rows = [(i, " ".join(words[(i + k) % 9] for k in range(3 + i % 3))) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(64)
    labels = spark.createDataFrame([(i, int("stupid" in t)) for i, t in rows], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 64 and all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("gap", [" ", "　", "。", "、", "—", "…", "·"])
def test_signs_beyond_ascii_part_words(gap):
    assert toxicity.Text([f"you{gap}stupid é{gap}日本"]).words() == ["you", "stupid", "é", "日本"]


def test_rows_without_an_id_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 2000)
    shared = "a passage that many of these texts hold, of more than fifty bytes in all "
    rows = [(None, f"{shared}{i} " + "x" * (i % 7)) for i in range(150)] + [(7, shared + "end"), (3, "other " + shared)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(frame).collect()))
    assert got == sorted((str(i), len(raw), sum(gone)) for i, raw, gone in data.without_repeats(rows))


def test_many_urls_without_a_host(spark):
    rows = [(i, None if i % 2 else "no scheme") for i in range(200)] + [(900, "http://a.net/es/x"), (901, "http:///es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark)).collect()}
    assert len(got) == 202 and got[900] == ("a.net", "net/es/", "block") and got[901][0] == ""
    assert len({v for k, v in got.items() if k < 200}) == 1


def test_a_few_common_words_are_no_license(spark):
    docs = spark.createDataFrame([(1, "All rights reserved to the king")], "doc_id long, text string")
    row = license_scan.scan_licenses(docs).first()
    assert row["labels"] == "" and row["score"] == 0
    short = license_scan.scan_licenses(docs, templates=[("x", "All rights reserved"), ("y", "rights reserved to the king")]).first()
    assert short["labels"] == "y"


def test_a_vocabulary_that_keeps_white_space_is_refused():
    bpe.check_vocabulary(Tokenizer.from_file(VOCABULARY))
    with pytest.raises(ValueError, match="white space"):
        bpe.check_vocabulary(Tokenizer.from_file(PAIR[0]))
    odd = Tokenizer.from_file(VOCABULARY)
    odd.add_tokens(["[X]"])
    with pytest.raises(ValueError, match="added"):
        bpe.check_vocabulary(odd)
