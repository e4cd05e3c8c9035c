import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import data
from tests.oracle import SF, connect, rows
from tidemark.llm import (
    bpe, common, decontaminate, language, license_scan, license_texts, minhash_join, quality, queries, suffix_dedup, token_file, toxicity,
    url_filter,
)
from tidemark.llm.common import scratch

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    frame = spark.createDataFrame(data.documents(), data.SCHEMA)
    return frame.withColumns({"part": F.lit(1), "n": F.lit(2), "cls": F.lit("x"), "h": F.lit(0), "spans": F.lit("s")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], data.SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    expected = connect().sql(queries.oracle_sql()[name]).df()
    assert rows(got[list(expected.columns)]) == rows(expected)


# 1 and 5: token files and BPE.


def test_token_files_hold_all_ids_in_order(spark, docs, library):
    path = scratch(spark, "test-tokens")
    token_file.write_token_files(docs, path, VOCABULARY)
    got = token_file.describe_token_files(spark, path).orderBy("start").collect()
    start = 0
    expected = sorted(data.documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in expected]
    for row, (_, text, *_) in zip(got, expected, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    one = token_file.read_token_files(spark, path, F.col("doc_id") == 7)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1


def test_token_files_of_no_documents(spark, empty):
    path = scratch(spark, "test-tokens")
    token_file.write_token_files(empty, path, VOCABULARY)
    assert token_file.describe_token_files(spark, path).count() == 0


def test_chunks_encoded_together_have_their_own_ids(library):
    rnd = random.Random(1)
    marks = "aAbBß'strélΣ\u0085\x1c<|endoftext>12!?́Åİ日本🎉-_.,"
    chunks = sorted({"".join(rnd.choice(marks) for _ in range(rnd.randint(1, 9))) for _ in range(3000)} | {"<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b"})
    got = list(token_file._packed_ids(VOCABULARY).make(chunks))
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [library.encode(c, add_special_tokens=False).ids for c in chunks]


def test_token_files_have_bloom_filters_and_indexes(spark):
    """A reader that looks for one id skips files and row groups by them."""
    frame = spark.range(0, 40000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    path = scratch(spark, "test-tokens")
    token_file.write_token_files(frame.coalesce(1), path, VOCABULARY)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().endswith(".orc")]
    strides, kinds = set(), set()
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(f, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        strides.add(reader.getRowIndexStride())
        rows_ = reader.rows()
        for stripe in reader.getStripes():
            footer = rows_.readStripeFooter(stripe)
            kinds |= {(s.getColumn(), s.getKind().name()) for s in footer.getStreamsList()}
            assert footer.getColumns(3).getKind().name() == "DIRECT_V2"  # the elements of ids
        rows_.close()
    assert strides == {1000}
    assert (1, "BLOOM_FILTER_UTF8") in kinds and {(c, "ROW_INDEX") for c in (1, 2, 3)} <= kinds
    read = token_file.read_token_files(spark, path, F.col("doc_id") == 20001)  # between ids that are there
    assert read.count() == 0 and token_file.read_token_files(spark, path, F.col("doc_id") == 20002).count() == 1


def test_bpe_equals_the_library(docs, empty, library):
    got = bpe.encode_documents(docs, VOCABULARY, keep_ids=True, keep_decoded=True).collect()
    by = {(r["doc_id"], r["decoded"]) for r in got}
    for i, text, *_ in data.documents():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (i, decoded) in by
        row = next(r for r in got if r["doc_id"] == i and r["decoded"] == decoded)
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(empty, VOCABULARY).count() == 0


CODER = bpe.ForcedBoundaryBPE(VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.text("aAbBß'strélΣ \t\u0085 \x1c<|endoftext>12!?́", max_size=40))
def test_any_text_encodes_as_in_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    library = Tokenizer.from_file(VOCABULARY) if not hasattr(CODER, "_seen") else CODER._seen
    CODER._seen = library
    ids = library.encode(text, add_special_tokens=False).ids
    assert CODER.encode(text).tolist() == ids
    assert CODER.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_cross_no_token():
    for token in CODER.tokens[:5000]:
        raw = [CODER.byte_of[c] for c in token.removesuffix(CODER.end)]
        assert all(CODER.inside[a << 8 | b] for a, b in zip(raw, raw[1:], strict=False))
    assert not CODER.inside.all()


# 2: URL rules.


def test_url_rules_of_any_kind(spark):
    rules = [("a.b", "/x/", "block"), ("b", "/x/y", "allow"), ("a.b", "/x/", "allow"), ("", "/", "block"), (None, "/", "block")]
    urls = ["http://A.b/x/1?q", "http://c.b/x/yz/..", "http://a.b/x/y/z", "nothing", None, "http://b", "http://zb/x/", "ftp://b/x/#/y", "http://b/x/?/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id int, url string, html string")
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        url = [*urls, urls[0]][r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = data.low(rest.split("/")[0].split("?")[0].split("#")[0])
        path = rest[len(host) :].split("?")[0].split("#")[0]
        best = max(
            (h + p for h, p, _ in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)),
            key=len, default=None,
        )
        assert (r["host"], r["path"], r["rule"]) == (host, path, best)
        assert r["verdict"] == {"a.b/x/": "block", "b/x/y": "allow", "/": "block", None: "allow"}[best]


def test_url_rules_may_be_none_or_many(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id int, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.filter_urls(pages, none).first()["verdict"] == "allow"
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    assert url_filter.filter_urls(pages, url_filter.rules_frame(spark)).first()["rule"] == "com/"
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_frame(spark)).count() == 0


# 3: near-duplicates.


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, docs, size):
    got = minhash_join.near_duplicates(docs, size).collect()
    all_rows = [(r[0], r[1]) for r in data.documents()]
    expected = data.components(all_rows, size)
    assert len(got) == len(all_rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        text = dict(all_rows)[r["doc_id"]]
        assert r["n_shingles"] == len(data.shingle_set(text, size))
        assert r["component_id"] == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == expected[r["doc_id"]])


def test_large_groups_go_through_hubs_and_blocks(spark, monkeypatch):
    """A ring of texts, each near to the next alone, and one group around a hub."""
    monkeypatch.setattr(minhash_join, "SMALL", 2)
    monkeypatch.setattr(minhash_join, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HEAVY", 16)  # so few rows: frequent and rare keys both occur
    w = [f"w{i}" for i in range(400)]
    ring = [" ".join(w[i * 6 : i * 6 + 90]) for i in range(30)]
    star = [" ".join(["s", *[f"v{k}" for k in range(60) if k != i]]) for i in range(25)]
    texts = [*ring, *star, "alone " * 3]
    random.Random(5).shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_join.near_duplicates(frame, 2).collect()}
    assert got == data.components(list(enumerate(texts)), 2)


def test_no_documents_have_no_duplicates(empty):
    assert minhash_join.near_duplicates(empty).count() == 0


# 4: licenses.


def test_base_phrases_and_templates(spark):
    texts = [
        "foo Under the MIT-License! bar under the mit license", "apache license, version 2; cc by nc", None, "", "all rights reserved",
        "This work is licensed under the GNU General Public License, version 3.", "this work is really licensed under the gnu lesser general public license version 3",
        "under the mit", "cc cc by nc by nc", "word " * 5000 + "cc by nc",
        "All rights reserved. " * 3000 + license_texts.MIT, license_texts.MIT.replace("merge", "blend"), license_texts.MIT[:400],
    ]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y")], "doc_id long, text string, label string")
    got = license_scan.scan_licenses(frame).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        w = data.words(texts[r["doc_id"]])
        places, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert by[4]["labels"] == "all-rights-reserved" and by[5]["labels"] == "gpl-3" and by[6]["labels"] == "gpl-3"
    assert by[7]["labels"] == "" and by[2]["score"] == 0
    assert by[10]["labels"] == "all-rights-reserved,mit" and by[11]["labels"] == by[12]["labels"] == "mit"
    shares = {x["first"]: x["share"] for x in by[11]["spans"]}
    assert len(by[10]["spans"]) == 3 and by[10]["score"] == 1 and 0.6 < min(shares.values()) < 1
    assert license_scan.scan_licenses(frame.limit(0)).count() == 0


def test_license_scan_equals_its_sql_on_odd_texts(spark, docs):
    """Templates cut, moved, doubled and mixed into other words."""
    rnd = random.Random(8)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            w = rnd.choice(license_texts.TEMPLATES)[1].split()
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(["", "the", "added words here", w[0]])
            parts += w[rnd.choice([0, 0, 3]) :] * rnd.choice([1, 1, 2])
        texts.append(" ".join(parts))
    frame = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string"))
    con = connect()
    con.register("given", frame.toPandas())
    con.execute("create or replace view documents as select * from given")
    expected = con.sql(license_scan.ORACLE_SQL).df()
    got = license_scan.scan_licenses(frame).toPandas()
    assert rows(got[list(expected.columns)]) == rows(expected) and (expected.score > 0).sum() > 30


# 6: quality.


def test_quality_counts_equal_a_plain_version(docs, empty):
    got = quality.judge_quality(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in got:
        expected = data.quality(r["text"])
        assert tuple(r[k] for k in names) == expected
        n, again = expected[0], expected[4]
        assert r["base_failed"] == (n < 10 or 100 * again > 20 * n)
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge_quality(empty).count() == 0


def plain_histograms(text):
    """Character classes by byte, and common words, of one text."""
    raw = text.encode()
    classes = [0] * 11
    for b in raw:
        c = chr(b)
        if b in b"#*$%&|<>":
            k = 6
        elif 0x80 <= b < 0xC0:
            k = 10
        elif b >= 0xE0:
            k = 9
        elif b >= 0xC0:
            k = 8
        elif c in " \t\n\v\f\r":
            k = 3
        elif b < 32 or b == 127:
            k = 7
        elif c.isdigit():
            k = 2
        elif c.isupper():
            k = 1
        elif c.islower():
            k = 0
        else:
            k = 4 if c in ".,;:!?'\"()-" else 5
        classes[k] += 1
    common = sorted(set(quality.COMMON_WORDS))
    counts = [0] * (len(common) + 1)
    for w in data.words(text):
        counts[common.index(w) if w in common else -1] += 1
    return classes, counts


def plain_distance(a, b):
    p, q = ([x / max(1, sum(v)) for x in v] for v in (a, b))
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    kl = lambda v: sum(x * math.log2(x / y) for x, y in zip(v, m, strict=True) if x > 0)
    return math.sqrt(min(1, max(0, (kl(p) + kl(q)) / 2)))


def test_distances_and_verdicts_equal_a_plain_version(spark):
    rnd = random.Random(6)
    say = lambda words_, n: " ".join(rnd.choice(words_) + rnd.choice(["", ",", ".", " 7"]) for _ in range(n))
    en, de = "the of and cat walked seven THE Tree".split(), "der die und Straße läuft ist Haus".split()
    rows_ = [(i, say(en, rnd.randint(5, 200)), "en") for i in range(40)] + [(50 + i, say(de, rnd.randint(5, 200)), "de") for i in range(40)]
    rows_ += [(100, say(de, 90), "en"), (101, say("@@ ## %% 123 $x".split(), 90), "de"), (102, say(en, 90), None), (103, say(en, 90), "zz"), (104, None, "en"), (105, "", "de")]
    rows_ += [(106, say(["日本", "語x", "~^"], 120), "en")]
    frame = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    sums = {}
    for _, text, lang in rows_:
        if text is not None and lang is not None:
            mine = sums.setdefault(lang, [[0] * 11, [0] * (quality.N_WORDS + 1)])
            for total, part in zip(mine, plain_histograms(text), strict=True):
                total[:] = map(sum, zip(total, part, strict=True))
    sums = {k: v for k, v in sums.items() if sum(v[1]) >= quality.MIN_REFERENCE_WORDS}
    assert set(sums) == {"en", "de"}
    verdicts = set()
    for r in quality.judge_quality(frame).collect():
        n, _, _, _, again = data.quality(r["text"])
        failed, far = n < 10 or 100 * again > 20 * n, [None, None]
        if n >= quality.MIN_JUDGED_WORDS and r["lang"] in sums:
            far = [plain_distance(a, b) for a, b in zip(plain_histograms(r["text"]), sums[r["lang"]], strict=True)]
        for got, expected in zip((r["class_distance"], r["word_distance"]), far, strict=True):
            assert got == expected or abs(got - expected) < 1e-9
        away = far[0] is not None and (far[0] > quality.MAX_CLASS_DISTANCE or far[1] > quality.MAX_WORD_DISTANCE)
        assert r["kept"] == (not failed and not away)
        verdicts.add((failed, away))
    assert {(False, True), (False, False), (True, False)} <= verdicts


def test_odd_histograms_go_and_plain_prose_stays(spark):
    rnd = random.Random(2)
    clean = [" ".join(rnd.choice("the of and cat dog house walked seven trees river".split()) + rnd.choice(["", "", "."]) for _ in range(80)) for _ in range(60)]
    noisy = " ".join(f"{rnd.randint(0, 9**9)}%%%|||###" for _ in range(60))
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*clean, noisy])], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] or r["base_failed"] for r in quality.judge_quality(frame).collect()}
    assert not kept[60] and all(kept[i] for i in range(60))
    assert quality.distance(np.array([[1, 0]]), np.array([[0, 1]]))[0] == 1
    assert quality.distance(np.array([[2, 2]]), np.array([[1, 1]]))[0] == 0


# 7: toxicity.


def test_automaton_equals_edit_distances():
    rnd = random.Random(4)
    words, stems = ["scum", "idiot", "moron", "hello"], ["loweix", "veq"]
    automaton = toxicity.Automaton(words, stems)
    pool = {"".join(rnd.choice("idotmrnlweixvqscuh") for _ in range(rnd.randint(1, 8))) for _ in range(500)}
    for t in (*words, *stems):
        for i in range(len(t) + 1):
            pool |= {t[:i] + t[i + 1 :], t[:i] + "z" + t[i:], t[:i] + "z" + t[i + 1 :], t + "abc", t[:i] + t[i + 1 :] + "abc"}
    pool = sorted(w for w in pool if w)
    got = automaton.match(toxicity.Text([" ".join(pool)])).tolist()
    terms = [*words, *stems]
    for w, k in zip(pool, got, strict=True):
        exact = [i for i, t in enumerate(terms, 1) if w == t or (t in stems and w.startswith(t))]
        if exact:
            assert k == min(exact), w
            continue
        near = [t for t in words if len(t) >= 5 and data.distance_one(w, t)]
        begun = [t for t in stems if len(t) >= 5 and any(data.distance_one(w[:n], t) for n in range(len(w) + 1))]
        assert k == (len(terms) + 1 if near else len(terms) + 2 if begun else 0), w


def test_contexts_of_matches():
    texts = ["you idiot there", 'he said idiot', 'the word "idiot" is old', "idiot", ""]
    automaton = toxicity.Automaton(["idiot"], [])
    doc, cell = toxicity.cells(texts, automaton)
    assert dict(zip(doc.tolist(), (cell % 3).tolist(), strict=True)) == {0: toxicity.PLAIN, 1: toxicity.REPORTED, 2: toxicity.QUOTED, 3: toxicity.PLAIN}


def plain_score(text, words, stems, chance, base):
    """The highest chance of a match, word by word."""
    low_text = "".join(c.lower() if ord(c) < 0x530 and len(c.lower()) == 1 else c for c in text)
    found = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F«»\u2000-\u206F]+", low_text)]
    tokens, best = [low_text[a:b] for a, b in found], None
    for k, (a, b) in enumerate(found):
        w = tokens[k]
        if w in words:
            number = words.index(w) + 1
        elif any(w.startswith(s) for s in stems):
            number = min(len(words) + 1 + i for i, s in enumerate(stems) if w.startswith(s))
        elif any(len(t) >= 5 and data.distance_one(w, t) for t in words):
            number = len(words) + len(stems) + 1
        elif any(len(t) >= 5 and any(data.distance_one(w[:n], t) for n in range(len(w) + 1)) for t in stems):
            number = len(words) + len(stems) + 2
        else:
            continue
        before, after = (low_text[a - 1] if a else "\n"), (low_text + "\n")[b]
        context = toxicity.PLAIN
        if before in toxicity.QUOTES or after in toxicity.QUOTES:
            context = toxicity.QUOTED
        elif set(tokens[max(0, k - 5) : k]) & set(toxicity.REPORTING):
            context = toxicity.REPORTED
        value = chance[number * 3 + context]
        best = value if best is None else max(best, value)
    return base if best is None else best


def test_scores_equal_a_plain_version(spark):
    words, stems = ["idiot", "moron", "scum"], ["loweix", "veq"]
    chance = np.random.default_rng(3).random((len(words) + len(stems) + 3) * 3)
    model = toxicity.Model(toxicity.Automaton(words, stems), chance, 0.05)
    rnd = random.Random(9)
    pool = "idiot idiots idoit moron m0ron scum scums Loweixen loewix veqs said quote tree HOUSE told".split()
    ends = ["", "", ",", '"', "”", "\n", "'"]
    texts = ["".join(rnd.choice(["", "", '"', "«"]) + rnd.choice(pool) + rnd.choice(ends) + " " for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    texts += [r[1] for r in data.documents()] + ["", None, '"idiot"', "plain " * 20000 + "idiot"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_documents(frame, model).collect():
        assert r["score"] == plain_score(texts[r["doc_id"]] or "", words, stems, chance, 0.05), texts[r["doc_id"]]
        assert r["predicted"] == (r["score"] >= 0.3)


def test_repeated_ids_count_once_in_training(spark):
    rows_ = [(i, f"clean words number {i} {i + 1}") for i in range(40)] + [(100 + i, f"zorgle bad text {i} w{i}") for i in range(8)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows_] + [(None, 1)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows_, "doc_id long, text string")
    often = once.unionAll(once.where("doc_id = 3")).unionAll(once)
    a, b = toxicity.train(once, labels), toxicity.train(often, labels)
    assert np.array_equal(a.chance, b.chance) and a.base == b.base


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["toxic"] for r in got]
    assert np.mean(right) > 0.88
    toxic = [r["predicted"] for r in got if r["toxic"] == 1]
    assert np.mean(toxic) > 0.55  # few stems have enough texts to learn here


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.0}
    assert toxicity.score_documents(empty, model).count() == 0


# 8: decontamination.


def test_hits_equal_a_plain_search(spark, docs, empty):
    texts = [r[1] for r in data.documents() if r[1] and len(r[1].split()) > 40]
    items = [(i, " ".join(t.split()[3:30])) for i, t in enumerate(texts[:6])]
    items += [(20, "x"), (21, ""), (22, None), (23, "one two"), (24, "zz not there"), (20, "x"), (25, items[0][1]), (26, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for per_pass in (10**6, 10):  # one block of phrases, and several
        decontaminate.PHRASES_PER_BLOCK, was = per_pass, decontaminate.PHRASES_PER_BLOCK
        try:
            got = decontaminate.judge_documents(docs, benchmark).collect()
        finally:
            decontaminate.PHRASES_PER_BLOCK = was
        by = {(i, t): data.hits(t, items) for i, t, *_ in data.documents()}
        expected = sorted(
            (str(i), n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0 and 20 * h >= n)
            for (i, t), (n, h, f) in ((k, by[k]) for k in ((r[0], r[1]) for r in data.documents()))
        )
        assert sorted((str(r[0]), *r[1:]) for r in got) == expected
    assert decontaminate.judge_documents(empty, benchmark).count() == 0
    assert decontaminate.judge_documents(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_spans_are_cut_and_contaminated_documents_go(spark):
    item = " ".join(f"q{i}" for i in range(15))
    long_ = " ".join(f"k{i}" for i in range(600))
    frame = spark.createDataFrame([(1, f"{long_} {item} end", 1), (2, item, 1), (3, None, None), (4, "ok", 2)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in decontaminate.remove_contamination(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: f"{long_}  end", 3: None, 4: "ok"}


# 9: language.


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def plain_language(text, model):
    """Mean score of the byte 3- and 4-grams inside words, gram by gram."""
    raw = bytearray(f"\n{text}\n".encode())
    low_raw = bytearray(32 if b < 65 or 91 <= b < 97 or 123 <= b < 128 else b + 32 if b < 91 else b for b in raw)
    for i in range(len(raw) - 1):
        if raw[i] == 0xC3 and 0x80 <= raw[i + 1] <= 0x9E:
            low_raw[i + 1] += 32
    buckets = []
    for i in range(len(low_raw) - 2):
        g = low_raw[i : i + 3]
        if g[1] != 32 and not (g[0] == 32 and g[2] == 32):
            buckets.append((int.from_bytes(g, "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 17)
        g = low_raw[i : i + 4]
        if len(g) == 4 and g[1] != 32 and g[2] != 32:
            four = int.from_bytes(g, "little")
            buckets.append(((four ^ four >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 17)
    z = sum((model.scores[b].astype(float) for b in buckets), np.zeros(len(model.languages))) / max(1, len(buckets)) / model.temperature
    e = np.exp(z - z.max())
    return model.languages[int(e.argmax())], float(e.max() / e.sum())


def test_predictions_equal_a_plain_version(spark, docs):
    rng = np.random.default_rng(5)
    model = language.Model(["de", "en", "fr"], rng.normal(0, 1, (language.N_BUCKETS, 3)).astype(np.float32), 0.3, 0.6)
    texts = [r[1] for r in data.documents()] + ["ÀÉ Übung", "a", "ab", "abc", "日本語 text", "12 34", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language.identify(frame, model).collect():
        text = texts[r["doc_id"]]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        name, score = plain_language(text, model)
        assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-6 and r["rejected"] == (r["score"] < 0.6)


def test_every_language_is_learned_from_a_bounded_sample(spark, monkeypatch):
    rows_ = [(i, f"{name}word other {name}text {i}", name) for i, name in enumerate(["aa"] * 300 + ["bb"] * 90 + ["cc"] * 3)]
    frame = spark.createDataFrame(rows_ + rows_[:5], "doc_id long, text string, lang string")
    assert language.train(frame).languages == ["aa", "bb", "cc"]
    monkeypatch.setattr(language, "TRAIN_ROWS", 60)  # 20 of each
    drawn = [r[0] for r in language._sample(frame)]
    assert set(drawn) == {"aa", "bb", "cc"} and len(drawn) < 90


def test_texts_without_letters_are_undetermined(spark, docs, empty):
    model = language.train(docs)
    frame = spark.createDataFrame([(1, None), (2, "12 34 !"), (3, ""), (4, "日本"), (5, "the")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(frame, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0 and got[4]["lang_pred"] == "en"
    assert language.identify(empty).count() == 0
    assert language.train(frame.withColumn("lang", F.lit(None).cast("string"))) is None


# 10: repeats.


def test_removed_bytes_equal_a_plain_search(docs, empty):
    got = suffix_dedup.remove_repeats(docs).collect()
    expected = []
    for i, raw, gone in data.without_repeats([(r[0], r[1]) for r in data.documents()]):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        n_spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        expected.append((str(i), len(raw), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((str(r["doc_id"]), *[r[k] for k in names]) for r in got) == sorted(expected)
    assert {"part", "n", "cls", "spans"} <= set(got[0].asDict())
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_long_texts_are_scanned_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 97)
    rnd = random.Random(1)
    text = "".join(rnd.choice("ab") for _ in range(700))
    items = [(2, text[100:640]), (1, "zz" + text[300:420] + "q" * 70), (3, "q" * 90 + text[:200]), (4, "q" * 49)]
    for i, raw, gone in data.without_repeats(items):
        scans = list(suffix_dedup.scans([raw]))
        assert sum(int((s.hi - s.lo + 1).sum()) for s in scans) == max(0, len(raw) - 49), (i, gone)
    part = suffix_dedup.Part([t.encode() for _, t in items], np.array([i for i, _ in items]), {}, 4)
    answers = {}
    for round_, made in ((1, lambda: part.anchors()), (2, lambda: part.runs()[1]), (3, lambda: part.windows(part.judged()[1])[1])):
        side = suffix_dedup.pa.Table.from_batches([suffix_dedup._batch(made().rows(0, 4, round_ > 1, round_ == 3), suffix_dedup.ENTRIES)])
        answers[round_] = {}
        for b in set(side["bucket"].to_pylist()):
            out = suffix_dedup._answer(round_)(side.filter(suffix_dedup.pa.compute.equal(side["bucket"], b)))
            answers[round_][b] = out["first"][0].as_py(), out["second"][0].as_py()
        part.side = answers
    for spans, (_, _, gone) in zip(part.removed(len(items)), data.without_repeats(items), strict=True):
        flags = bytearray(len(gone))
        for a, b in spans:
            flags[a:b] = b"\1" * (b - a)
        assert flags == gone


def test_word_chunks_are_encoded_without_marks(monkeypatch):
    """Every chunk has the ids that it has alone; words go as plain texts."""
    from tidemark.llm import bpe, token_file

    path, sent = public_tokenizers.path("word_bpe_49k.json"), []
    library = Tokenizer.from_file(path)

    class Spy:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return self.inner.encode_batch_fast(texts, **more)

    monkeypatch.setattr(token_file.bpe, "check_vocabulary", Spy)
    chunks = ["the", "Straße", "ÉTÉ", "xqzj" * 20, "don't", "a1b2", "end.", "<|x", "İstanbul", "e\u0301te", "ªº", "中文", "ŉa", "…", "</w>", "w</w>x"]
    chunks += [f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    cache = token_file._packed_ids(path).of([chunks])
    for c in chunks:
        assert np.frombuffer(cache[c], "<i4").tolist() == library.encode(c, add_special_tokens=False).ids, c
    assert sum("<|" in t for t in sent) == 1 and sum("waa" in t and "<|" not in t for t in sent) == 1
    assert [bpe.is_word(c) for c in chunks[:8]] == [True] * 4 + [False] * 4


def odd_texts(n):
    """With white space of all kinds, plain and other letters, marks and added tokens."""
    rnd = random.Random(2)
    parts = ["a", "B", "é", "É", "ß", "İ", "ŉ", "ª", "µ", "×", "Σ", "中", "e\u0301", "\u0338", "…", "🎉", "'s", "'", "<|", "<|endoftext|>", "1", "²", ".", ",!", "</w>", "\\", "]", "^", "-", "\x00"]
    parts += [" ", " ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2028", "\u200b", "\ufeff"]
    plain = ["the", "Été", "street", "'", ".", "!", "?", "-", "7", " ", "\n", "\t", "\r\n", "  "]
    return [None, "", " ", *("".join(rnd.choices(rnd.choice([parts, plain]), k=rnd.randint(1, 30))) for _ in range(n))]


def test_chunk_array_equals_chunks_of():
    every = "".join(c for c in map(chr, range(0x180)) if bpe._PLAIN_TEXT.fullmatch(c))
    for texts in (odd_texts(500), [None], [""], [every, *every], ["İ", "a\x0bb"], ["The end. ", None, " Été"]):
        chunks, starts, sizes = bpe.chunk_array(token_file.pa.array(texts, "string"))
        got = [[c for c in chunks[a : a + n].to_pylist() if c] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        assert got == list(map(bpe.chunks_of, texts))


@pytest.mark.parametrize("words", [True, False])
def test_encoder_equals_the_library(library, monkeypatch, words):
    if not words:
        monkeypatch.setattr(bpe, "word_library", lambda library: None)
    monkeypatch.setattr(bpe, "MISS_BLOCK", 700)
    encoder = token_file.Encoder(VOCABULARY)
    assert bool(encoder.words) == words
    texts = odd_texts(1500) + [f"{c}{m}x {c}{m} {c}'s{m}{m}" for c in "aé" for m in "'!\"<|>\\^]-_`~"] + ["x" * 5000 + "."]
    group = [texts[:1], texts[1:900], texts[900:901], texts[901:]]
    found = list(encoder.encode([token_file.pa.array(g, "string") for g in group], 2))
    assert len(found) == len(group)
    for part, (ids, sizes) in zip(group, found, strict=True):
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in part]


def test_words_without_an_end_are_encoded_by_the_whole_library(library):
    """As in a vocabulary whose model leaves some word without its last token."""
    encoder = token_file.Encoder(VOCABULARY)
    encoder.closes[library.encode("street", add_special_tokens=False).ids[-1]] = False
    [(ids, _)] = encoder.encode([token_file.pa.array(["the street, and street"], "string")], 2)
    assert ids.tolist() == [*library.encode("the street, and street", add_special_tokens=False).ids, 2]


def test_distinct_words_of_a_group_reach_the_library_once(spark, library, monkeypatch):
    """Whatever marks follow them, and in however many batches."""
    sent, held = [], {}

    class Spy:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return self.inner.encode_batch_fast(texts, **more)

    def hold(df, fn, schema):
        held["run"] = fn
        raise InterruptedError

    monkeypatch.setattr(bpe, "check_vocabulary", Spy)
    monkeypatch.setattr(bpe, "_LOADED", {})
    monkeypatch.setattr(token_file, "map_arrow", hold)
    with pytest.raises(InterruptedError):
        token_file.write_token_files(spark.createDataFrame([], "doc_id long, text string"), "unused", VOCABULARY)
    texts = [["a street.", "the street!", None], [], ["Street, street"], ["(the street)", ""]]
    pa = token_file.pa
    batches = [
        pa.RecordBatch.from_arrays([pa.array(range(len(t)), pa.int64()), pa.array(t, "string"), pa.array([3] * len(t), pa.int32())], ["doc_id", "text", "shard"])
        for t in texts
    ]
    out = pa.Table.from_batches(held["run"](iter(batches))).to_pylist()
    start = 0
    for row, text in zip(out, sum(texts, []), strict=True):
        assert row["ids"] == [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row["shard"], row["shard_start"], row["n_ids"]) == (3, start, len(row["ids"]))
        start += row["n_ids"]
    chunks = " ".join(sent).split()
    assert chunks.count("street") == 1 and not {"street.", "street!", "street,"} & set(chunks)
    # batches over the bound are groups of their own
    monkeypatch.setattr(token_file, "GROUP_BYTES", 1)
    assert [len(g) for g in token_file._grouped(iter(batches))] == [1, 1, 1]
    assert pa.Table.from_batches(held["run"](iter(batches))).to_pylist() == out
