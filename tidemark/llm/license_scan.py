"""License scan by diagonal voting over rolling word k-gram hashes.

The k-gram hashes of every document are Spark-joined to the positions of the
same hashes in license templates and confirmed on their words. Each is a vote
for an offset diagonal (document position less template position); neighbouring
diagonals merge, and the merged spans are verified by the share of the template
whose words they hold. Native DataFrame operations only.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, literal_rows, materialize
from tidemark.llm.license_texts import TEMPLATES

#: Words in a gram.
K = 3
#: A template of fewer grams counts only where it is a whole sentence: a few words
#: stand in others by chance.
MIN_GRAMS = 3
#: Diagonals this close together are one occurrence (words added or lost).
MERGE_GAP = 3
#: Share of a template's grams that a verified span holds at least.
MIN_SHARE = 0.6
#: Characters of all templates up to which their grams are broadcast.
BROADCAST_CHARS = 1 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values of the query's contract: label by phrase.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(words: Column) -> Column:
    """The K words from each position on as one text; empty if there are fewer."""
    n = F.size(words)
    parts = [F.slice(words, i + 1, n - (K - 1)) for i in range(K)]
    joined = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), parts)
    return F.when(n >= K, joined).otherwise(F.array().cast("array<string>"))


def template_grams(spark, templates=TEMPLATES) -> DataFrame:
    """(template, label, n_grams, t_pos, t_gram, hash) of all positions of templates."""
    numbered = [(i, label, text) for i, (label, text) in enumerate(templates)]
    rows = literal_rows(spark, numbered, "template", "label", "notice").withColumn("grams", _grams(words_of(F.col("notice"))))
    found = rows.select("template", "label", F.size("grams").alias("n_grams"), F.posexplode("grams").alias("t_pos", "t_gram"))
    return found.withColumn("hash", F.xxhash64("t_gram"))


#: Any sign that is neither part of a word nor ends a sentence.
_BETWEEN = r"[\x00-\x09\x0B-\x20\x22-\x2D\x2F\x3A-\x3E\x40-\x60\x7B-\x7F]"


def short_templates(templates=TEMPLATES) -> dict[int, str]:
    """Templates of less than MIN_GRAMS grams: the pattern of each as a sentence."""
    out = {}
    for i, (_, text) in enumerate(templates):
        words = re.findall(WORD, text.lower())
        if K <= len(words) < K + MIN_GRAMS - 1:
            inner = f"{_BETWEEN}+".join(map(re.escape, words))
            out[i] = rf"(?:^|[.!?\n]){_BETWEEN}*{inner}{_BETWEEN}*(?:[.!?\n]|$)"
    return out


def _starts(words: Column, text: Column, phrase: str) -> Column:
    """Word indexes where the phrase's words stand in a row."""
    parts = phrase.split(" ")
    here = lambda i: reduce(
        lambda a, b: a & b, [F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)]
    )
    none = F.array().cast("array<int>")
    n = F.size(words)
    found = F.filter(F.sequence(F.lit(0), n - len(parts)), here)
    may = (n >= len(parts)) & reduce(lambda a, b: a & b, [F.contains(text, F.lit(p)) for p in parts])
    return F.when(may, found).otherwise(none)


def _votes(docs: DataFrame, templates, base) -> DataFrame:
    """One pass over the texts: a row for each confirmed gram (row, label,
    template, n_grams, pos, t_pos), and one row for each document, with pos -1,
    that holds what is known of the whole text.

    Grams whose hash no template has are left out before rows are made of them,
    while the hashes fit a set (templates up to BROADCAST_CHARS)."""
    spark = docs.sparkSession
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = docs.select("doc_id", text.alias("text")).select("doc_id", "text", words_of(F.col("text")).alias("words"))
    labels = list(base.values())
    starts = F.array(*[_starts(F.col("words"), F.col("text"), phrase) for phrase in base]).cast("array<array<int>>")
    sentences = [F.when(F.col("text").rlike(pattern), F.lit(i)) for i, pattern in short_templates(templates).items()]
    placed = words.withColumn("starts", starts).withColumn("places", F.flatten("starts")).select(
        # numbers are given before the texts are cut into grams, which each carry
        # a few values of the whole text and no list of its places
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(F.get("starts", F.lit(k))) > 0, F.lit(x)) for k, x in enumerate(labels)]))
        .cast("array<string>")
        .alias("base"),
        F.array_compact(F.array(*sentences)).cast("array<int>").alias("sentences"),
    )
    of_text = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    grams = template_grams(spark, templates)
    numbered = F.transform(_grams(F.col("words")), lambda gram, i: F.struct(i.cast("int").alias("pos"), gram.alias("gram")))
    if sum(len(text) for _, text in templates) <= BROADCAST_CHARS:
        known = [r["hash"] for r in grams.select("hash").distinct().collect()]
        numbered = F.filter(numbered, lambda x: F.xxhash64(x["gram"]).isin(known))
        grams = F.broadcast(grams)
    whole = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("gram"))
    rows = placed.select(*of_text, "sentences", F.inline(F.concat(F.array(whole), numbered)))
    # a hash that another gram shares is no vote
    met = rows.withColumn("hash", F.when(F.col("pos") >= 0, F.xxhash64("gram"))).join(grams, "hash", "left").where(
        (F.col("gram") == F.col("t_gram")) | (F.col("pos") == -1)
    )
    vote = (F.col("gram") == F.col("t_gram")) & ((F.col("n_grams") >= MIN_GRAMS) | F.array_contains("sentences", F.col("template")))
    kept = [F.when(vote, F.col(c)).alias(c) for c in ("label", "template", "n_grams", "t_pos")]
    # numbers of rows are given and kept in this one pass
    return materialize(met.select(*of_text, "pos", *kept), "license-votes")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """Licenses named in every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (smallest and largest start of one, else null), base_labels,
    labels (the base labels and those of verified templates), score (1 where a
    base phrase stands, else the best verified share of a template) and spans
    (label, first and last word, share). Null or empty texts have no words, no
    labels and score 0. Each input row gives one row, repeated ones and those
    without a doc_id too; other columns are ignored. Templates under K words
    match nothing; those under MIN_GRAMS grams match as whole sentences only. Their grams are broadcast up to BROADCAST_CHARS of text.
    """
    votes = _votes(docs, templates, base)
    near = W.partitionBy("row", "template").orderBy("diagonal", "pos")
    sorted_votes = votes.where("t_pos is not null").withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    gap = F.col("diagonal") - F.lag("diagonal").over(near)
    runs = sorted_votes.withColumn("run", F.when(gap > MERGE_GAP, 1).otherwise(0)).withColumn(
        "run", F.sum("run").over(near.rowsBetween(W.unboundedPreceding, 0))
    )
    spans = (
        runs.groupBy("row", "template", "label", "n_grams", "run")
        .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.size(F.collect_set("t_pos")).alias("covered"))
        .withColumn("share", F.col("covered") / F.col("n_grams"))
        .where(F.col("share") >= MIN_SHARE)
    )
    span = F.struct("label", F.col("lo").cast("long").alias("first"), (F.col("hi") + (K - 1)).cast("long").alias("last"), "share")
    found = spans.groupBy("row").agg(
        F.collect_set("label").alias("voted"), F.max("share").alias("best"), F.array_sort(F.collect_list(span)).alias("spans")
    )
    judged = votes.where("pos = -1")
    none = F.array().cast("array<string>")
    return judged.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("voted", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<label:string,first:bigint,last:bigint,share:double>>")).alias("spans"),
    )


def _sql_low(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_words(text: str) -> str:
    return f"regexp_extract_all({_sql_low(text)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_GRAM = "w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]"
_NOTICES = ", ".join("({}, '{}', '{}')".format(i, label, text.replace("'", "''")) for i, (label, text) in enumerate(TEMPLATES))
_SENTENCES = ", ".join(f"({i}, '{pattern}')" for i, pattern in short_templates().items())
_PHRASES = ", ".join(f"('{label}', {phrase.split()})" for phrase, label in BASE.items())

ORACLE_SQL = f"""
WITH documents_low AS (SELECT row_number() OVER () AS r, doc_id, text, {_sql_low('text')} AS low FROM documents),
d AS (SELECT r, doc_id, {_sql_words('text')} AS w FROM documents_low),
sentences AS (SELECT r, template FROM (VALUES {_SENTENCES}) AS v(template, pattern), documents_low WHERE regexp_matches(low, pattern)),
t AS (SELECT template, label, {_sql_words('notice')} AS w FROM (VALUES {_NOTICES}) AS v(template, label, notice)),
tg AS (SELECT template, label, n_grams, i AS t_pos, {_GRAM} AS gram FROM (
  SELECT *, len(w) - 2 AS n_grams, unnest(range(0, greatest(len(w) - 2, 0))) AS i FROM t)),
g AS (SELECT r, i AS pos, {_GRAM} AS gram FROM (SELECT r, w, unnest(range(0, greatest(len(w) - 2, 0))) AS i FROM d)),
votes AS (SELECT g.r, pos, t_pos, template, label, n_grams, pos - t_pos AS diagonal FROM g JOIN tg USING (gram)
  WHERE n_grams >= {MIN_GRAMS} OR (g.r, template) IN (SELECT (r, template) FROM sentences)),
cuts AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER k > {MERGE_GAP} THEN 1 ELSE 0 END AS cut
  FROM votes WINDOW k AS (PARTITION BY r, template ORDER BY diagonal, pos)),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY r, template ORDER BY diagonal, pos) AS run FROM cuts),
spans AS (SELECT r, label, count(DISTINCT t_pos) / n_grams AS share FROM runs GROUP BY r, template, label, n_grams, run),
best AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM spans WHERE share >= {MIN_SHARE} GROUP BY r),
phrases AS (SELECT * FROM (VALUES {_PHRASES}) AS v(label, p)),
places AS (SELECT r, label, i FROM (
  SELECT r, label, w, p, unnest(range(0, greatest(len(w) - len(p) + 1, 0))) AS i FROM d, phrases) WHERE w[i + 1 : i + len(p)] = p),
base AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM places GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(best.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""
