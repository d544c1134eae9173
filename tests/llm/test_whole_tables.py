"""Queries and operators where rows share ids, sources are many, items are short: every row is accounted for."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from against_sql import same_rows

from workloom.llm import decontaminate, langid, mixing, queries, quality, sharding, token_counts

SF = "/root/testdata/sf0.001"


def mixed_like_sql(spark, docs, labels):
    same_rows(mixing.mix(docs, mixing.label_weights(labels)).drop("source"), mixing.oracle_sql(), documents=docs, labels=labels)


def test_mix_of_alike_rows_and_nulls_against_sql(spark, monkeypatch):
    """A third of all rows are alike, another third has no id; dealt out in small blocks, in small buckets."""
    monkeypatch.setattr(mixing, "DEALT_ROWS", 7)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rnd = random.Random(2)
    rows = [(5, "one two three", "hot")] * 200 + [(None, f"w{i} " * rnd.randint(0, 9), rnd.choice(["a", "b", None])) for i in range(200)]
    rows += [(i, "x y " * rnd.randint(1, 5), f"src{i % 9}") for i in range(200)] + [(9, None, "none"), (10, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 200, 3)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    mixed_like_sql(spark, docs.selectExpr("*", "'x' AS _key", "1 AS size"), labels)
    mixed_like_sql(spark, docs.limit(0), labels)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    hot = Counter(r.taken for r in found if r.source == "hot")
    assert len(hot) <= 2 and sum(hot.values()) == 200


def test_mix_of_as_many_sources_as_rows_against_sql(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, "w " * rnd.choice([1, 2, 300]), f"http://{rnd.random()}") for i in range(700)], "doc_id long, text string, source string")
    mixed_like_sql(spark, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))


def test_short_items_between_word_borders(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "cat"), (3, "?!"), (4, "")], "item_id long, text string")
    texts = ["so: what is the capital of france", "what is the capital of francesca", "a CAT.", "concatenate", "cat", "the cats", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(tuple(r) for r in decontaminate.matches(docs, bench).collect())
    assert found == [(0, 1, 0), (2, 2, 0), (4, 2, 0)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 3, 5, 6]


def levenshtein_inside(pattern, text):
    row = np.zeros(len(text) + 1, int)
    steps = np.arange(len(text) + 1)
    codes = np.frombuffer(text.encode("latin-1"), np.uint8)
    for i, p in enumerate(pattern.encode("latin-1"), 1):
        diagonal = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (codes != p)))
        row = np.minimum.accumulate(diagonal - steps) + steps
    return int(row.min())


def test_edited_items_in_documents_against_brute_force(spark):
    """The query's own items, edited, in the query's own documents: every pair within the budget, no other."""
    rnd = random.Random(6)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).collect()]
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 900").limit(40).collect()]
    rows = []
    for i, text in enumerate(texts):
        item = list(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, max(1, len(item) // 6))):
            at = rnd.randrange(len(item))
            item[at : at + 1] = rnd.choice(["", "x", "yz", "É"])
        rows.append((i, text[:200] + " " + "".join(item) + " " + text[200:]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = set()
    for i, text in rows:
        for j, item in items:
            clean, m = decontaminate.normalised(text), decontaminate.normalised(item)
            if (d := levenshtein_inside(m, clean)) <= int(0.1 * len(m)):
                expected.add((i, j, d))
    found = decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in found.collect()} == expected and 10 < len(expected)


def test_languages_beyond_forty_and_rows_of_one_id(spark):
    """Each of 45 languages has words of its own; one has all its rows under one doc_id, alike rows among them."""
    rnd = random.Random(8)
    word = lambda k: "".join(chr(97 + (k * 7 + rnd.randint(0, 3)) % 26) for _ in range(5)) + "aeiou"[k % 5] * (1 + k // 5 % 9)
    rows = [(1000 * k + i, " ".join(word(k) for _ in range(30)), f"l{k:02d}") for k in range(45) for i in range(12)]
    rows += [(100_007, " ".join(word(50) for _ in range(30)), "l50") for _ in range(60)] + [(100_008, "the same text again and again", "l51")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert sum(map(len, model.members.values())) == 47
    found = langid.predict(docs.select("doc_id", "text", "lang"), model).collect()
    assert sum(r._lang_pred == r.lang for r in found) >= 0.95 * len(found)
    assert all(r._lang_pred == "l51" for r in found if r.doc_id == 100_008)


def test_equal_rows_have_many_keys(spark):
    docs = spark.createDataFrame([(1, "same")] * 5000, "doc_id long, text string").repartition(4)
    assert docs.select(sharding._key(docs.text).alias("k")).distinct().count() > 1000
    found = sharding.shard(docs, 40).groupBy("shard").count().collect()
    assert len(found) == 40 and all(r["count"] == 125 for r in found)


def test_token_counts_query_against_plain_programming(spark):
    """Every row of the query, recomputed word by word from the scores."""
    scores = token_counts.load_scores(queries.tokenizer_file("piece_bpe_32k.model"))
    longest = max(map(len, scores))

    def plain(word):
        text, best = token_counts.MARK + word, [(0, 0)]
        for end in range(1, len(text) + 1):
            ways = [(best[i][0] + scores[text[i:end]], best[i][1] - 1) for i in range(max(0, end - longest), end) if text[i:end] in scores]
            if text[end - 1] not in scores:
                n = len(text[end - 1].encode())
                ways.append((best[end - 1][0] + n * token_counts.UNKNOWN, best[end - 1][1] - n))
            best.append(max(ways))
        return -best[-1][1]

    known: dict[str, int] = {}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op9_trie_token_counts(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        words = [w for w in token_counts._SPACES.split(texts[r.doc_id]) if w]
        for w in words:
            if w not in known:
                known[w] = plain(w)
        assert (r.n_words, r.n_tokens) == (len(words), sum(known[w] for w in words))


def test_quality_of_odd_rows_against_sql(spark):
    rows = [(None, "a b c " * 40), (None, None), (1, "a b c a b c x"), (1, "one two"), (2, "w " * 70_000), (3, "- x\n- x\n...\n" * 30), (4, "é ü " * 60 + "\x0b#$%")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality.quality_rules(docs.selectExpr("*", "'x' AS _words", "1 AS n_words")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
    same_rows(found, quality.ORACLE_SQL, documents=docs)


@pytest.mark.parametrize("name", ["op7_quality_rules", "op8_license_diagonals", "op10_source_mix"])
def test_queries_against_their_sql(spark, name):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")}
    same_rows(queries.queries()[name](spark, SF), queries.oracles()[name], **tables)
