"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from workloom.llm import decontaminate, langid, licenses, mixing, ngram_join, quality, secrets, sharding, token_counts, token_records
from workloom.llm.queries import tokenizer_file

LONG = "lorem ipsum dolor sit amet " * 20_000
DOCS = [
    (1, "the cat sat on the mat and looked at the dog", "en", "a"),
    (1, "the cat sat on the mat and looked at the dog", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \t\n ", "de", "b"),
    (None, "der Hund und die Katze sind im Haus", "de", "a"),
    (None, None, None, None),
    (5, LONG, "en", "a"),
    (6, "x" * 50_000, None, "c"),
    (7, "日本語 テキスト 😀", "en", "c"),
    (8, "the cat sat on the mat and looked at the dog", "en", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("size", "shard", "_key", "name", "token", "kind", "n", "_range", "score", "component", "value", "place", "path", "_weight")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(DOCS, SCHEMA)
    return rows.withColumns({c: F.lit("clash") for c in CLASH if c != "path"}).withColumn("path", F.col("source"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", path string")


def by_id(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def operators(spark):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog"), (None, None), (2, "short")], "item_id long, text string")
    weights = spark.createDataFrame([(1, 2.0)], "doc_id long, _weight double")
    return {
        "sharding": lambda d: sharding.shard(d, 3),
        "decontaminate": lambda d: decontaminate.matches(d, bench),
        "clean": lambda d: decontaminate.clean(d, bench),
        "records": lambda d: token_records.round_trip(d, tokenizer_file("byte_bpe_50k.json"), 2),
        "join": lambda d: ngram_join.jaccard_join(d),
        "secrets": lambda d: secrets.secrets(d),
        "langid": lambda d: langid.identify(d),
        "quality": lambda d: quality.quality_rules(d),
        "licenses": lambda d: licenses.scan(d),
        "counts": lambda d: token_counts.token_counts(d, tokenizer_file("piece_bpe_32k.model")),
        "mixing": lambda d: mixing.mix(d, weights),
    }


ROWS = {"decontaminate": 2, "clean": 8, "secrets": 0}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: By operator: columns, and what they hold for a row of DOCS; other columns depend on other rows.
VALUES = {
    "sharding": (("doc_id", "size", "text_crc32", "law"), lambda i, t: (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "bytes")),
    "join": (("doc_id", "n_shingles"), lambda i, t: (i, len({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}) if (w := WORD.findall((t or "").lower())) else 0)),
    "licenses": (("doc_id", "n_words", "n_base", "labels", "score"), lambda i, t: (i, len(LICENSE_WORD.findall(t or "")), 0, "", 0.0)),
    "counts": (("doc_id", "n_words"), lambda i, t: (i, len(WORD.findall(t or "")))),
    "quality": (("doc_id", "n_words", "word_chars"), lambda i, t: (i, len(w := WORD.findall(t or "")), sum(map(len, w)))),
    "mixing": (("doc_id", "size", "source"), None),
    "langid": (("doc_id", "held_out"), lambda i, t: (i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2)),
}


@pytest.mark.parametrize("name", ["sharding", "decontaminate", "clean", "records", "join", "secrets", "langid", "quality", "licenses", "counts", "mixing"])
def test_odd_rows_and_empty_tables(spark, docs, none, name):
    run = operators(spark)[name]
    found = run(docs).collect()
    assert len(found) == ROWS.get(name, len(DOCS))
    if name in VALUES:
        columns, value = VALUES[name]
        expected = [value(i, t) for i, t, *_ in DOCS] if value else [(i, len(WORD.findall(t or "")), s) for i, t, _, s in DOCS]
        assert sorted((tuple(r[c] for c in columns) for r in found), key=str) == sorted(expected, key=str)
    if name == "records":
        plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
        ids = [(i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t, *_ in DOCS]
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=str) == sorted(((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids), key=str)
        placed = sorted(found, key=lambda r: r.start)
        assert [r.start for r in placed[1:]] == [r.start + r.n_tokens for r in placed[:-1]] and placed[0].start == 0
        assert [r.doc_id for r in placed] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    if name == "decontaminate":
        assert sorted(tuple(r) for r in found) == [(1, 1, 0), (8, 1, 0)]
    if name == "clean":
        assert sorted((r.doc_id, r.text) for r in found if r.doc_id)[:1] == [(5, LONG)] or {r.doc_id for r in found} == {2, 3, 4, 5, 6, 7, None}
    assert run(none).count() == 0


def test_join_defines_nulls(spark, docs):
    found = by_id(ngram_join.jaccard_join(docs), "doc_id", "n_shingles", "component_id")
    assert (2, 0, 2) in found and (3, 0, 3) in found and (4, 0, 4) in found and (None, 0, None) in found
    assert (1, 7, 1) in found and (8, 7, 1) in found and (None, 4, None) in found and (6, 1, 6) in found and (5, 5, 5) in found


def test_clean_keeps_columns(spark, docs):
    bench = spark.createDataFrame([(1, "looked at the dog the cat sat on the mat")], "item_id long, text string")
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == len(DOCS)


def test_quality_of_no_words(spark, docs):
    found = {r.doc_id: r for r in quality.quality_rules(docs.filter("doc_id IN (2, 3, 4)")).collect()}
    assert all(r.n_words == r.word_chars == r.n_symbols == r.n_dup_lines == r.n_repeat_words == 0 and r.base_failed and not r.kept for r in found.values())


def test_langid_of_no_letters(spark, docs):
    found = langid.identify(docs)
    assert {r.lang_pred for r in found.filter("doc_id IN (2, 3, 4)").collect()} == {"und"}


def test_mix_of_equal_weights_and_no_words(spark):
    docs = spark.createDataFrame([(i, "a b c d", s) for i, s in enumerate("xxxyyz")] + [(9, None, None)], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert found[9].size == 0 and found[9].taken == 0
    assert sum({r.source: r.target for r in found.values()}.values()) == pytest.approx(24)
