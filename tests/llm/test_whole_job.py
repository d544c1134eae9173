"""Cases that an operator once left out."""

from __future__ import annotations

import hashlib
import random
import string
from collections import Counter

import pytest
from against_sql import same_rows
from pyspark.sql import functions as F

from workloom.llm import mixing


@pytest.mark.parametrize("alphabet", [string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters])
def test_secrets_after_a_key_whatever_their_characters(spark, alphabet):
    from workloom.llm import secrets

    rnd, rows, values = random.Random(5), [], {}
    for form in ("token = %s of", 'the password: "%s" and', "access key %s there", "and password=%s here"):
        for n in range(12, 25):
            for _ in range(4):
                values[len(rows)] = hashlib.sha256((value := "".join(rnd.choice(alphabet) for _ in range(n))).encode()).hexdigest()
                rows.append((len(rows), f"some words {form % value}", "src1"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    looked_at = {(r.doc_id, hashlib.sha256(r.value.encode()).hexdigest()) for r in secrets.candidates(docs).collect()}
    assert looked_at == set(values.items())
    found = {(r.doc_id, r.value_sha256) for r in secrets.secrets(docs).collect()}
    assert found <= looked_at and len(found) >= 0.95 * len(values)


def test_candidates_by_form(spark):
    from workloom.llm import secrets

    rows = {
        "abcdef7ghijk alone": "abcdef7ghijk",
        "7abcdefghijk alone": "7abcdefghijk",
        "pwd: hunter-two! next": "hunter-two",
        "password = 'p@ss;w0rd' next": "p@ss;w0rd",
        "secret=aB$9xy&Qw, next": "aB$9xy&Qw",
        "password: short and": None,
        "internationalisation alone": None,
    }
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(rows)], "doc_id long, text string, path string")
    found = {r.doc_id: r.value for r in secrets.candidates(docs).collect()}
    assert [found.get(i) for i in range(len(rows))] == list(rows.values())


def test_edited_passages_are_found_by_default(spark):
    """Words of 5 to 7 letters fully replaced: one in any item, two where these are within a tenth of the item."""
    from workloom.llm import decontaminate

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(5, 7)))
    items = [(i, " ".join(word() for _ in range(12 + i % 20))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, expected = [], set()
    for i, text in items:
        for words in (1, 2):
            parts = text.split()
            at = rnd.sample(range(len(parts)), words)
            if sum(len(parts[j]) for j in at) <= len(text) // 10:
                for j in at:
                    parts[j] = "0" * len(parts[j])
                expected.add((len(rows), i))
                rows.append((len(rows), f"before it {' '.join(parts)} and after"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(expected) > 60
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()} == expected
    assert decontaminate.clean(docs, bench).count() == 0


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    """Null ids, and one id with two texts, of which one has a smaller partner."""
    import corpus_pipeline as pipeline

    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (2, text("b")), (3, text("c")), (None, text("d")), (None, text("e"))]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], schema)
    unique = pipeline.near_duplicates(spark, docs, str(tmp_path))
    expected = [(1, text("a")), (2, text("b")), (3, text("c")), (None, text("d")), (None, text("e"))]
    assert sorted(((r.doc_id, r.text) for r in unique.collect()), key=str) == sorted(expected, key=str)
    assert unique.columns == docs.columns

    # one source, so that the mix takes each row once: nulls, alike rows and texts of one id all stay
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mixed = pipeline.source_mix(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in mixed.collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("stage", ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mix", "sharding"])
def test_every_row_of_a_stage(spark, tmp_path, stage):
    """Null ids, no texts, a very long one, repeated rows, columns named like a stage's own, an empty table."""
    import corpus_pipeline as pipeline

    clash = ("_row", "_gone", "_id", "_copy", "_letters", "_score", "_lang_pred", "_times", "size", "name", "_key", "n_chars")
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in clash)
    text = lambda x, n=40: " ".join(f"the {5 * x}{i} of" for i in range(n))
    base = [(1, text("a")), (2, text("b")), (2, text("c")), (2, text("c")), (None, text("d")), (None, text("e")), (3, None), (4, ""), (5, "12 34 56"), (6, text("f", 60_000)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "src", *clash) for i, t in base], schema)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text("b")), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = dict(pipeline.STAGES)[stage]
    found = run(spark, docs, str(tmp_path))
    got = Counter((r.doc_id, r.text) if stage != "sharding" else r.doc_id for r in found.collect())
    gone = {
        "language_id": [(3, None), (4, ""), (5, "12 34 56"), (None, None)],
        "ngram_jaccard_join": [(2, text("c"))],
        "benchmark_decontamination": [(2, text("b"))],
        "source_mix": [(3, None), (4, ""), (None, None)],
        "sharding": [],
    }[stage]
    expected = Counter(base) - Counter(gone)
    assert got == (expected if stage != "sharding" else Counter(i for i, _ in base))
    if stage != "sharding":
        assert found.columns == docs.columns and all(tuple(r)[4:] == clash for r in found.collect())
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_survivors_follow_from_the_table(spark, tmp_path):
    """Rows alike in doc_id and text but not in the rest, in another order each time; copies without a doc_id; maps that can't be compared."""
    import corpus_pipeline as pipeline

    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [(7, text("a"), "en", "b"), (7, text("a"), "de", "a"), (7, text("a"), None, "a"), (None, text("d"), "en", "z"), (None, text("d"), "en", "y"), (None, text("d") + " more", "en", "x"), (9, text("d") + " more", "en", "w"), (None, " ", "en", "q"), (None, None, "en", "q")]
    docs = spark.createDataFrame([(*r, {"k": i}) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, extra map<string,int>")
    expected = {(7, None, "a"), (9, "en", "w"), (None, "en", "q")}
    for seed in (1, 2):
        found = pipeline.near_duplicates(spark, docs.orderBy(F.rand(seed)), str(tmp_path)).collect()
        assert {(r.doc_id, r.lang, r.source) for r in found} == expected and len(found) == 4


def test_a_row_taken_very_often_is_made_by_many_tasks(spark, tmp_path, monkeypatch):
    import corpus_pipeline as pipeline

    monkeypatch.setattr(pipeline, "REPEATS", 4)
    docs = spark.createDataFrame([(1, "alike words here", "en", "x")] * 23 + [(2, "other words", "en", "x")], "doc_id long, text string, lang string, source string")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mixed = pipeline.source_mix(spark, docs, str(tmp_path))
    assert Counter(r.doc_id for r in mixed.collect()) == {1: 23, 2: 1} and mixed.columns == docs.columns


def test_source_mix_parts_words_as_the_contract_says(spark):
    odd = ["a\x0bb\x0cc\rd", "a\tb\nc d", "\x1fa\x1cb", " a b", " \r ", "x\x85y", None, ""]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(odd * 3)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    found = mixing.mix(docs, mixing.label_weights(labels)).drop("source")
    same_rows(found.withColumn("target", F.round("target", 6)), f"SELECT * REPLACE (round(target, 6) AS target) FROM ({mixing.oracle_sql()})", documents=docs, labels=labels)
    assert {r.size for r in found.filter("doc_id = 0").collect()} == {4}


def test_secrets_in_addresses(spark):
    """The user part of an address is a value of its own; what stands for a password is none."""
    from workloom.llm import secrets

    kept = ["see postgres://user:s3cr3tPassw0rd@db.example.com/prod now", "redis://:9fKd82hQp@cache/0 and on", "amqp://svc-1:Zx81LmQ9vT@10.0.0.7/ then", "set token=ghp_abcdefghijklmnopqrstuvwxyzABCDEF0123 here", "api_key: 9fKd82hQpLm3xZ"]
    left = ["https://user:password@host.example.com/x", "commit 3f2504e04f8941d39a0c0305e82c3301aabbccdd done", "class RequestHandlerFactory2 here", "page id 2024-001-558899", "the url http://example.com:8080/a/b@def", "mail someone@example.com: hello"]
    docs = spark.createDataFrame([(i, t, "src/app.py") for i, t in enumerate(kept + left)], "doc_id long, text string, path string")
    looked_at = {(r.doc_id, r.value) for r in secrets.candidates(docs).collect()}
    assert {(0, "s3cr3tPassw0rd"), (1, "9fKd82hQp"), (2, "Zx81LmQ9vT"), (5, "password")} <= looked_at
    assert not any("@" in v for i, v in looked_at if i < 3)
    found = {(r.doc_id, r.value_sha256) for r in secrets.secrets(docs).collect()}
    values = ["s3cr3tPassw0rd", "9fKd82hQp", "Zx81LmQ9vT", "ghp_abcdefghijklmnopqrstuvwxyzABCDEF0123", "9fKd82hQpLm3xZ"]
    assert found == {(i, hashlib.sha256(v.encode()).hexdigest()) for i, v in enumerate(values)}
