"""Queries that have no SQL, held against what plain Python and the learning library's own model say of the same rows."""

from __future__ import annotations

import hashlib
import math
import unicodedata
import zlib
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from workloom.llm import langid, queries, secrets
from workloom.llm.runtime import table

SF = "/root/testdata/sf0.001"


def plain_features(text: str) -> dict[int, float]:
    """Square roots of the counts of byte 1- to 4-grams by bin, scaled to length one; one gram after the other."""
    data = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    counts: dict[int, int] = {}
    for n in range(1, 5):
        for at in range(len(data) - n + 1):
            h = n * 0x165667B1 & 0xFFFFFFFF
            for byte, factor in zip(data[at : at + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), strict=False):
                h = (h ^ byte) * factor & 0xFFFFFFFF
                h ^= h >> 15
            counts[h % 4096] = counts.get(h % 4096, 0) + 1
    length = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(v) / length for k, v in counts.items()}


def plain_prediction(model, text: str | None) -> tuple[str, float]:
    if not text or not any(unicodedata.category(c).startswith("L") for c in text):
        return "und", 0.0
    x = plain_features(text)
    margin = lambda w: sum(v * float(w[k]) for k, v in x.items()) + float(w[-1])
    sure = lambda m: 1 / (1 + math.exp(-4 * max(-8.0, min(8.0, m))))
    families, score = sorted(model.members), 1.0
    chosen = families[0]
    if len(families) > 1:
        margins = [margin(model.family[:, i]) for i in range(len(families))]
        score, chosen = sure(max(margins)), families[margins.index(max(margins))]
    members = model.members[chosen]
    if len(members) == 1:
        return members[0], score
    votes, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    for a, b in combinations(members, 2):
        m = margin(model.pairs[a, b])
        votes[a if m > 0 else b] += 1
        sums[a] += m
        sums[b] -= m
    best = max(members, key=lambda lang: (votes[lang], sums[lang]))
    return best, score * sure(sums[best] / (len(members) - 1))


def test_language_query_against_plain_python(spark, monkeypatch):
    learned, train = [], langid.train
    monkeypatch.setattr(langid, "train", lambda rows: learned.append(train(rows)) or learned[-1])
    found = queries.op6_language_families(spark, SF).collect()
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert len(found) == len(docs) == len({r.doc_id for r in found})
    for r in found:
        lang, score = plain_prediction(learned[0], docs[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3)


def test_features_of_odd_texts_against_plain_python(monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 7)  # texts of several parts: grams that cross from one to the next count once
    for text in ("a", "ab", "Zürich ß", "abcdefg", "abcdefgh", "AbCdEfGhIjKlMnOpQrStUvWxYz" * 3):
        row = langid.features([text.encode()])[0]
        expected = plain_features(text)
        assert {i for i, v in enumerate(row) if v} == set(expected)
        assert all(row[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())


def test_forest_expression_against_the_library_s_model(spark, monkeypatch):
    """Every candidate of the table has the score that the fitted model itself gives for its features."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    fitted, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, rows: fitted.append(fit(self, rows)) or fitted[-1])
    findings = secrets.synthetic_findings(spark, 3000)
    made_up = secrets.synthetic_findings(spark, 400).select((F.monotonically_increasing_id() + 10**6).alias("doc_id"), F.concat_ws(" ", "before", "value", "after").alias("text"), "path")
    docs = table(spark, SF, "documents").selectExpr("doc_id", "text", "source AS path").unionByName(made_up)
    found = {(r.doc_id, r.place, r.value_sha256): r.score for r in secrets.secrets(docs, findings, least=0.0).collect()}

    made = secrets.features(secrets.transition_table(findings.filter("value <> '' AND label IS NOT NULL")), secrets.DICTIONARY)
    rows = secrets.with_parts(secrets.candidates(docs).withColumn("path", F.coalesce("path", F.lit("")))).select("doc_id", "place", "value", *[c.alias(f"_f_{k}") for k, c in made.items()])
    ready = VectorAssembler(inputCols=[f"_f_{k}" for k in made], outputCol="features", handleInvalid="keep").transform(rows)
    said = fitted[0].transform(ready).select("doc_id", "place", "value", vector_to_array("probability")[1].alias("p")).collect()
    expected = {(r.doc_id, r.place, hashlib.sha256(r.value.encode()).hexdigest()): r.p for r in said}
    assert found.keys() == expected.keys() and len(found) > 100
    assert all(found[k] == pytest.approx(expected[k], abs=1e-9) for k in found)
    assert min(expected.values()) < 0.5 <= max(expected.values())
