"""The web archive, spelling variants and source divergence: against SQL, brute force and round trips, odd rows included."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from against_sql import same_rows

from workloom.llm import divergence, spelling, warc

PAGE = "page_id long, url string, html string"
LONG = "<p>äöü 😀</p>\r\n\r\nWARC/1.1\r\n" * 400
PAGES = [
    (1, "http://a.example/x y", LONG), (2, "http://a.example/2", LONG), (3, None, LONG + "!"), (3, None, LONG + "!"), (4, "http://b.example", None), (5, "u", ""),
    (None, "http://c.example", LONG), (None, None, "x" * 1000), (None, "v", "x" * 1000), (6, "http://d\r\nWARC-Type: revisit", "y" * 999), (7, "w", "y" * 999),
    (8, "z", "é" * 500), (9, "z", "é" * 500), (9, "zz", "é" * 500), (10, "big", "<b>" + "long text " * 100_000), (11, "big", "<b>" + "long text " * 100_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, PAGE).withColumns({c: F.lit("clash") for c in ("digest", "payload", "head", "n", "first", "slices", "_copy", "bytes")})


@pytest.fixture(scope="module")
def archive(spark, pages, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc") / "archive")
    warc.write(pages, folder)
    return folder


def test_archive_lists_what_sql_lists(spark, pages):
    same_rows(warc.round_trip(pages), warc.ORACLE_SQL, pages=pages)


def test_archive_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_each_payload_is_stored_once(spark, archive):
    stored = [bytes(r.payload) for r in spark.read.parquet(f"{archive}/payloads").collect()]
    assert sorted(stored) == sorted({(h or "").encode() for _, _, h in PAGES})


def test_pages_come_back(spark, archive):
    found = sorted((r.page_id or -1, r.html) for r in warc.pages(spark, archive).collect())
    assert found == sorted((i or -1, h or "") for i, _, h in PAGES)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_are_warc(spark, archive, tmp_path, compression):
    warc.export(spark, archive, f"{tmp_path}/out", per_file=5, compression=compression)
    read = warc.read_warc(spark, f"{tmp_path}/out").collect()
    assert len(read) == len(PAGES)
    payloads = {i: (h or "").encode() for i, _, h in PAGES}
    ids = {r.fields["WARC-Record-ID"] for r in read}
    assert len(ids) == len(PAGES)
    for r in read:
        http, _, body = bytes(r.block).partition(b"\r\n\r\n")
        if r.fields["WARC-Type"] == "revisit":
            assert body == b"" and r.fields["WARC-Refers-To"] in ids and r.fields["WARC-Profile"] == warc.PROFILE
        elif "Page-ID" in r.fields:
            assert body == payloads[int(r.fields["Page-ID"])]
        assert int(r.fields["Content-Length"]) == len(r.block) and http.startswith(b"HTTP/1.1 200 OK")
    assert all("\n" not in r.fields["WARC-Target-URI"] for r in read)


def test_writing_again_gives_the_same_records(spark, pages, archive, tmp_path):
    warc.write(pages.repartition(3), f"{tmp_path}/again")
    both = [sorted(bytes(r[0]) for r in warc.records(spark, f).select(warc.record_bytes()).collect()) for f in (archive, f"{tmp_path}/again")]
    assert both[0] == both[1]


def test_a_damaged_payload_stops_the_read(spark, archive, tmp_path):
    rows = spark.read.parquet(f"{archive}/payloads")
    rows.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{tmp_path}/bad/payloads")
    spark.read.parquet(f"{archive}/records").write.parquet(f"{tmp_path}/bad/records")
    with pytest.raises(Exception, match="damaged"):
        warc.listed(spark, f"{tmp_path}/bad").collect()


def test_a_payload_of_many_records_is_dealt_out(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SHARE", 3)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame([(i, f"u{i}", "same" if i % 2 else "z" * 2000) for i in range(40)], PAGE)
    same_rows(warc.round_trip(pages), warc.ORACLE_SQL, pages=pages)
    warc.write(pages, f"{tmp_path}/a")
    assert {r.slices for r in spark.read.parquet(f"{tmp_path}/a/payloads").collect()} == {7, 1}
    assert sorted(r.html for r in warc.pages(spark, f"{tmp_path}/a").collect()) == sorted(["same"] * 20 + ["z" * 2000] * 20)


TEXTS = [
    (1, "the Receiver recieved reciever receiver receivers receiver receiver; Éclair éclair"), (2, None), (3, ""), (4, "123 ... ÷×÷ 日本語"),
    (5, "receiver " * 200 + "recevier " * 3 + "receiveer " * 7 + "receivr " * 6), (None, "receiver receiver"), (None, None), (6, "abcdef" * 9000), (6, "abcdef" * 9000),
    (7, "éclairs écläirs éclairs éclairs éclairs éclairs ÿÿÿÿÿÿ " * 6), (7, "éclairs écläirs éclairs éclairs éclairs éclairs ÿÿÿÿÿÿ " * 6),
]


def distance_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:])


def test_variants_of_odd_texts(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "m", "block", "form")})
    found = spelling.variants(docs)
    same_rows(found, spelling.ORACLE_SQL, documents=docs.select("doc_id", "text"))
    by = {r.word: r for r in found.collect()}
    assert by["receiveer"].form == "receiver" and by["receiveer"].root == "receiver" and by["receiver"].form is None
    assert spelling.variants(docs.filter("doc_id = 2")).count() == 0


def test_a_planted_run_loses_the_letter_that_its_hash_names(spark):
    runs = [f"planted{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(26 * 26)]
    docs = spark.createDataFrame([(7, " ".join(f"{r} " * 5 for r in runs))], "doc_id long, text string")
    expected = Counter()
    for r in runs:
        h = zlib.crc32(f"7:{r}".encode())
        expected[r if h % 199 else r[: h % len(r)] + r[h % len(r) + 1 :]] += 5
    assert {r.word: r.n for r in spelling.words(docs).collect()} == expected
    assert any(len(w) == 8 for w in expected)


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_near_pairs_whatever_the_block(spark, block):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(300)} | {"q" * n for n in range(1, 40)} | {"aaaaaa" + c for c in "bcdefghijklmnop"}
    rows = spark.createDataFrame([(w, rng.randint(5, 400)) for w in sorted(words)], "word string, n long")
    expected = {(min(a, b), max(a, b)) for a in words for b in words if distance_one(a, b)}
    found = [tuple(sorted((r.word, r.near))) for r in spelling.near_pairs(rows, block).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_roots_follow_forms_to_the_last(spark):
    chain = spark.createDataFrame([("abcdef", 5), ("abcdeg", 25), ("abcdhg", 125), ("abcihg", 700), ("abkihg", 4000), ("axkihg", 30000)], "word string, n long")
    assert {r.word: r.root for r in spelling.group(chain).collect()} == {w: "axkihg" for w in ("abcdef", "abcdeg", "abcdhg", "abcihg", "abkihg", "axkihg")}


def test_ties_go_to_the_smallest_word(spark):
    rows = spark.createDataFrame([("letters", 50), ("lettera", 50), ("letter", 10)], "word string, n long")
    assert {(r.word, r.form, r.n_near, r.form_n) for r in spelling.group(rows).collect()} == {("letter", "lettera", 2, 50), ("letters", None, 2, None), ("lettera", None, 2, None)}


def corpus(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for lang, words in (("en", ["the", "cat", "Éa", "dog", "x日本", "a1b"]), ("de", ["der", "hund", "ß", "the"]), (None, ["null", "term"]), ("fr", ["rare"])):
        for i in range(90 if lang != "fr" else 8):
            source = rng.choice(["s1", "s2", None, "hot", "hot", "hot"])
            rows.append((i, " -.".join(rng.choices(words, [2 ** -k for k in range(len(words))], k=rng.randint(0, 30))).title() if i % 7 else None, lang, source))
    return rows + [(1000, "the cat " * 20_000, "en", "long"), (1001, "...", "en", "none"), (None, "the", "en", "s1"), (5, "the cat", "en", "s1"), (5, "the cat", "en", "s1"), (2000, None, "xx", "alone")]


@pytest.mark.parametrize("whole", [10**6, 0])
def test_divergence_equals_sql(spark, whole, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("term", "n", "p", "v", "block", "total", "p0")})
    found = divergence.divergence(docs.repartition(5), whole=whole)
    same_rows(found, divergence.ORACLE_SQL, documents=docs.select("doc_id", "text", "lang", "source"))


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
