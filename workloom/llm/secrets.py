"""Secret scans: candidate strings, judged by a random forest that removes false positives. DataFrame operations only.

Candidates are all runs of 12 or more characters with a digit anywhere, and whatever has ``KEYED_LEAST`` or more characters and
follows a key name, an equals sign or a colon, in the same word or as the next one. A word is cut where a further name with
its sign begins, so each of its values is a candidate. A key's value may hold any characters but blanks and quotes, and ends
with its last letter or digit; it ends before a comma, semicolon or ampersand if what stands there is such a run already. The
password of a login in an address (scheme://user:password@host) is a candidate from 6 characters on. What is no secret is left to
the forest.

Features of a candidate: length, kinds of characters, how much likelier its character transitions are in secrets than in other
values (a table of conditional frequencies, counted in the labelled findings), changes of character class, share of distinct
characters, dictionary coverage (letters under words of the dictionary), consonants in a row, words before and after it, and
the path it comes from. The forest is trained by Spark on labelled findings and then compiled into one column expression, so
scoring is part of the projection that makes the features; nothing is shuffled and no model is shipped.

``findings`` are labelled rows: value, before (the words before it), after, path, label (1: a secret). Where none are given,
the set of ``synthetic_findings`` is used: values of known formats and of their usual look-alikes, made from hashes of row
numbers, alike in every run. It has ``FINDINGS`` rows whatever the size of the corpus.

Defined results
    null or empty text: no findings. null doc_id or path: carried through, a null path is an empty one. Repeated rows: found
    in each. Findings of a text are told apart by the place of their word and their value; a value that stands twice in a word
    is one. Very long words: their values like any others, in time proportional to their length. Empty table: no rows. Other
    columns of the input, whatever their names, are not read and not returned.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from workloom.llm.runtime import SPACE, materialize

FINDINGS = 12_000
TREES, DEPTH = 12, 6
#: Characters of the shortest value that is looked at after a key.
KEYED_LEAST = 8

# Words before a value that speak for or against a secret, parts of paths, and a small dictionary.
FOR = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "auth", "bearer", "credential", "access")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "guid", "id", "example", "sample", "version", "image", "revision")
PATHS = ("test", "example", "sample", "fixture", "doc", "mock", "vendor")
DICTIONARY = (
    "your changeme change example sample test user name password secret token here placeholder dummy default value insert enter "
    "the and for with that this from have not are was all can will one data file string number index table service config "
    "server client request response error message manager handler factory builder request controller module system content "
    "public private static return function class object method image video page mail http https www com org net html json"
).split()
#: Parts of words, for made-up prose.
SYLLABLES = (
    "an ar be ber bra ca che ción co con cre dad de den der di do ed el en ent er es est ge gra ha heit in ing inter ir ka ke keit la le lich "
    "ling lo ly ma man me men ment mi na ne ness ni no on or ou par per pla pre pro que ra re ri ro ru sa sch schaft sen ser sha si so sta "
    "ste str su ta te ten ter th ther ti tion to tra tri tu un ung ver vo wa we wer za zu"
).split()

_PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|xox[bp]-|sk_|sk-|AIza|eyJ)"
_WS = r"\x20\x09-\x0D"
#: A known prefix with a value, and a run of 12 or more with a digit anywhere. Nothing here goes back over a long run.
_PREFIXED = rf"(?<![A-Za-z0-9]){_PREFIX}[A-Za-z0-9_\-.]{{8,}}+"
_RUN = r"(?<![A-Za-z0-9_+.\-])(?<![A-Za-z0-9_+.\-]/)(?=[A-Za-z_+/.\-]*+[0-9])[A-Za-z0-9_+\-][A-Za-z0-9_+/.\-]{11,}+={0,2}"
#: A word that may hold a candidate whatever stands before it.
CANDIDATE = rf"[=:][^{_WS}]{{{KEYED_LEAST},}}|{_PREFIXED}|{_RUN}"
_NAMES = "(?i:(?<![A-Za-z])(?:" + "|".join(FOR) + "))"
#: The end of a word that makes the next one a candidate, and both in a whole text.
_KEY_BEFORE = rf"(?:[=:]|{_NAMES})[\"'`(\[{{<>}}\])]{{0,8}}"
_KEYED = rf"{_KEY_BEFORE}[{_WS}]+[^{_WS}]{{{KEYED_LEAST}}}"
#: What every such text holds: one cheap look spares most of the others the patterns above.
_HINT = f"[0-9=:]|{_PREFIX}|{_NAMES}"
#: Where a further name and its sign begin in a word.
_NEXT_NAME = r"[,;&?](?=[\"'`{\[]{0,4}[A-Za-z_][A-Za-z0-9_.\-]{0,40}[\"'`\])]{0,4}[=:])"
_OPEN, _LAST = r"[\"'`(\[{<]{0,8}", r"[\p{L}\p{N}]={0,2}"
#: Values after a key name and its sign, after a sign at all, and of a whole word.
_NAMED_VALUE = rf"{_NAMES}[\"'\])]{{0,8}}[=:]+>?{_OPEN}([^\"'`]{{{KEYED_LEAST - 1},}}{_LAST})"
_SIGNED_VALUE = rf"[=:](?!//){_OPEN}([^\"'`=:]{{{KEYED_LEAST - 1},}}{_LAST})[^\p{{L}}\p{{N}}]*$"
_WORD_VALUE = rf"^{_OPEN}([^\"'`]{{{KEYED_LEAST - 1},}}{_LAST})"
#: The password of a login in an address, up to the at sign before the host.
_LOGIN = r"[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^/@:\"'`]{0,80}:([^/@\"'`]{6,})@[A-Za-z0-9.\[]"

#: Kinds of characters in a transition: 26 letters whatever their case, digits, all others.
KINDS = 28


def _kind(c: Column) -> Column:
    low = F.ascii(F.lower(c))
    return F.when(low.between(97, 122), low - 97).when(low.between(48, 57), 26).otherwise(27)


def with_parts(rows: DataFrame) -> DataFrame:
    """Adds the characters of ``value`` and their kinds, which the features look at one by one."""
    chars = rows.withColumns({"_chars": F.split("value", "(?<=.)(?=.)"), "_low": F.split(F.lower("value"), "(?<=.)(?=.)")})
    return chars.withColumn("_kinds", F.transform("_chars", _kind))


def _transitions() -> Column:
    """The number of each pair of neighbouring characters."""
    after = F.slice("_kinds", 2, F.greatest(F.size("_kinds") - 1, F.lit(0)))
    return F.transform(after, lambda k, i: F.get("_kinds", i) * KINDS + k)


def transition_table(findings: DataFrame) -> list[float]:
    """For each pair of kinds: the logarithm of how much likelier the second follows the first in secrets than in other values."""
    pairs = with_parts(findings).select("label", F.explode(_transitions()).alias("pair")).groupBy("label", "pair").count()
    seen = {(int(r["label"] > 0), r["pair"]): r["count"] for r in pairs.collect()}  # two for each pair of kinds at most
    of_first = {(y, a): sum(seen.get((y, a * KINDS + b), 0) for b in range(KINDS)) for y in (0, 1) for a in range(KINDS)}
    chance = lambda y, a, b: (seen.get((y, a * KINDS + b), 0) + 0.5) / (of_first[y, a] + 0.5 * KINDS)
    return [round(log(chance(1, a, b) / chance(0, a, b)), 6) for a in range(KINDS) for b in range(KINDS)]


def _coverage(dictionary: Iterable[str]) -> Column:
    """Characters under words of the dictionary, at each place the longest."""
    words = sorted({w.lower() for w in dictionary if w})
    lengths = sorted({len(w) for w in words}, reverse=True)
    low = F.lower("value")
    at = lambda i, n: low.substr(i + 1, F.lit(n))
    longest = lambda x, i: F.when(~x.between("a", "z"), 0).otherwise(F.coalesce(*[F.when(at(i, n).isin([w for w in words if len(w) == n]), n) for n in lengths], F.lit(0)))
    places = F.transform("_low", lambda x, i: F.struct((i + 1).alias("at"), longest(x, i).alias("n")))
    start = F.struct(F.lit(0).alias("sum"), F.lit(1).alias("open"))
    add = lambda s, p: F.struct(
        (s["sum"] + F.greatest(p["at"] + p["n"] - F.greatest(s["open"], p["at"]), F.lit(0))).alias("sum"), F.greatest(s["open"], p["at"] + p["n"]).alias("open")
    )
    return F.aggregate(F.filter(places, lambda p: p["n"] > 0), start, add, lambda s: s["sum"])


def features(transitions: list[float], dictionary: Iterable[str]) -> dict[str, Column]:
    """Numbers by name, of rows ``with_parts``: value, before and after (the words beside the value, and what stands beside it
    in its own word), path."""
    value, before, after, path = map(F.col, ("value", "before", "after", "path"))
    n = F.char_length(value).cast("double")
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    beside = lambda c, names: F.coalesce(F.lower(c).rlike(r"(?:^|[\s\"'(\[{,;=:])(?:" + "|".join(names) + r")(?:$|[^a-z.@])"), F.lit(False)).cast("double")
    changes = r"(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    table = F.from_json(F.lit(json.dumps(transitions)), "array<double>")
    likelier = F.aggregate(_transitions(), F.lit(0.0), lambda s, pair: s + F.get(table, pair))
    return {
        "length": n,
        "transitions": likelier / n,
        "changes": count(changes) / n,
        "digits": count("[0-9]") / n,
        "uppers": count("[A-Z]") / n,
        "others": count("[^A-Za-z0-9]") / n,
        "hex": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "vowels": count("(?i)[aeiou]") / n,
        "distinct": F.size(F.array_distinct("_chars")) / n,
        "odd": count("(?i)[bcdfghjklmnpqrstvwxz]{4}|[jqxz]") / n,
        "dictionary": _coverage(dictionary) / n,
        "uuid": value.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-").cast("double"),
        "prefix": value.rlike("^" + _PREFIX).cast("double"),
        "login": (before.rlike(r"://[^/@\s]{0,80}:$") & after.startswith("@")).cast("double"),
        "for": beside(before, FOR),
        "against": beside(before, AGAINST),
        "against_after": beside(after, AGAINST),
        "path": F.coalesce(F.lower(path).rlike("|".join(PATHS)), F.lit(False)).cast("double"),
    }


def synthetic_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """value, before, after, path, label of n made-up findings."""
    i = F.col("id")
    hexes = F.sha2(F.concat(F.lit("h"), i), 256)
    base64 = F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), i), 256))), "+/=", "xyz")
    pick = lambda salt, xs: F.get(F.array(*map(F.lit, xs)), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(xs))).cast("int"))
    word = lambda salt: pick(salt, DICTIONARY)
    length = (KEYED_LEAST + F.pmod(F.xxhash64(i, F.lit(9)), F.lit(42 - KEYED_LEAST))).cast("int")
    plain = pick(1, ("", "of the", "and on", "see also", "ist das", "que la", "dans une"))
    keyed = F.concat(plain, F.lit(" "), pick(2, ("password=", "token = ", "api_key: ", "secret=", "access key", "Authorization: Bearer ", '{"token":"', "https://h/a?token=", "export SECRET_KEY=", "key=")))
    hashed = F.concat(plain, F.lit(" "), pick(3, ("commit", "sha256:", "md5 ", "checksum:", "revision", "image id", "uuid=")))
    path = pick(4, ("src/app.py", "config/prod.env", "src3", "web/page.html", "tests/test_api.py", "docs/example.md", ""))
    upper = F.translate(F.upper(base64), "0189", "ABCD")
    digits = F.substring(F.translate(hexes, "abcdef", "123456"), 1, 16)
    small = F.translate(F.lower(base64), "0123", "ghij")
    letters = F.translate(base64, "0123456789", "qWeRtZuIoP")
    marked = F.concat(F.substring(base64, 1, 3), pick(14, tuple("!@#$%&*?")), F.substring(base64, 4, length - 5), pick(15, tuple("!@#$%&*?,;")), F.substring(base64, 40, 1))
    syllable = lambda salt: pick(salt, SYLLABLES)
    prose = F.concat(*map(syllable, (16, 17, 18)), F.when(i % 3 == 0, syllable(19)).otherwise(""), pick(20, ("", "", "s", "en", "e")))
    prose = F.rpad(F.when(F.pmod(F.xxhash64(i, F.lit(21)), F.lit(3)) == 0, F.initcap(prose)).otherwise(prose), F.greatest(F.lit(KEYED_LEAST), F.char_length(prose)), "e")
    near = F.concat(plain, F.lit(" "), pick(22, ("password:", "the key", "token", "an access", "secret:", "note:", "auth", "key =", "api_key", "result:", "type=")))
    login = F.concat(plain, F.lit(" "), pick(42, ("postgres", "mysql", "redis", "amqp", "https", "ftp", "mongodb+srv")), F.lit("://"), pick(43, ("user", "admin", "app", "root", "svc-1", "")), F.lit(":"))
    name = F.concat(F.initcap(word(5)), F.initcap(word(6)), F.initcap(word(7)), pick(8, ("", "2", "V1", "64", "Impl")))
    kinds = (
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), plain, 1),
        (F.concat(F.lit("ghp_"), F.substring(base64, 1, 36)), plain, 1),
        (F.concat(F.lit("sk_live_"), F.substring(base64, 1, 24)), plain, 1),
        (F.substring(hexes, 1, length), keyed, 1),
        (F.substring(hexes, 1, 40), keyed, 1),
        (F.substring(base64, 1, length), keyed, 1),
        (F.substring(base64, 3, length), keyed, 1),
        (F.substring(small, 1, length), keyed, 1),
        (F.substring(letters, 1, length), keyed, 1),
        (F.lower(F.substring(letters, 1, length)), keyed, 1),
        (marked, keyed, 1),
        (F.substring(hexes, 1, 40), hashed, 0),
        (F.substring(hexes, 1, 32), plain, 0),
        (F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)), pick(11, ("", "id", "uuid", "token = ")), 0),
        (digits, plain, 0),
        (name, pick(12, ("", "class", "token = ", "password=")), 0),
        (F.concat_ws("_", word(5), word(6), word(7), F.lit("here1")), keyed, 0),
        (F.concat(word(5), word(6), F.lit("."), F.substring(digits, 1, 2), F.lit("-"), word(7)), plain, 0),
        (F.concat_ws("/", word(5), word(6), word(7), F.concat(word(8), F.substring(digits, 1, 4))), plain, 0),
        (F.repeat(pick(13, ("x", "0", "1", "a", "12")), 14), keyed, 0),
        (prose, near, 0),
        (F.concat(prose, pick(23, (".", "-", "_", "/", ",")), syllable(24), syllable(25)), near, 0),
        (F.concat(syllable(26), syllable(27), pick(23, (".", "_", "")), F.substring(digits, 1, 2), F.lit("@"), syllable(28), F.lit("mail.example.com")), pick(29, ("mail:", "contact:", "by", "of the", "from:")), 0),
        (F.concat(pick(30, ("//www.", "https://", "http://", "/")), prose, pick(31, (".com/", ".org/", "/")), syllable(32), F.lit("/"), F.substring(digits, 1, 3)), pick(33, ("http:", "url:", "see", "href=")), 0),
        (F.concat(pick(34, ("+49-", "+1-", "2024-", "(030)")), F.substring(digits, 1, 3), pick(35, ("-", "/", ".")), F.substring(digits, 4, 6)), pick(36, ("call:", "phone:", "date:", "")), 0),
        (F.concat_ws("-", F.lit("2024"), F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 6)), plain, 0),
        (F.substring(base64, 1, (6 + F.pmod(F.xxhash64(i, F.lit(45)), F.lit(20))).cast("int")), login, 1),
        (F.concat(F.substring(base64, 2, 5), F.substring(digits, 1, 2), F.substring(small, 3, 4), pick(49, tuple("!_-.$0123"))), login, 1),
        (pick(50, ("password", "changeme", "yourpassword", "secret", "example", "placeholder", "user-password", "xxxxxxxx", "PASSWORD", "pass-word-here")), login, 0),
    )
    kind = F.pmod(i, F.lit(len(kinds))).cast("int")
    # a condition for each kind, so that a row makes its own alone
    chosen = lambda j: reduce(lambda w, k: w.when(kind == k[0], F.lit(k[1][j]) if j == 2 else k[1][j]), enumerate(kinds), F.when(F.lit(False), F.lit(None)))
    at_login = F.when(kind >= len(kinds) - 3, pick(44, ("@db.example.com/prod", "@localhost:5432/app", "@10.0.0.7/", "@mail.example.org:993", "@cache/0")))
    after = F.when(at_login.isNotNull(), at_login).when((chosen(2) == 0) & (i % 7 == 0), pick(40, ("is the commit", "(sha1)", "checksum of", "as example"))).otherwise(pick(41, ("", "of the", "and on", '","user":"bob"}', "&x=1", ",x")))
    return spark.range(n).select(chosen(0).alias("value"), chosen(1).alias("before"), after.alias("after"), path.alias("path"), chosen(2).alias("label"))


def _tree(node, names: list[str]) -> Column:
    """A decision tree of Spark's as nested conditions; a leaf is its share of secrets."""
    if node.subtreeDepth() == 0:
        seen = node.impurityStats()
        return F.lit(float(seen.stats()[1]) / max(1e-9, float(sum(seen.stats()))))
    split = node.split()
    left = F.col(names[split.featureIndex()]) <= split.threshold()
    return F.when(left, _tree(node.leftChild(), names)).otherwise(_tree(node.rightChild(), names))


def train(findings: DataFrame, dictionary: Iterable[str] = DICTIONARY) -> tuple[Column, list[float]]:
    """The forest as an expression over columns named as the features, and the transitions they need."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    findings = findings.filter("value <> '' AND label IS NOT NULL")
    table = transition_table(findings)
    made = features(table, dictionary)
    rows = with_parts(findings).select(*[c.alias(f"_f_{k}") for k, c in made.items()], F.col("label").cast("double").alias("label"))
    names = [f"_f_{k}" for k in made]
    ready = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(materialize(rows))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5, featuresCol="features", labelCol="label").fit(ready)
    votes = [_tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"), names) for t in model.trees]
    # summed by a fold, which Spark interprets: as one generated method the trees would be too long to compile
    return F.aggregate(F.array(*votes), F.lit(0.0), lambda a, x: a + x) / len(votes), table


def _values(part: Column, follows: Column) -> Column:
    """All values of a part of a word; follows: whether what stands before makes the whole of it one."""
    some = lambda x: F.nullif(x, F.lit(""))
    keyed = F.coalesce(
        some(F.regexp_extract(part, _NAMED_VALUE, 1)), some(F.regexp_extract(part, _SIGNED_VALUE, 1)), F.when(follows, some(F.regexp_extract(part, _WORD_VALUE, 1)))
    )
    of = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all(part, F.lit(pattern), 0), lambda x: F.btrim(x, F.lit("."))))
    login = F.array_distinct(F.regexp_extract_all(part, F.lit(_LOGIN), 1))
    return F.struct(keyed.alias("keyed"), login.alias("login"), of(_PREFIXED).alias("known"), F.filter(of(_RUN), lambda x: F.char_length(x) >= 12).alias("plain"))


def _chosen(found: Column) -> Column:
    """The key's value and the runs outside it; the runs alone where one tells its kind by a known prefix, or is followed by a mark that ends values."""
    keyed, login = found["keyed"], found["login"]
    known = F.concat(login, F.filter(found["known"], lambda x: ~F.exists(login, lambda y: y.contains(x))))
    runs = F.concat(known, F.filter(found["plain"], lambda x: ~F.exists(known, lambda y: x.contains(y))))
    ends = lambda x: F.exists(F.array(*map(F.lit, ",;&")), lambda m: keyed.startswith(F.concat(x, m)))
    instead = F.exists(runs, lambda x: (keyed != x) & keyed.contains(x) & (x.rlike("^" + _PREFIX) | ends(x) | F.array_contains(login, x)))
    return F.when(keyed.isNull() | instead, runs).otherwise(F.concat(F.array(keyed), F.filter(runs, lambda x: ~keyed.contains(x))))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, place (of the word), value, before, after for every candidate of every text."""
    text = F.col("text").cast("string")
    held = docs.filter(text.rlike(_HINT) & (text.rlike(CANDIDATE) | text.rlike(_KEYED))).select("doc_id", "path", F.split(text, SPACE).alias("_w"))
    w = F.col("_w")
    keyed = lambda x, i: (F.char_length(x) >= KEYED_LEAST) & F.coalesce(F.get(w, i - 1).rlike(_KEY_BEFORE + "$"), F.lit(False))
    near = F.transform(
        w,
        lambda x, i: F.when(
            x.rlike(CANDIDATE) | keyed(x, i),
            F.struct(
                i.alias("place"), x.alias("word"), keyed(x, i).alias("follows"),
                F.concat_ws(" ", F.get(w, i - 3), F.get(w, i - 2), F.get(w, i - 1)).alias("before"),
                F.concat_ws(" ", F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3)).alias("after"),
            ),
        ),
    )
    # Outer explodes: for others Spark puts a filter on the array's size below, with all that makes the array copied into its lambdas.
    found = held.select("doc_id", "path", F.explode_outer(F.array_compact(near)).alias("_c")).filter("_c IS NOT NULL").select("doc_id", "path", "_c.*")
    split = found.withColumn("_parts", F.split("word", _NEXT_NAME)).withColumn("_n", F.size("_parts")).drop("word")
    # neither the word nor the array of its parts may be copied to each part
    parts = split.select("doc_id", "path", "place", "follows", "before", "after", "_n", F.posexplode_outer("_parts").alias("_i", "part"))
    first, last = F.col("_i") == 0, F.col("_i") == F.col("_n") - 1
    valued = parts.withColumn("_found", _values(F.col("part"), F.col("follows") & first))
    each = valued.withColumn("_values", _chosen(F.col("_found"))).drop("_found", "_parts").select("*", F.explode_outer("_values").alias("value")).filter("value IS NOT NULL")
    own = F.expr("substring(part, 1, instr(part, value) - 1)")
    rest = F.expr("substring(part, instr(part, value) + char_length(value))")
    return each.select(
        "doc_id",
        "path",
        F.col("place").cast("long"),
        "value",
        F.concat_ws(" ", F.when(first, F.col("before")), own).alias("before"),
        F.concat_ws(" ", rest, F.when(last, F.col("after"))).alias("after"),
    )


def secrets(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5, dictionary: Iterable[str] = DICTIONARY) -> DataFrame:
    """docs: doc_id, text, path. Returns doc_id, place, n_chars, value_sha256, score of the findings that the forest keeps."""
    forest, table = train(findings if findings is not None else materialize(synthetic_findings(docs.sparkSession)), dictionary)
    found = with_parts(candidates(docs).withColumn("path", F.coalesce("path", F.lit(""))))
    made = features(table, dictionary)
    scored = found.select("doc_id", "place", "value", *[c.alias(f"_f_{k}") for k, c in made.items()])
    return scored.select(
        "doc_id", "place", F.char_length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), forest.alias("score")
    ).filter(F.col("score") >= least)
