"""Secret scans: pattern candidates, then a random forest that removes false positives.

Candidates are runs of 16 and more key-like characters (with single dots inside,
as in tokens of several parts) that hold a digit, and whatever is assigned to a
name for secrets (``password = ...``), of 6 characters and more, whatever its
signs.  A random forest (30 trees of depth 6) tells secrets from hashes, ids,
numbers, words and placeholders by length, character transitions, dictionary
coverage, the path and the neighbouring words on both sides.  It is trained from
labelled findings: any table of value, before, after, path and label, or by
default a set made by rule from families of forms (below).  Everything runs in
DataFrame functions and the JVM's forest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fabula.llm.pii import found_spans
from fabula.llm.runtime import Scratch, keep_columns

LEAST_LENGTH = 6
_KEY_LIKE = "A-Za-z0-9+/=_-"
_NAMES = "passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential"
#: A run of key-like characters, or a value that is assigned to one of the names.
CANDIDATE = (
    rf"(?<=[:=][\"'` ]{{0,2}})(?<=(?i:{_NAMES})[\"' ]{{0,2}}[:=][\"'` ]{{0,2}})[^\s\"'`<>:=][^\s\"'`<>]{{5,}}+"
    rf"|(?<![{_KEY_LIKE}])(?:[{_KEY_LIKE}]|(?<=[A-Za-z0-9_-])\.(?=[A-Za-z0-9_-]{{4}})){{16,}}+"
)
ASSIGNED = rf"(?i)(?:{_NAMES})[\"' ]{{0,2}}[:=][\"'` ]{{0,2}}$"
#: Characters on either side in which neighbouring words are sought.
CONTEXT = 48
TREES, DEPTH = 30, 6
#: Labelled findings used for training, at most.
TRAIN_ROWS = 20_000
KEY_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|credential|bearer|private)"
PLAIN_WORDS = r"(?i)(commit|sha|md5|checksum|digest|hash|revision|version|uuid|order|invoice|phone|card|isbn|example|sample)"
PATH_WORDS = r"(?i)(test|example|sample|fixture|mock|docs?/)"
DICTIONARY = (
    "access account address admin agent alpha amount api archive array author backup base batch beta block body branch buffer build bundle cache "
    "channel class client cloud code column common component config connection content context control copy count create current data date default "
    "delete demo detail device document domain download driver email empty entry error event example field file filter folder format frame function "
    "group handler header height hidden home host image index input insert instance item job key language last layout length level library limit line "
    "link list load local lock login main manager map master member memory menu message method mode model module month name network node note number "
    "object option order output package page parent part password path pattern payment person phone place player point policy port position prefix "
    "process product profile project property public query queue random range reader record release remote report request reset result return role "
    "root row rule sample schema search section select sequence server service session setting shared simple size source space stage start state "
    "static status step storage store stream string style submit system table target task temp test text thread time title token total track type "
    "unique update upload user value version view web widget width window work year zone"
).split()
FEATURES = ("size", "distinct", "digits", "upper", "symbols", "transitions", "doubles", "letter_run", "hex", "coverage", "key_word", "plain_word", "assigned", "quoted", "after_key", "after_plain", "test_path")


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` (value, before, after, path) with the columns of FEATURES."""
    v, before, after = F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    size = F.length(v)
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    known = "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    longest = F.array_max(F.transform(F.split(v, "[^A-Za-z]+"), F.length))
    columns = {
        "size": F.least(size, F.lit(256)).cast("double"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(size, F.lit(40)),
        "digits": count("[0-9]") / size,
        "upper": count("[A-Z]") / size,
        "symbols": count("[^A-Za-z0-9]") / size,
        "transitions": count("(?<=[0-9])[^0-9]|(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[+/=_-])[^+/=_-]") / size,
        "doubles": count(r"(.)\1") / size,
        "letter_run": longest / size,
        "hex": flag(v.rlike("(?i)^[0-9a-f]+$")),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(v), known, "")) / size,
        "key_word": flag(before.rlike(KEY_WORDS)),
        "plain_word": flag(before.rlike(PLAIN_WORDS)),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(before.rlike(r"[\"'`]$")),
        "after_key": flag(after.rlike(KEY_WORDS)),
        "after_plain": flag(after.rlike(PLAIN_WORDS)),
        "test_path": flag(F.col("path").rlike(PATH_WORDS)),
    }
    return rows.withColumns(columns)


def labelled_findings(spark: SparkSession, each: int = 250) -> DataFrame:
    """Findings made by rule: value, before, after, path, label, family; ``each`` of every form.

    Families differ in what their values are made of, or (``other``) in what
    surrounds them, so that a forest can be tested on forms it hasn't seen.  They
    are written to the shared folder once.  Secrets: random hex,
    base64 and alphanumeric strings, tokens of several parts and passwords in
    key-like contexts, or assigned in quotes.  Others: the same strings among words
    for hashes, plain numbers, identifiers and paths of words with a number, dates,
    long words, repeated placeholders, and strings in test files.
    """
    i = F.col("id")
    digest = lambda salt: F.sha2(F.concat_ws("-", F.lit(salt), i.cast("string")), 256)
    pick = lambda options, salt: F.element_at(F.array(*[F.lit(x) for x in options]), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(options))).cast("int") + 1)
    # the parts of the forms are columns, so that each has its code once
    parts = {f"word_{salt}": pick(DICTIONARY, salt) for salt in "abcw"} | {
        "hexed": F.substring(digest("h"), F.lit(1), pick([32, 40, 48, 64], "n")),
        "base": F.regexp_replace(F.base64(F.unhex(digest("b"))), "[+/=]", "x"),
        "size": pick([20, 24, 32, 40], "m"),
        "number": F.lpad(F.abs(F.xxhash64(i, F.lit("d"))).cast("string"), 18, "7"),
        "keys": pick(['token = "', "api_key: ", 'secret="', "password = '", "Authorization: Bearer ", "access_key=", 'auth_token: "', "private key "], "k"),
        "other_keys": pick(['client_secret": "', "export AUTH=", "credential ", "--password=", "pwd: ", 'apikey => "'], "o"),
        "plain": pick(["commit ", "sha256: ", "md5 = ", "checksum ", "revision ", "digest: ", "version ", "uuid "], "p"),
        "prose": pick(["the ", "and in ", "of ", "see ", "| ", "und ", "les ", "del "], "q"),
        "ends": pick(['"', "'\n", " and then", ".", "\n", ""], "e"),
        "after_key": pick([" is the token", " as password", " (secret)"], "ak"),
        "after_plain": pick([" is the checksum", " (commit)", " as example"], "ap"),
    }
    hexed, base, number, keys, other_keys, plain, prose, ends, after_key, after_plain = (
        F.col(name) for name in ("hexed", "base", "number", "keys", "other_keys", "plain", "prose", "ends", "after_key", "after_plain")
    )
    word = lambda salt: F.col(f"word_{salt}")
    cut = lambda text, a, n: F.substring(text, a, n)
    nothing, coded = F.lit(" "), F.substring(base, F.lit(1), F.col("size"))
    parted = F.concat_ws(".", cut(base, 1, 18), F.regexp_replace(F.base64(F.unhex(digest("p"))), "[+/=]", "Q"), cut(F.regexp_replace(F.base64(F.unhex(digest("q"))), "[+/=]", "z"), 1, 27))
    passed = F.concat(F.initcap(word("w")), pick(["!", "$", "#", "@", "%", "&"], "s"), cut(number, 1, 4), pick(["x", "Q", "!", "z9"], "t"))
    slug = lambda gap, n: F.concat_ws(gap, word("a"), word("b"), word("c"), cut(number, 1, n))
    long_word = F.concat(word("a"), word("b"), word("c"), word("w"))
    forms = [
        ("hex", hexed, keys, ends, 1), ("other", hexed, other_keys, ends, 1), ("hex", hexed, plain, ends, 0), ("hex", hexed, F.concat(plain, F.lit('"')), ends, 0), ("hex", hexed, F.concat(word("w"), F.lit(' = "')), ends, 1),
        ("code", coded, keys, ends, 1), ("code", F.upper(coded), keys, ends, 1), ("code", coded, F.concat(word("w"), F.lit(': "')), ends, 1), ("code", coded, plain, ends, 0), ("other", coded, other_keys, ends, 1),
        ("prefixed", F.concat(F.lit("AKIA"), F.upper(cut(base, 1, 16))), prose, nothing, 1), ("prefixed", F.concat(F.lit("ghp_"), cut(base, 1, 36)), prose, nothing, 1),
        ("after", coded, prose, after_key, 1), ("after", hexed, prose, after_key, 1), ("after", hexed, prose, after_plain, 0), ("after", coded, prose, after_plain, 0),
        ("parts", parted, keys, ends, 1), ("parts", parted, prose, nothing, 1), ("parts", F.concat_ws(".", word("a"), word("b"), word("c"), slug("-", 3)), prose, nothing, 0),
        ("password", passed, keys, ends, 1), ("other", passed, other_keys, ends, 1), ("password", word("w"), keys, ends, 0), ("other", F.concat(word("a"), F.lit("."), word("b")), other_keys, ends, 0),
        ("number", cut(number, 1, 16), prose, nothing, 0), ("number", number, plain, ends, 0), ("number", cut(number, 1, 16), keys, ends, 0), ("number", cut(number, 1, 6), keys, ends, 0),
        ("words", slug("_", 2), prose, nothing, 0), ("words", slug("-", 4), keys, ends, 0), ("words", F.concat(F.lit("/"), slug("/", 3)), prose, nothing, 0), ("words", long_word, keys, ends, 0),
        ("dummy", F.concat(F.repeat(cut(number, 1, 1), 12), F.lit("-0000")), keys, ends, 0), ("dummy", F.concat(F.lit("2024-01-"), cut(number, 1, 2), F.lit("-12-30-00")), prose, nothing, 0),
        ("dummy", F.concat(F.lit("your_"), word("a"), F.lit("_key_here_"), cut(number, 1, 1)), keys, ends, 0), ("dummy", F.repeat(F.lit("x"), 20), other_keys, ends, 0), ("dummy", F.lit("changeme"), keys, ends, 0),
    ]
    path = pick(["src/app/main", "config/settings", "deploy/env", "notes", "lib/core"], "path")
    forms.append(("tests", coded, keys, ends, 0))
    last = len(forms) - 1
    # one plan for all forms: as a union of a plan each, the driver would compile and keep dozens of classes a pass
    rows = spark.range(each * len(forms)).withColumn("form", F.floor(i / each).cast("int"))
    rows = rows.withColumn("id", F.when(F.col("form") == last, F.pmod(i, F.lit(each)) + 7_000_000 * each).otherwise(i)).withColumns(parts)

    def of_form(k: int) -> Column:
        same: dict[int, list[int]] = {}
        for n, form in enumerate(forms):
            same.setdefault(id(form[k]), []).append(n)
        cases = [(F.col("form").isin(ns), forms[ns[0]][k]) for ns in same.values()]
        return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0]))

    value, before, after = (of_form(k).alias(name) for k, name in ((1, "value"), (2, "before"), (3, "after")))
    fixed = lambda k: F.element_at(F.array(*[F.lit(form[k]) for form in forms]), F.col("form") + 1)
    path = F.when(F.col("form") == last, F.lit("tests/fixtures/example")).otherwise(path)
    made = rows.select(value, before, after, path.alias("path"), fixed(4).alias("label"), fixed(0).alias("family"))
    # written, as a condition would be pushed below the parts and hold the code of all forms again
    return Scratch(spark, "secrets").write(made, "made").where(F.length("value") >= LEAST_LENGTH)


def train(findings: DataFrame, rows: int = TRAIN_ROWS) -> RandomForestClassificationModel:
    """The forest from labelled findings: value, before, after, path, label (0 or 1); at most ``rows``, those of the least hash.

    What is chosen is written with its features, so the forest's passes read a
    small table instead of making the findings again each.
    """
    known = findings.where("value is not null and value <> '' and label in (0, 1)").select("value", "before", "after", "path", F.col("label").cast("double").alias("label"))
    chosen = with_features(known.orderBy(F.xxhash64("value", "before"), "value", "before", "after", "path", "label").limit(rows))
    chosen = Scratch(findings.sparkSession, "secrets").write(chosen.select("label", *FEATURES), "findings")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(chosen).select("label", "features")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=0.8).fit(ready)


def candidates(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, of (the hash of the text), start, end, value, before, after, path of every candidate; positions in code points."""
    where = F.col(path).cast("string") if path else F.lit("")
    spans = found_spans(F.coalesce("text", F.lit("")), "secret", CANDIDATE, lambda v: F.lit(True), near=CONTEXT)
    rows = keep_columns(documents, "doc_id", "text", *([path] if path else [])).select("doc_id", F.xxhash64("text").alias("of"), where.alias("path"), F.explode(spans).alias("s"))
    rows = rows.where(F.col("s.value").rlike("[0-9]") | F.col("s.before").rlike(ASSIGNED))
    return rows.select("doc_id", "of", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), F.col("s.before").alias("before"), F.col("s.after").alias("after"), "path")


def _scored(documents: DataFrame, findings: DataFrame | None, path: str | None) -> DataFrame:
    model = train(labelled_findings(documents.sparkSession) if findings is None else findings)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(documents, path)))
    scored = model.transform(ready).withColumn("score", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    return scored.select("doc_id", "of", "start", "end", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def scan(documents: DataFrame, findings: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Every candidate with its verdict: doc_id, start, end, value, score, is_secret.

    documents: doc_id, text and optionally a column that holds a path.  Null and
    empty texts have no candidates.  Repeated rows give theirs each.  An empty
    table gives no rows.
    """
    return _scored(documents, findings, path).drop("of")


def redacted(documents: DataFrame, findings: DataFrame | None = None, path: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """doc_id and text of every row with the secrets' values replaced.

    Each row loses the secrets of its own text, also where doc_ids repeat or are
    null.  Null and empty texts stay; an empty table gives no rows.
    """
    hits = _scored(documents, findings, path).where("is_secret").groupBy(F.col("doc_id").alias("id"), "of").agg(F.collect_set("value").alias("hits"))
    rows = keep_columns(documents, "doc_id", "text").withColumn("own", F.xxhash64("text"))
    rows = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("of")), "left")
    longest_first = F.array_sort(F.col("hits"), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))
    clean = F.aggregate(longest_first, F.col("text"), lambda t, v: F.replace(t, v, F.lit(mark)))
    return rows.select("doc_id", F.when(F.col("hits").isNull(), F.col("text")).otherwise(clean).alias("text"))
