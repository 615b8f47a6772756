"""Secret scans: candidates, measurable features, and a random forest that drops false finds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import boxed, field, number_id
from tallyloom.session import materialise

MIN_LENGTH = 12
MIN_WORD_DOCS = 5
SPLIT = r"[\x20\x09-\x0D]+"
EDGES = r"""^["'`(<\[{]+|["'`>)\]},.;:!?]+$"""
NAMED = r"""^([A-Za-z_][A-Za-z0-9_-]*)["'`]?[=:](.+)$"""
NAME_BEFORE = r"""^([A-Za-z_][A-Za-z0-9_-]*)["'`]?(?::=|=+|:)$"""
SWITCHES = 4         # case switches that make a long word without a digit a candidate

# Bounds of the forest and of what it is fitted on.
SAMPLE_EACH = 4000
TREES, DEPTH, SEED = 24, 6, 11
HASHED = 64
THRESHOLD = 0.5

# Fixed values of the labelling rule: shapes that are surely a credential, surely not one.
SURE_SECRET = r"^AKIA[0-9A-Z]{16}$"
SECRET_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key")
# a secret name, whatever stands around it in the same name, and its sign
SECRET_NAMED = rf"""(?i)(?:{"|".join(SECRET_NAMES)})[A-Za-z0-9_.-]*["'`\])]* ?(?::=|=+|:)"""
SURE_OTHER = (r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$|^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^[0-9()+. -]+$"
              r"|^(https?|ftp)://")
NUMBERS = ["length", "digits", "uppers", "lowers", "others", "switches", "case_switches",
           "vowel_pairs", "repeats", "distinct_share", "coverage", "named", "quoted", "path_parts"]
NAMES = ["name", "before", "after", "path_top", "path_folder", "path_suffix"]


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
               path: str = "source") -> DataFrame:
    """(doc_id, word_no, path, value, name, before, after, named, quoted) of every candidate.

    A candidate is a blank-separated word of MIN_LENGTH characters or more with a digit or
    SWITCHES case switches, or a word of any length that holds or follows the value of a
    secret name (``name=value``, ``name: value``, ``name = value``).
    ``value`` is the word without its quotes and brackets, and without ``name=`` before it;
    ``name`` is that name, or the word before a lone ``=`` or ``:``, else the word before.
    """
    return _found(_plain(docs, text, doc_id, path), _is_candidate)


def _is_candidate(x: Column) -> Column:
    word, one = x["word"], x["one"]
    shaped = (F.length(word) >= MIN_LENGTH) & (word.rlike("[0-9]") | (F.regexp_count(
        word, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) >= SWITCHES))
    # the cheap tests come first; an entry beyond the last word has a NULL word
    own = (word.contains("=") | word.contains(":")) & word.rlike(SECRET_NAMED + r"""["'`]*[^"'`=:]""")
    after = (one.endswith("=") | one.endswith(":")) & F.concat_ws(" ", x["two"], one).rlike(
        SECRET_NAMED + "$")
    return (word != "") & (shaped | own | after)


def _plain(docs: DataFrame, text: str, doc_id: str, path: str) -> DataFrame:
    return boxed(docs, doc_id=number_id(doc_id), path=field(path).cast("string"),
                 text=F.coalesce(field(text).cast("string"), F.lit(""))).drop("row")


def _found(plain: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """Candidates at the words that ``wanted`` takes, from (doc_id, path, text)."""
    words = F.split("text", SPLIT)
    none = F.array(F.lit(""))
    # every word beside its neighbours; no lambda looks back into the array
    near = F.arrays_zip(
        words.alias("word"), F.concat(none, words).alias("one"),
        F.concat(none, none, words).alias("two"), F.slice(words, 2, 2**30).alias("after"),
        F.sequence(F.lit(0), F.size(words) - 1).alias("word_no"))
    found = plain.select("doc_id", "path", F.explode(F.filter(near, wanted)).alias("hit")).select(
        "doc_id", "path", *[F.coalesce(f"hit.{n}", F.lit("")).alias(n) for n in ("word", "one", "two", "after")],
        "hit.word_no")
    bare = F.regexp_replace("word", EDGES, "")
    parted = F.regexp_extract(bare, NAMED, 1)
    lone = F.col("one").isin("=", ":", ":=", "==")
    signed = F.regexp_extract(F.regexp_replace("one", r"""^["'`(<\[{]+""", ""), NAME_BEFORE, 1)
    two = F.regexp_replace("two", EDGES, "")
    return found.select(
        "doc_id", "word_no", "path",
        F.regexp_replace(F.when(parted != "", F.regexp_extract(bare, NAMED, 2)).otherwise(bare),
                         EDGES, "").alias("value"),
        F.lower(F.when(parted != "", parted).when(lone, two).when(signed != "", signed)
                .otherwise(F.col("one"))).alias("name"),
        F.lower("one").alias("before"), F.lower("after").alias("after"),
        ((parted != "") | lone | (signed != "")).cast("int").alias("named"),
        F.col("word").rlike(r"""["'`]""").cast("int").alias("quoted"))


def _reviewed(plain: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates at the reviewed words (id, at) that ``found`` lacks; only their texts move."""
    met = (F.col("doc_id") == F.col("id")) & (F.col("word_no") == F.col("at"))
    missing = materialise(known.join(found, met, "left_anti").groupBy("id").agg(
        F.collect_set("at").alias("places")), "missing")
    return _found(plain.join(missing, plain.doc_id == missing.id),
                  lambda x: F.array_contains("places", x["word_no"]))


def dictionary(docs: DataFrame, text: str = "text", min_docs: int = MIN_WORD_DOCS) -> DataFrame:
    """(word): runs of three or more letters that stand in at least ``min_docs`` rows."""
    words = F.array_distinct(F.regexp_extract_all(
        F.lower(F.coalesce(field(text).cast("string"), F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(
        F.count("*").alias("rows")).where(F.col("rows") >= min_docs).select("word")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the forest's numbers; ``coverage`` is the share of dictionary letters."""
    value, path = F.col("value"), F.lower(F.coalesce("path", F.lit("")))
    pieces = F.explode(F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), F.lit(0)))
    covered = materialise(
        found.select("value").distinct().select("value", pieces.alias("word")).join(words, "word")
        .groupBy("value").agg(F.sum(F.length("word")).alias("covered")), "covered")

    def count(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)).cast("double")

    length = F.greatest(F.length(value), F.lit(1)).cast("double")
    return found.join(covered, "value", "left").withColumns({
        "length": F.length(value).cast("double"),
        "digits": count("[0-9]") / length, "uppers": count("[A-Z]") / length,
        "lowers": count("[a-z]") / length, "others": count("[^A-Za-z0-9]") / length,
        "switches": count("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]") / length,
        "case_switches": count("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]") / length,
        "vowel_pairs": count("(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]") / length,
        "repeats": count(r"(.)(?=\1)") / length,
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))).cast("double") / length,
        "coverage": F.coalesce("covered", F.lit(0)).cast("double") / length,
        "path_parts": F.size(F.split(path, "/")).cast("double"),
        "path_top": F.regexp_extract(path, "^/?([^/]*)", 1),
        "path_folder": F.regexp_extract(path, "([^/]*)/[^/]*$", 1),
        "path_suffix": F.regexp_extract(path, r"\.([^./]*)$", 1),
    }).drop("covered")


def rule_labels(found: DataFrame) -> DataFrame:
    """Findings that a reviewer's rule decides: ``label`` 1 or 0 for sure shapes only.

    Stands in for reviewed findings where a corpus has none of its own.
    """
    sure = F.col("value").rlike(SURE_SECRET) | (
        F.col("name").isin(*SECRET_NAMES) & (F.col("named") == 1) & (
            F.col("value").rlike("[0-9]") | (F.col("coverage") < 1)) & (F.col("value") != ""))
    other = F.col("value").rlike(SURE_OTHER) & ~sure
    return found.withColumn("label", F.when(sure, 1).when(other, 0)).where("label is not null")


def train_forest(labelled: DataFrame) -> PipelineModel | None:
    """A forest from at most SAMPLE_EACH findings of each label, chosen by a hash.

    ``labelled`` has the features and ``label``. Returns None unless both labels occur.
    """
    order = F.xxhash64("doc_id", "word_no", "value")
    picked = [labelled.where(F.col("label") == v).orderBy(order, "value", "doc_id", "word_no").limit(SAMPLE_EACH)
              for v in (0, 1)]
    sample = materialise(picked[0].unionAll(picked[1]).withColumn(
        "label", F.col("label").cast("double")), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    return Pipeline(stages=[
        FeatureHasher(inputCols=NAMES, outputCol="around", numFeatures=HASHED),
        VectorAssembler(inputCols=[*NUMBERS, "around"], outputCol="features"),
        RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED),
    ]).fit(sample)


def scan_secrets(docs: DataFrame, labels: DataFrame | None = None, text: str = "text",
                 doc_id: str = "doc_id", path: str = "source",
                 threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, word_no, secret_sha256, length, named, score, is_secret), one row per candidate.

    ``labels`` are reviewed findings (doc_id, word_no, label 0 or 1); without them the rule's
    sure findings teach the forest. ``word_no`` counts blank-separated words from 0 (a text
    that begins with a blank has an empty word 0); a reviewed word is a candidate whatever its
    shape. The value itself is returned as a digest
    only. NULL and empty texts have no candidates, a NULL path has one part, repeated rows
    are found again each, an empty table gives no rows; if only one label occurs every
    candidate gets that label's score, and without labels 0. Other columns are not read.

    Everything is built-in expressions and Spark's own forest; candidates are a small share
    of the words, so the texts never move. The dictionary counts the words of all rows.
    """
    found = materialise(candidates(docs, text, doc_id, path), "candidates")
    known = None
    if labels is not None:
        known = materialise(boxed(labels, id=number_id("doc_id"), at=field("word_no").cast("int"),
                                  label=field("label").cast("int")).drop("row").where(
            F.col("label").isin(0, 1)).groupBy("id", "at").agg(F.max("label").alias("label")), "known")
        found = materialise(found.unionAll(
            _reviewed(_plain(docs, text, doc_id, path), known, found)), "candidates")
    ready = materialise(with_features(found, materialise(dictionary(docs, text), "words")), "features")
    if known is None:
        labelled = rule_labels(ready)
    else:
        labelled = ready.join(known, (F.col("doc_id") == F.col("id"))
                              & (F.col("word_no") == F.col("at"))).drop("id", "at")
    model = train_forest(labelled)
    if model is None:
        only = labelled.agg(F.max("label")).first()[0] or 0
        scored = ready.withColumn("score", F.lit(float(only)))
    else:
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        "doc_id", "word_no", F.sha2("value", 256).alias("secret_sha256"),
        F.col("length").cast("long").alias("length"), "named", "score",
        (F.col("score") >= threshold).alias("is_secret"))
