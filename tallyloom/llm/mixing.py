"""Mixing sources to target weights with hash-random keys and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import boxed, field, number_id
from tallyloom.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1:"
MAX_EPOCHS = 3


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source (source, source_size) the ``target``: weights 1, 2, 3 repeating, by name.

    Names are ordered by code point, NULL last. The weighted shares fill up like water in
    vessels: a source is full at ``max_epochs`` times its size, and what it cannot take rises
    in the others. With the sources ordered by size per weight, the level is the largest of
    (rest of the total) / (weights still open). The windows run over one row per source.
    """
    named = sizes.withColumn(
        "weight", 1 + (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    named = named.withColumn("cap", max_epochs * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    still = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(full), F.lit(0))
    level = named.withColumn("level", rest / F.sum("weight").over(still))
    target = F.least(F.col("cap").cast("double"),
                     F.col("weight") * F.max("level").over(everything))
    return level.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
        max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken, copies, part), one row per input row.

    ``copies`` is how often the whole text enters the mix and ``part`` how many words of it
    are taken once more; ``taken`` = copies * size + part. Every source yields exactly
    floor(target) words, in whole epochs and then in the order of a hash-random key, cut in
    the middle of one document. Rows with equal id and size at the cut share what is left
    evenly, rounded down. NULL or empty text has size 0, a NULL source is a source of its own
    (the last), a NULL id is hashed as empty; an empty table gives no rows. Columns of any
    name travel in ``row``.

    Only (source, key, id, size) is shuffled: sums by source and 4096 key ranges, a prefix sum
    over the ranges, and row by row inside the one range per source that the cut falls into.
    The texts are scanned again and meet one row per source.
    """
    key = F.substring(F.md5(F.concat(
        F.lit(SEED), F.coalesce(number_id(doc_id).cast("string"), F.lit("")))), 1, 16)
    words = F.coalesce(F.regexp_count(field(text).cast("string"), F.lit(WORD)), F.lit(0))
    base = boxed(docs, doc_id=number_id(doc_id), source=field(source).cast("string"),
                 size=words.cast("long"), key=key)
    narrow = materialise(base.drop("row"), "sizes").withColumn("range", F.substring("key", 1, 3))
    ranges = materialise(
        narrow.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    goal = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs)
    budget = F.floor("target").cast("long")
    plan = materialise(goal.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")))
        .otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size"))
        .otherwise(0).cast("long").alias("left")), "goals")

    so_far = Window.partitionBy("source").orderBy("range")
    reach = ranges.withColumn("end", F.sum("words").over(so_far))
    cut_range = reach.join(plan.select(F.col("source").alias("s"), "left"),
                           F.col("source").eqNullSafe(F.col("s"))).where(
        "left > end - words and left <= end").select(
        "s", F.col("range").alias("cut_range"), (F.col("left") - F.col("end") + F.col("words")).alias("room"))
    ties = narrow.join(cut_range, F.col("source").eqNullSafe(F.col("s"))
                       & (F.col("range") == F.col("cut_range"))).groupBy(
        "s", "room", "key", "doc_id", "size").agg(F.count("*").alias("rows"))
    in_range = Window.partitionBy("s").orderBy("key", "doc_id", "size")
    mass = F.col("size") * F.col("rows")
    cut = materialise(
        ties.withColumn("end", F.sum(mass).over(in_range)).where(
            (F.col("room") <= F.col("end")) & (F.col("room") > F.col("end") - mass))
        .select("s", F.struct("key", F.coalesce("doc_id", F.lit(-2**63)).alias("id"), "size").alias("at"),
                F.floor((F.col("room") - F.col("end") + mass) / F.col("rows"))
                .cast("long").alias("share")), "cuts")
    full = plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "epochs", "at", "share")

    here = F.struct("key", F.coalesce("doc_id", F.lit(-2**63)).alias("id"), "size")
    whole = F.when(here < F.col("at"), F.lit(1))
    met = base.join(materialise(full, "cuts"), F.col("source").eqNullSafe(F.col("of")), "left")
    counted = met.withColumn("copies", F.col("epochs") + F.coalesce(whole, F.lit(0))).withColumn(
        "part", F.when(here == F.col("at"), F.col("share")).otherwise(0))
    full_copy = (F.col("part") > 0) & (F.col("part") == F.col("size"))
    counted = counted.withColumn("copies", F.col("copies") + full_copy.cast("long")).withColumn(
        "part", F.when(full_copy, 0).otherwise(F.col("part")).cast("long"))
    return counted.select(
        "row", "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "copies", "part")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each time a document is taken.

    A document cut at its source's budget comes with its first words, joined by one blank,
    and the ``n_chars`` of that text, if the table has such a column.
    """
    made = mix(docs, **options)
    text = options.get("text", "text")
    head = F.array_join(F.slice(F.filter(
        F.split(field_of(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("part").cast("int")), " ")
    turns = F.concat(
        F.array_repeat(F.lit(False), F.col("copies").cast("int")),
        F.array_repeat(F.lit(True), F.when(F.col("part") > 0, 1).otherwise(0)))
    out = made.withColumn("cut", F.explode(turns))
    out = out.withColumn("head", F.when(F.col("cut"), head))
    changed = {text: F.when(F.col("cut"), F.col("head")).otherwise(field_of(text)),
               "n_chars": F.when(F.col("cut"), F.length("head")).otherwise(field_of("n_chars"))}
    types = dict(docs.dtypes)
    return out.select(*[
        (changed[c].cast(types[c]) if c in changed else field_of(c)).alias(c) for c in docs.columns])


def field_of(name: str):
    return F.col(f"row.`{name}`")
