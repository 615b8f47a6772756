"""Keyed changes in bulk: set, replace, patch, delete, increment, upsert.

A feed may hold any number of changes per id, in any row order; ``seq`` says which came
later. Changes are folded to one row per id with partial aggregates before anything is
joined, so an id that a third of the feed talks about is no heavier than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import reasons
from tallyloom.operators.validate import REASON, Field, Rule, clean, cleaned, flag_known
from tallyloom.session import materialise


Frame = Callable[[], DataFrame]


@dataclass(frozen=True)
class Changes:
    """Results of a change job, each built when it is asked for.

    ``table``: the whole new table. ``changed``: its changed rows (or the deleted ones).
    ``rejected``: ``seq``, ``id`` and reason of the changes that were not applied.
    """

    make_table: Frame
    make_changed: Frame
    make_rejected: Frame

    @property
    def table(self) -> DataFrame:
        return self.make_table()

    @property
    def changed(self) -> DataFrame:
        return self.make_changed()

    @property
    def rejected(self) -> DataFrame:
        return self.make_rejected()


def judge_targets(checked: DataFrame, base: DataFrame, not_found: str) -> DataFrame:
    """Complete ``reject_reason``: a change of an unknown id is not found."""
    flagged = flag_known(checked, "id", base, "__known")
    reason = F.coalesce(F.col(REASON), F.when(~F.col("__known"), F.lit(not_found)))
    return flagged.withColumn(REASON, reason).drop("__known")


def _rejects(checked: DataFrame, base: DataFrame, not_found: str) -> DataFrame:
    judged = judge_targets(checked.select("seq", "id", REASON), base, not_found)
    return judged.filter(F.col(REASON).isNotNull())


# Invalid changes are left out inside the folding aggregates, not by a filter below them:
# a filter on the reason would be pushed down to the scan, rules and parsing spelled out
# again, and every field would be read twice.
def _valid() -> Column:
    return F.col(REASON).isNull()


def _rewrite(
    base: DataFrame,
    folded: DataFrame,
    new: dict[str, Column],
    hit: str,
    rejected: Frame | None = None,
) -> Changes:
    """Join folded changes to the base and swap in the ``new`` columns where ``hit`` is set.

    The folded changes are written to the shared folder first. Their size is then known
    when the join is planned: a small batch is broadcast and the base table, which may be
    huge, is not shuffled; a large batch is an ordinary shuffle join.
    """
    touched = F.col(hit).isNotNull()
    written = cache(lambda: materialise(folded.filter(touched), "changes"))
    swapped = [
        F.when(touched, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in base.columns
    ]
    replaced = [new[c].alias(c) if c in new else F.col(c) for c in base.columns]
    return Changes(
        lambda: base.join(written(), "id", "left").select(*swapped),
        lambda: base.join(written(), "id").select(*replaced),
        rejected,
    )


def replace_fields(
    base: DataFrame,
    feed: DataFrame,
    fields: Sequence[Field],
    *,
    not_found: str,
    stamp: dict[str, Column] | None = None,
) -> Changes:
    """The last valid change of an id sets all ``fields`` (one field: a status change)."""
    names = [each.name for each in fields]
    checked = clean(feed, fields, keep=("seq", "id"))
    if len(fields) == 1 and fields[0].members:
        done = apply_latest(base, checked, names, stamp, fields[0].members)
        return replace(done, make_rejected=lambda: _rejects(checked, base, not_found))
    # Judged once: the fold reads the changes twice, the rejections a third time.
    judged = cache(lambda: materialise(checked, "judged"))
    folded = cache(lambda: fold_latest(judged(), names))
    new = _latest_values(base, names, stamp)
    done = Changes(
        lambda: _rewrite(base, folded(), new, "__new").table,
        lambda: _rewrite(base, folded(), new, "__new").changed,
        lambda: _rejects(judged(), base, not_found),
    )
    return done


# A change's place as one number, which a hash aggregate holds in place: ``seq``, and below it
# what settles ties, so that the result does not depend on the order of the rows.
def _rank(seq: Column, tie: Column, span: int) -> Column:
    return seq.cast("decimal(20,0)") * F.lit(span).cast("decimal(18,0)") + tie.cast("decimal(18,0)")


def fold_latest(judged: DataFrame, names: Sequence[str]) -> DataFrame:
    """(id, __new): the values of the latest valid change of each id.

    The latest change is found as the largest number per id; its values are then taken from the
    rows themselves by id and number, so no task sorts its feed and a busy id is spread over all
    tasks. Of different changes with the same ``seq`` the one with the larger hash counts.
    """
    tie = F.xxhash64(*names).bitwiseAND(2**48 - 1)
    ranked = judged.withColumn("__rank", F.when(_valid(), _rank(F.col("seq"), tie, 2**48)))
    last = materialise(
        ranked.groupBy("id").agg(F.max("__rank").alias("__rank"))
        .filter(F.col("id").isNotNull() & F.col("__rank").isNotNull()), "latest")
    return ranked.join(last, ["id", "__rank"]).select("id", *names).distinct().select(
        "id", F.struct(*names).alias("__new"))


def fold_members(judged: DataFrame, name: str, members: Sequence) -> DataFrame:
    """The same for one field with a fixed vocabulary: the number holds the value too, so one
    aggregate is all there is. Of changes with the same ``seq`` the later member counts."""
    known = F.array(*[F.lit(member) for member in members])
    place = F.coalesce(F.array_position(known, F.col(name)), F.lit(0))
    span = len(members) + 1
    folded = judged.groupBy("id").agg(
        F.max(F.when(_valid(), _rank(F.col("seq"), place, span))).alias("__rank"))
    number = F.pmod("__rank", F.lit(span).cast("decimal(18,0)")).cast("int")
    value = F.get(known, number - 1)
    return folded.select("id", F.when(F.col("__rank").isNotNull(), F.struct(value.alias(name))).alias("__new"))


def _latest_values(
    base: DataFrame, names: Sequence[str], stamp: dict[str, Column] | None
) -> dict[str, Column]:
    return {
        **{c: F.col(f"__new.{c}").cast(base.schema[c].dataType) for c in names},
        **(stamp or {}),
    }


def apply_latest(
    base: DataFrame,
    judged: DataFrame,
    names: Sequence[str],
    stamp: dict[str, Column] | None = None,
    members: Sequence = (),
) -> Changes:
    """Set ``names`` to the values of the latest valid change of each id; ``members`` are all
    values of a single field, if they are known."""
    folded = fold_members(judged, names[0], members) if members else fold_latest(judged, names)
    return _rewrite(base, folded, _latest_values(base, names, stamp), "__new")


def given(field: str) -> Column:
    """Did the patch body carry ``field``?"""
    return F.array_contains(F.split("present", ","), field)


def _checked_patches(feed: DataFrame, fields: Sequence[Field], empty: str) -> DataFrame:
    """Clean a patch feed: rules only count for fields the body carried."""
    nothing = ~F.arrays_overlap(
        F.split("present", ","), F.array(*[F.lit(each.name) for each in fields])
    )
    guarded = [
        replace(
            each,
            rules=tuple(Rule(cleaned(f"__has_{each.name}") & r.bad, r.reason) for r in each.rules),
            late=tuple(Rule(cleaned(f"__has_{each.name}") & r.bad, r.reason) for r in each.late),
        )
        for each in fields
    ]
    flags = [Field(f"__has_{each.name}", given(each.name)) for each in fields]
    none = Field("__empty", nothing, (Rule(cleaned("__empty"), empty),))
    return clean(feed, [none, *guarded, *flags], keep=("seq", "id"))


def _fold_patches(judged: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per id and field the last given value, wrapped so that a given NULL still counts."""
    return judged.groupBy("id").agg(
        *[
            F.max_by(
                F.struct(F.col(c).alias("value")),
                F.when(_valid() & F.col(f"__has_{c}"), F.col("seq")),
            ).alias(f"__new_{c}")
            for c in names
        ],
        F.max(F.when(_valid(), F.lit(True))).alias("__hit"),
    )


def _patched(base: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    return {
        c: F.when(
            F.col(f"__new_{c}").isNotNull(),
            F.col(f"__new_{c}.value").cast(base.schema[c].dataType),
        ).otherwise(F.col(c))
        for c in names
    }


def patch_fields(
    base: DataFrame, feed: DataFrame, fields: Sequence[Field], *, not_found: str, empty: str
) -> Changes:
    """Set only the fields a body carried; an absent field keeps its value."""
    checked = _checked_patches(feed, fields, empty)
    names = [each.name for each in fields]
    return _rewrite(
        base, _fold_patches(checked, names), _patched(base, names), "__hit",
        lambda: _rejects(checked, base, not_found),
    )


def delete_rows(base: DataFrame, feed: DataFrame, *, not_found: str) -> Changes:
    """Delete by id; a second deletion of the same id finds nothing.

    All requests are rejected but the first of each stored id. They are told apart by
    (id, seq), so the requests of one busy id are spread over all tasks.
    """
    first = feed.groupBy("id").agg(F.min("seq").alias("seq"))
    written = cache(lambda: materialise(first, "deletions"))

    def refused() -> DataFrame:
        served = written().join(base.select("id"), "id", "left_semi")
        late = feed.select("seq", "id").join(served, ["id", "seq"], "left_anti")
        return late.select("seq", "id", F.lit(not_found).alias(REASON))

    return Changes(
        lambda: base.join(written(), "id", "left_anti"),
        lambda: base.join(written(), "id", "left_semi"),
        refused,
    )


def patch_and_delete(
    base: DataFrame, feed: DataFrame, fields: Sequence[Field], *, not_found: str, empty: str
) -> Changes:
    """One feed of ``op`` update and delete: whatever follows the first deletion of an id
    finds nothing; any other ``op`` is rejected. ``changed`` holds the rows that were updated and still exist."""
    deletes = feed.filter(F.col("op") == "delete")
    # Written first: the feed then joins a plain table of known size, and a busy id is split.
    gone = materialise(deletes.groupBy("id").agg(F.min("seq").alias("__gone")), "gone")
    late = F.coalesce(F.col("seq") > F.col("__gone"), F.lit(False))
    updates = feed.filter(F.col("op") == "update").join(gone, "id", "left")
    on_time = _checked_patches(updates.filter(~late), fields, empty)
    too_late = _checked_patches(updates.filter(late), fields, empty).withColumn(
        REASON, F.coalesce(F.col(REASON), F.lit(not_found))
    )
    unknown = feed.filter(~F.coalesce(F.col("op").isin("update", "delete"), F.lit(False)))
    names = [each.name for each in fields]
    done = _rewrite(base, _fold_patches(on_time, names), _patched(base, names), "__hit")
    columns = ("seq", "id", REASON)

    def refused() -> DataFrame:
        return (
            _rejects(on_time, base, not_found).select(*columns)
            .unionByName(too_late.select(*columns))
            .unionByName(delete_rows(base, deletes, not_found=not_found).rejected)
            .unionByName(unknown.select("seq", "id", F.lit(reasons.OPERATION).alias(REASON)))
        )

    return Changes(
        lambda: done.table.join(gone, "id", "left_anti"),
        lambda: done.changed.join(gone, "id", "left_anti"),
        refused,
    )


def add_to(
    base: DataFrame,
    feed: DataFrame,
    column: str,
    target: Field,
    amount: Field,
    *,
    not_found: str,
) -> Changes:
    """Add each valid ``amount`` to ``column`` of the target id; order does not matter."""
    checked = clean(feed, [target, amount], keep=("request_id",)).select(
        F.col("request_id").alias("seq"), F.col(target.name).alias("id"), amount.name, REASON
    )
    done = apply_sums(base, checked, column, amount.name)
    return replace(done, make_rejected=lambda: _rejects(checked, base, not_found))


def apply_sums(base: DataFrame, judged: DataFrame, column: str, amount: str) -> Changes:
    """Add up the valid amounts of each id and add the sum to ``column``."""
    folded = judged.groupBy("id").agg(F.sum(F.when(_valid(), F.col(amount))).alias("__add"))
    new = {column: (F.col(column) + F.col("__add")).cast(base.schema[column].dataType)}
    return _rewrite(base, folded, new, "__add")


def stamp_keys(
    base: DataFrame, feed: DataFrame, new: dict[str, Column], *, not_found: str
) -> Changes:
    """Apply fixed assignments to every id in the feed."""
    keys = feed.groupBy("id").agg(F.lit(True).alias("__hit"))
    checked = feed.select("seq", "id", F.lit(None).cast("string").alias(REASON))
    return _rewrite(base, keys, new, "__hit", lambda: _rejects(checked, base, not_found))


def upsert_rows(base: DataFrame, feed: DataFrame) -> DataFrame:
    """Insert or overwrite by id; the last row of an id wins, other columns keep their value.
    Rows without an id are left out.

    Two joins instead of one full outer join, which could never be a broadcast: a small
    feed then leaves the base table where it is.
    """
    names = [c for c in feed.columns if c not in ("seq", "id")]
    kinds = {each.name: each.dataType for each in base.schema}
    judged = feed.withColumn(REASON, F.lit(None).cast("string"))
    folded = materialise(fold_latest(judged, names), "upserts")
    # The same type but for NULLs inside an array needs no cast, and has none.
    same = {each.name for each in feed.schema
            if each.name in kinds and each.dataType.simpleString() == kinds[each.name].simpleString()}
    new = {c: F.col(f"__new.{c}") if c in same else F.col(f"__new.{c}").cast(kinds[c]) for c in names}
    updated = base.join(folded, "id", "left").select(*[
        F.when(F.col("__new").isNotNull(), new[c]).otherwise(F.col(c)).alias(c)
        if c in new else F.col(c)
        for c in base.columns
    ])
    stored = base.select("id").join(folded.select("id"), "id", "left_semi")
    inserted = folded.join(stored, "id", "left_anti").select(*[
        new[c].alias(c) if c in new
        else F.col("id") if c == "id" else F.lit(None).cast(kinds[c]).alias(c)
        for c in base.columns
    ])
    return updated.unionByName(inserted)
