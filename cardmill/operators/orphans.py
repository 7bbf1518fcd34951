"""References to records that do not exist.

Parent keys become integers, and sorted integers become contiguous runs
``[run_start, run_end]``. A reference is matched as of its key to the run that
starts at or before it; a key beyond that run's end has no parent. Runs carry
whether any parent in them is deleted and when the last one was first loaded,
so most references are settled by the run alone; only those in a run that says
"perhaps" are looked up exactly.

Physical plan: keys are cut into blocks of 2^16 neighbouring integers, and the
blocks are hashed over the tasks. Runs end at block borders, which changes no
answer. No reference list is sorted as a whole, and a reference used by a third
of all rows is one row before the match because references are grouped first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.sources.tables import materialize, tidy_id

BLOCK_BITS = 16
#: Copies of each faulty key on the way back to its references; spreads hot keys.
SALTS = 8


@dataclass(frozen=True)
class Reference:
    """One referring field: where it stands and which parent table it names."""

    table: str
    rows: DataFrame
    record_id: str
    field: str
    parent: str
    is_array: bool = False


def integer_key(ref: Column) -> tuple[Column, Column]:
    """(space, key): ids such as ``unit-0123456789ab`` map one to one to integers
    within the space of their prefix; any other text gets a 64-bit hash in the
    space ``#`` and is compared as text after the match."""
    regular = ref.rlike("^[a-z]+-[0-9a-f]{12}$")
    space = F.when(regular, F.substring_index(ref, "-", 1)).otherwise(F.lit("#"))
    number = F.conv(F.substring_index(ref, "-", -1), 16, 10).cast("long")
    return space, F.when(regular, number).otherwise(F.xxhash64(ref))


def parent_states(rows: DataFrame, parent: str) -> DataFrame:
    """One row per parent id: first load, and whether the current row is deleted.
    Of rows with equal load times a deleted one counts as the later."""
    now = F.struct(F.col("loaded_at"), F.col("deleted_at").isNotNull().alias("gone"))
    states = (
        rows.select(tidy_id(F.col("id")).alias("ref_id"), "loaded_at", "deleted_at")
        .where("ref_id is not null")
        .groupBy("ref_id")
        .agg(F.min("loaded_at").alias("first_loaded"), F.max(now)["gone"].alias("gone"))
    )
    space, key = integer_key(F.col("ref_id"))
    return states.select(F.lit(parent).alias("parent"), space.alias("space"), key.alias("key"), "ref_id", "first_loaded", "gone")


def key_runs(parents: DataFrame) -> DataFrame:
    """Sorted integer keys compressed into contiguous runs, one row per run."""
    block = F.shiftright("key", BLOCK_BITS).alias("block")
    keys = parents.select("parent", "space", block, "key", "first_loaded", "gone")
    order = Window.partitionBy("parent", "space", "block").orderBy("key")
    return (
        keys.withColumn("island", F.col("key") - F.dense_rank().over(order))
        .groupBy("parent", "space", "block", "island")
        .agg(
            F.min("key").alias("run_start"),
            F.max("key").alias("run_end"),
            F.max("first_loaded").alias("last_first"),
            F.bool_or("gone").alias("any_gone"),
        )
    )


def _record_references(ref: Reference) -> DataFrame:
    values = F.explode_outer(F.col(ref.field)) if ref.is_array else F.col(ref.field)
    return ref.rows.select(
        F.lit(ref.table).alias("table_name"),
        F.lit(ref.field).alias("field"),
        F.lit(ref.parent).alias("parent"),
        F.col(ref.record_id).alias("record_id"),
        values.alias("ref_id"),
        F.col("loaded_at"),
    ).withColumn("ref_id", tidy_id(F.col("ref_id")))


def references(refs: list[Reference]) -> DataFrame:
    """Distinct (table, field, record, reference) with the record's earliest load.

    Repeated rows are combined before the first shuffle. Rows without a record id
    cannot be told apart; per reference they count as one record.
    """
    union = None
    for ref in refs:
        rows = _record_references(ref)
        union = rows if union is None else union.unionByName(rows)
    grouped = union.groupBy("table_name", "field", "parent", "record_id", "ref_id").agg(F.min("loaded_at").alias("loaded"))
    alone = F.when(F.col("record_id").isNull(), F.col("ref_id"))
    record = Window.partitionBy("table_name", "record_id", alone)
    return grouped.withColumn("record_loaded", F.min("loaded").over(record)).where("ref_id is not null").drop("loaded")


def find_orphans(parents: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """References whose parent is missing, deleted or later than the record.

    Input: per parent name rows of (id, loaded_at, deleted_at), and the referring
    fields. Output, one row per distinct reference: table_name, field, record_id,
    ref_id, status (the first of ``missing``, ``deleted``, ``late`` that holds),
    period (month of the record's earliest load; null if that is unknown).
    Blank and null references are none. A null load time is never late. Empty
    tables give no rows (parents) or make every reference missing (references
    into an empty parent). Other columns of the inputs are ignored.
    """
    states = None
    for name, rows in parents.items():
        one = parent_states(rows, name)
        states = one if states is None else states.unionByName(one)

    states, links = materialize(states, "states"), materialize(references(refs), "links")  # each is read twice
    space, key = integer_key(F.col("ref_id"))
    wanted = (
        links.groupBy("parent", "ref_id")
        .agg(F.min("record_loaded").alias("earliest"))
        .select("parent", space.alias("space"), key.alias("key"), "ref_id", "earliest")
        .withColumn("block", F.shiftright("key", BLOCK_BITS))
    )

    run = F.struct("run_start", "run_end", "last_first", "any_gone")
    line = (
        key_runs(states)
        .select("parent", "space", "block", F.col("run_start").alias("at"), F.lit(0).alias("side"), run.alias("run"), F.lit(None).cast("string").alias("ref_id"), F.lit(None).cast("timestamp_ntz" if dict(links.dtypes)["record_loaded"] == "timestamp_ntz" else "timestamp").alias("earliest"))
        .unionByName(wanted.select("parent", "space", "block", F.col("key").alias("at"), F.lit(1).alias("side"), F.lit(None).alias("run"), "ref_id", "earliest"))
    )
    as_of = Window.partitionBy("parent", "space", "block").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    matched = line.withColumn("run", F.last("run", ignorenulls=True).over(as_of)).where("side = 1")

    beyond = F.col("run").isNull() | (F.col("at") > F.col("run.run_end"))
    perhaps = (F.col("space") == "#") | F.col("run.any_gone") | (F.col("run.last_first") > F.col("earliest"))
    missing = matched.where(beyond).select("parent", "ref_id", F.lit("missing").alias("fault"), F.lit(None).cast(dict(links.dtypes)["record_loaded"]).alias("first_loaded"))
    looked_up = (
        matched.where(~beyond & F.coalesce(perhaps, F.lit(False)))
        .select("parent", "ref_id", "earliest")
        .join(states.select("parent", "ref_id", "gone", "first_loaded"), ["parent", "ref_id"], "left")
        .withColumn("fault", F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("first_loaded") > F.col("earliest"), "late"))
        .where("fault is not null")
        .select("parent", "ref_id", "fault", "first_loaded")
    )
    faulty = missing.unionByName(looked_up).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = links.withColumn("salt", F.pmod(F.hash("record_id", "table_name"), F.lit(SALTS)))
    late_here = F.col("first_loaded") > F.col("record_loaded")
    return (
        salted.join(faulty, ["parent", "ref_id", "salt"])
        .where((F.col("fault") != "late") | late_here)
        .select("table_name", "field", "record_id", "ref_id", F.col("fault").alias("status"), F.date_format("record_loaded", "yyyy-MM").alias("period"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, status and month."""
    return orphans.groupBy("table_name", "field", "status", "period").agg(
        F.count("*").alias("n_references"), F.count_distinct("ref_id").alias("n_keys")
    )
