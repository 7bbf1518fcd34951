"""Groups of records whose word sets are nearly equal.

One hash function turns a record into a sorted set of word hashes. Its sketch
keeps the first values in an order in which rare words come first (and equal
ones by hash); common words, which say nothing, never enter an inverted list alone.
Lists are kept by single retained values where these are rare, else by pairs,
triples or quadruples of them, so that a list's expected length stays below
``LIST_LENGTH`` at any size of the collection. Members of one list are compared
by 128-bit union sketches, whose differing bits can't exceed the differing words;
what passes is verified by exact Jaccard similarity of the sets.

Completeness: every pair over the threshold shares a list. Two sets of given sizes
differ in at most D words. The words are dealt into parts, the more the larger the
smaller set is; if part i may hold t[i] differences and the sum of t[i] + 1 is D + 1,
some part holds no more than its t[i]. The lists of a part are kept for all ways to
skip so many of its values, so the two sets meet in a list of that part.

Entries of lists travel in columns, by bucket of the key, and the lists of a bucket
are compared in one task. A list that turns out longer than ``LONG`` is told apart by
the words of its other parts first, and what is still longer is compared block by
block in many tasks, so no list meets in one.

Records with equal sets are one class and are compared once, through any number
of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.sources.tables import materialize, table

#: Expected records of a list; its key is lengthened until there are no more.
LIST_LENGTH = 2_000
LONGEST_KEY = 4
#: A list of more records by count is split further before it is compared.
LONG = 16_384
#: Pairs whose smaller set has fewer words have one part; up to ``PARTED`` four, and
#: the parts double as that size doubles.
FIRST_PARTED, PARTED = 8, 60
#: A word in fewer than one of so many records counts as having just that
#: frequency. The table of the others has at most this number times the mean
#: set size of rows, whatever the size of the collection.
RARE = 20_000
#: Classes a task remembers to leave out copies early; copies it forgets are removed later.
SEEN = 2_000_000
#: Entries a task holds before it hands them on, and bytes of entries in a bucket.
HELD, BUCKET = 1_000_000, 24 << 20
ENTRY_BYTES, ENTRIES = 36, 20


def word_hashes(*texts: Column) -> Column:
    """Sorted distinct hashes of the runs of letters and digits in the lower-cased texts."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def record_sets(records: DataFrame, key: str, *texts: str) -> DataFrame:
    """id, words, class_id (hash of the set), n; one row per distinct id and set.
    Null texts count as empty; records without words and null ids are in no pair and
    are left out."""
    rows = records.select(F.col(key).alias("id"), word_hashes(*(F.col(t) for t in texts)).alias("words")).where("id is not null and size(words) > 0")
    return rows.select("id", F.xxhash64("words").alias("class_id"), F.size("words").alias("n"), "words")


def sketches(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union sketch of each set, 128 bits in two halves: a bit per word. The sketch
    of a union is the union of the sketches, and sketches differ in no more bits than
    the sets in words."""
    starts = np.cumsum(sizes) - sizes
    return tuple(np.bitwise_or.reduceat(np.where((flat >> 6) & 1 == half, np.int64(1) << (flat & 63), 0), starts) if len(sizes) else np.zeros(0, np.int64) for half in (0, 1))


def size_classes(largest: int) -> list[tuple[int, int, int]]:
    """(least, most, parts) for the size of the smaller set of a pair."""
    out = [(1, FIRST_PARTED - 1, 1), (FIRST_PARTED, PARTED - 1, 4)]
    while out[-1][1] < largest:
        least, parts = out[-1][1] + 1, out[-1][2] * 2
        out.append((least, 2 * least - 1, parts))
    return [c for c in out if c[0] <= largest]


def skips(sizes: np.ndarray, least: int, most: int, parts: int, threshold: float) -> np.ndarray:
    """[part, i]: how many values of a part a set of ``sizes[i]`` words may have to skip
    to meet a partner over the threshold, if the smaller of both sets has ``least`` to
    ``most`` words; -1 if it has no such partner. For large sets an upper bound."""
    out = np.full((parts, len(sizes)), -1)
    part = np.arange(parts)[:, None]
    for i, n in enumerate(sizes.tolist()):
        if n < least:
            continue
        other = np.arange(max(1, least, math.ceil(threshold * n - 1e-9)), math.floor(n / threshold + 1e-9) + 1)
        smaller = np.minimum(other, n)
        other = other[(smaller >= least) & (smaller <= most)]
        shared = np.ceil(threshold / (1 + threshold) * (n + other) - 1e-9).astype(int)
        possible = shared <= np.minimum(other, n)
        other, shared = other[possible], shared[possible]
        if not len(other):
            continue
        differing = n + other - 2 * shared + 1
        if len(other) * parts <= 100_000:
            out[:, i] = np.minimum((differing + part) // parts - 1, n - shared).max(axis=1)
        else:
            out[:, i] = np.minimum((differing.max() + part[:, 0]) // parts - 1, (n - shared).max())
    return out


def _mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64)
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


class Words:
    """Frequencies of the words that aren't rare, and the number of records."""

    def __init__(self, common: np.ndarray, counts: np.ndarray, total: int) -> None:
        order = np.argsort(common)
        self.common, self.counts, self.total = common[order], counts[order], max(total, 1)

    def frequencies(self, flat: np.ndarray) -> np.ndarray:
        rare = float(max(1, self.total // RARE))
        if not len(self.common):
            return np.full(len(flat), rare)
        where = np.minimum(np.searchsorted(self.common, flat), len(self.common) - 1)
        return np.where(self.common[where] == flat, self.counts[where], rare).astype(float)


def _in_order(flat: np.ndarray, sizes: np.ndarray, known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, frequency), the rare values of a row first."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    df = known.frequencies(flat)
    order = np.lexsort((flat, df, rows))
    return rows[order], flat[order], df[order]


def _tagged(keys: np.ndarray, parts: int, part: int) -> np.ndarray:
    """Keys whose last 16 bits name the part they are made of."""
    return (keys & ~np.uint64(0xFFFF)) | np.uint64(((parts.bit_length() - 1) & 0xF) << 12 | (part & 0xFFF))


def list_keys(flat: np.ndarray, sizes: np.ndarray, known: Words, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the inverted lists in which each set stands."""
    rows, flat, df = _in_order(flat, sizes, known)
    dealt = _mixed(flat)
    present, at = np.unique(sizes, return_inverse=True)
    out_rows, out_keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for least, most, parts in size_classes(int(sizes.max()) if len(sizes) else 0):
        table_ = skips(present, least, most, parts, threshold)
        for part in range(parts):
            skip = table_[part][at]
            taken = np.flatnonzero(skip >= 0)
            if not len(taken):
                continue
            here = (skip[rows] >= 0) & (dealt % np.uint64(parts) == part)
            renamed = np.zeros(len(sizes), np.int64)
            renamed[taken] = np.arange(len(taken))
            start = np.full(len(taken), _mixed(np.array([parts * 1_000_003 + part]))[0])
            made, keys = _part_keys(flat[here], df[here] / known.total, renamed[rows[here]], skip[taken], start, np.full(len(taken), float(known.total)))
            out_rows.append(taken[made])
            out_keys.append(_tagged(keys, parts, part))
    return np.concatenate(out_rows), np.concatenate(out_keys).view(np.int64)


def longer_keys(keys: np.ndarray, lengths: np.ndarray, flat: np.ndarray, sizes: np.ndarray, known: Words, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the lists that split long ones: row ``i`` stands in the list
    ``keys[i]`` of ``lengths[i]`` records, and is told apart by its words of other parts,
    of which it may skip as many as it may lack in all."""
    rows, flat, df = _in_order(flat, sizes, known)
    tags = keys.view(np.uint64) & np.uint64(0xFFFF)
    parts, part = np.uint64(1) << (tags >> np.uint64(12)), tags & np.uint64(0xFFF)
    present, at = np.unique(sizes, return_inverse=True)
    allowed = np.full(len(sizes), 0)
    for least, most, n_parts in size_classes(int(sizes.max()) if len(sizes) else 0):
        own = parts == n_parts
        allowed[own] = np.maximum(skips(present, least, most, 1, threshold)[0][at][own], 0)
    other = (parts[rows] == 1) | (_mixed(flat) % parts[rows] != part[rows])
    made, longer = _part_keys(flat[other], df[other] / known.total, rows[other], allowed, _mixed(keys), lengths.astype(float))
    return made, longer.view(np.int64)


def _part_keys(flat: np.ndarray, share: np.ndarray, rows: np.ndarray, skip: np.ndarray, start: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the lists of one part; the values of a row are in order.

    A key is a run of retained values, in order and with some left out, that ends
    where its expected number of records is at most LIST_LENGTH, or it has
    LONGEST_KEY values, or the part has no more or the rest may be skipped. Per row:
    ``skip``, the ``start`` of its keys, and of how many ``records`` it is one.
    """
    sizes = np.bincount(rows, minlength=len(skip))
    most_skipped = int(skip.max(initial=0))
    width = most_skipped + LONGEST_KEY
    place = np.arange(len(flat)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    kept = place < width
    value = np.zeros((len(sizes), width), np.int64)
    freq = np.ones((len(sizes), width))
    value[rows[kept], place[kept]] = flat[kept]
    freq[rows[kept], place[kept]] = share[kept]
    have = np.minimum(sizes, width)
    empty = np.flatnonzero(sizes <= skip)  # nothing of the part need be shared
    out_rows, out_keys = [empty], [start[empty]]

    def grow(chosen: tuple[int, ...], alive: np.ndarray, expected: np.ndarray, key: np.ndarray) -> None:
        """``alive``: rows for which ``chosen`` is a key that isn't ended yet."""
        first = chosen[-1] + 1 if chosen else 0
        for at in range(first, min(width, len(chosen) + most_skipped + 1)):
            ok = (at - len(chosen) <= skip[alive]) & (at < have[alive])
            if not ok.any():
                continue
            now = alive[ok]
            grown = expected[ok] * freq[now, at]
            made = _mixed(key[ok] ^ _mixed(value[now, at]))
            ended = (grown <= LIST_LENGTH) | (len(chosen) + 1 == LONGEST_KEY) | (sizes[now] == at + 1)
            # Sets whose rest may be wholly skipped can end here as well.
            short = ~ended & (sizes[now] - (len(chosen) + 1) <= skip[now])
            out_rows.append(now[ended | short])
            out_keys.append(made[ended | short])
            if not ended.all():
                grow((*chosen, at), now[~ended], grown[~ended], made[~ended])

    grow((), np.arange(len(sizes)), records, start)
    return np.concatenate(out_rows), np.concatenate(out_keys)


ENTRY = "bucket int, keys array<bigint>, classes array<bigint>, low array<bigint>, high array<bigint>, n array<int>"
#: A near pair of classes, or (second empty) a record of a list that is too long.
NEAR = "class_a bigint, class_b bigint, key bigint, low bigint, high bigint, n int, length bigint"
_NEAR = pa.schema([("class_a", pa.int64()), ("class_b", pa.int64()), ("key", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int32()), ("length", pa.int64())])
_ENTRY = pa.schema([("bucket", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("keys", "classes", "low", "high")), ("n", pa.list_(pa.int32()))])


class Sender:
    """Entries of inverted lists, handed on in columns, one row per bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """keys, classes, halves of the sketches, sizes of the sets."""
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        columns = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.size = [], 0
        bucket = (_mixed(columns[0]) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        present, starts = np.unique(bucket[order], return_index=True)
        offsets = pa.array(np.append(starts, len(order)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order].astype(field.type.value_type.to_pandas_dtype()))) for c, field in zip(columns, list(_ENTRY)[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), *lists], schema=_ENTRY)


def _list_pairs(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, share: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places inside each list whose first half sketches may pass, in blocks:
    short lists together, one distance at a time, long ones one by one."""
    lengths = ends - starts
    short = lengths <= 256
    at, stop = (np.concatenate([np.arange(a, b) for a, b in zip(starts[short], ends[short])]), np.repeat(ends[short], lengths[short])) if short.any() else (np.zeros(0, np.int64),) * 2
    for gap in range(1, 256):
        going = at + gap < stop
        at, stop = at[going], stop[going]
        if not len(at):
            break
        near = np.bitwise_count(low[at] ^ low[at + gap]) <= share[at] + share[at + gap]
        yield at[near], at[near] + gap
    for a, b in zip(starts[~short], ends[~short]):
        for i in range(a, b, 256):
            x = slice(i, min(i + 256, b))
            for j in range(i, b, 4096):
                y = slice(j, min(j + 4096, b))
                left, right = np.nonzero(np.bitwise_count(low[x, None] ^ low[None, y]) <= share[x, None] + share[None, y])
                left, right = left + i, right + j
                yield left[left < right], right[left < right]


def near_in_lists(keys: np.ndarray, classes: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, threshold: float, long: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of the same list whose sketches and sizes allow the threshold; lists of
    more than ``long`` classes are handed back."""
    if not len(keys):
        return
    order = np.lexsort((classes, keys))
    new = np.append(True, (keys[order][1:] != keys[order][:-1]) | (classes[order][1:] != classes[order][:-1]))
    keys, classes, low, high, n = (c[order[new]] for c in (keys, classes, low, high, n))
    low, high = low.view(np.uint64), high.view(np.uint64)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(starts[1:], len(keys))
    lengths = ends - starts
    if long is not None and (lengths > long).any():
        for a, b in zip(starts[lengths > long], ends[lengths > long]):
            columns = [classes[a:b], None, keys[a:b], low[a:b], high[a:b], n[a:b], np.full(b - a, b - a)]
            yield pa.RecordBatch.from_arrays([pa.nulls(b - a, f.type) if c is None else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(f.type) for c, f in zip(columns, _NEAR)], schema=_NEAR)
        starts, ends = starts[lengths <= long], ends[lengths <= long]
    gap = (1 - threshold) / (1 + threshold)
    share = n.astype(np.float32) * np.float32(gap) + np.float32(5e-4)
    for x, y in _list_pairs(starts[ends - starts > 1], ends[ends - starts > 1], low, share):
        differ = np.bitwise_count(low[x] ^ low[y]) + np.bitwise_count(high[x] ^ high[y])
        near = (differ <= share[x] + share[y]) & (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-6)
        if near.any():
            first, second = classes[x[near]], classes[y[near]]  # ordered inside a list
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), *(pa.nulls(len(first), f.type) for f in list(_NEAR)[2:])], schema=_NEAR)


def _compared(entries: DataFrame, threshold: float, long: int | None) -> DataFrame:
    """NEAR of all lists, each bucket in one task."""

    def run(table_: pa.Table) -> pa.Table:
        columns = [c.combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in table_.columns[1:]]
        pairs: list[pa.RecordBatch] = []
        found = 0
        for batch in near_in_lists(*columns, threshold, long):
            pairs.append(batch)
            found += batch.num_rows
            if found > HELD and batch.column(1).null_count == 0:  # the same pair comes from many lists
                merged = pa.Table.from_batches(pairs).group_by(_NEAR.names).aggregate([])
                pairs, found = merged.select(_NEAR.names).combine_chunks().to_batches(), 0
        merged = pa.Table.from_batches(pairs, schema=_NEAR)
        return merged.group_by(_NEAR.names).aggregate([]).select(_NEAR.names) if merged.num_rows else merged

    return entries.groupBy("bucket").applyInArrow(run, NEAR)


def _buckets(spark: SparkSession, entries: float) -> int:
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries * ENTRY_BYTES / BUCKET))


def listed_pairs(sets: DataFrame, threshold: float, long_list: int = LONG) -> DataFrame:
    """(class_a, class_b), a < b, of all pairs that share a list and may reach the
    threshold by their sketches; pairs may repeat. A list of more than ``long_list``
    classes is split."""
    spark = sets.sparkSession
    total = sets.count()
    floor = max(total // RARE, 1)
    words = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") > floor)
    table_ = words.toArrow()  # at most RARE * mean set size rows
    shared = spark.sparkContext.broadcast(Words(table_["w"].to_numpy(), table_["df"].to_numpy(), total))
    buckets = _buckets(spark, total * ENTRIES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, send = shared.value, Sender(buckets)
        seen: set[int] = set()  # classes this task has listed: copies are combined before the shuffle
        for batch in batches:
            new = []
            for at, class_id in enumerate(batch.column(0).to_pylist()):
                if class_id not in seen:
                    seen.add(class_id)
                    new.append(at)
            if len(seen) > SEEN:
                seen.clear()
            if new:
                batch = batch.take(pa.array(new, pa.int64()))
                ids, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
                n = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
                rows, keys = list_keys(flat, n, known, threshold)
                yield from send.add(keys, *(c[rows] for c in (ids, *sketches(flat, n), n)))
        yield from send.flush()

    entries = sets.select("class_id", "words").mapInArrow(run, ENTRY)
    near = materialize(_compared(entries, threshold, long_list), "near")
    pairs, long = near.where("class_b is not null"), near.where("class_b is null")
    if long.isEmpty():
        return pairs.select("class_a", "class_b")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, send = shared.value, Sender(buckets)
        for batch in batches:
            ids, keys, lengths = (batch.column(i).to_numpy() for i in range(3))
            flat, n = batch.column(3).flatten().to_numpy(), np.diff(batch.column(3).offsets.to_numpy()).astype(np.int64)
            rows, longer = longer_keys(keys, lengths, flat, n, known, threshold)
            yield from send.add(longer, *(c[rows] for c in (ids, *sketches(flat, n), n)))
        yield from send.flush()

    own = sets.select("class_id", "words").join(long.select("class_a").distinct(), F.col("class_id") == F.col("class_a"), "left_semi").groupBy("class_id").agg(F.first("words").alias("words"))
    told = long.join(own, F.col("class_a") == F.col("class_id")).select("class_a", "key", "length", "words")
    near = materialize(_compared(told.mapInArrow(split, ENTRY), threshold, long_list), "near")
    pairs, long = pairs.unionByName(near.where("class_b is not null")), near.where("class_b is null")
    if long.isEmpty():
        return pairs.select("class_a", "class_b")

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = Sender(buckets)
        for batch in batches:
            ids, keys, lengths, *rest = (batch.column(i).to_numpy() for i in range(6))
            blocks = -(-lengths // max(1, long_list // 2))
            own = (_mixed(ids) % blocks.astype(np.uint64)).astype(np.int64)
            rows = np.repeat(np.arange(len(ids)), blocks)
            other = np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            pair = np.minimum(own[rows], other) * blocks[rows] + np.maximum(own[rows], other)
            yield from send.add((_mixed(keys[rows]) ^ _mixed(pair)).view(np.int64), *(c[rows] for c in (ids, *rest)))
        yield from send.flush()

    blocks = long.select("class_a", "key", "length", "low", "high", "n").mapInArrow(by_block, ENTRY)
    return pairs.unionByName(_compared(blocks, threshold, None)).select("class_a", "class_b")


def class_pairs(sets: DataFrame, threshold: float = 0.7, long_list: int = LONG) -> DataFrame:
    """(class_a, class_b, jaccard) of different sets at or above the threshold, a < b."""
    near = materialize(listed_pairs(sets, threshold, long_list).distinct(), "candidates")
    wanted = near.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct()
    words = sets.join(wanted, "class_id", "left_semi").groupBy("class_id").agg(F.first("words").alias("words"))
    both = near.join(words.select(F.col("class_id").alias("class_a"), F.col("words").alias("wa")), "class_a").join(words.select(F.col("class_id").alias("class_b"), F.col("words").alias("wb")), "class_b")
    shared = F.size(F.array_intersect("wa", "wb"))
    jaccard = shared / (F.size("wa") + F.size("wb") - shared)
    return both.select("class_a", "class_b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12)


def card_sets(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(record_sets(table(spark, folder, "cards"), "card_id", "front", "back"), "sets")


def near_pairs(sets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All pairs of different ids at or above the threshold: (id_a, id_b), a < b.
    Copies are pairs too; they are expanded here, and only here."""
    members = sets.select("class_id", "id").distinct()
    links = class_pairs(sets, threshold).select("class_a", "class_b")
    copied = members.groupBy("class_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    a, b = members.select(F.col("class_id").alias("class_a"), F.col("id").alias("x")), members.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    pairs = links.unionByName(copied).join(a, "class_a").join(b, "class_b").where((F.col("x") < F.col("y")) | ((F.col("class_a") != F.col("class_b")) & (F.col("x") > F.col("y"))))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, group) of the nodes of ``links`` (a, b): the least node reachable.

    Large-star and small-star steps in turn until a round changes nothing; each round
    is written to the shared folder, and only count and checksum of the edges come to
    the driver. Should ``most_rounds`` be given and run out, an error is raised.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for done in count():
        if done == most_rounds:
            raise RuntimeError(f"groups still change after {most_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select("b", "m", "a")
        edges = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(edges, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("group"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("group"))).groupBy("node").agg(F.min("group").alias("group"))


def near_groups(sets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per id: class_id (equal sets), group_id (linked classes), n_links
    (links of its class to other classes), n_copies (ids in its class)."""
    links = materialize(class_pairs(sets, threshold), "links")
    groups = components(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    members = sets.select("id", "class_id").distinct()
    copies = members.groupBy("class_id").agg(F.count("*").alias("n_copies"))
    joined = members.join(copies, "class_id").join(degree, "class_id", "left").join(groups.select(F.col("node").alias("class_id"), F.col("group").alias("group_id")), "class_id", "left")
    return joined.select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_pairs(card_sets(spark, folder)).select(F.col("id_a").alias("card_a"), F.col("id_b").alias("card_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(card_sets(spark, folder)).withColumnRenamed("id", "card_id")


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
SQL = {
    "p5_found": r"""
with c as (select distinct card_id, front, back from cards where card_id is not null),
w as (select distinct card_id, unnest(regexp_extract_all(lower(concat_ws(' ', front, back)), '[\p{L}\p{N}]+')) w from c),
n as (select card_id, count(*) n from w group by 1),
d as (select w, count(*) df from w group by 1),
r as (select w.card_id, w.w, n.n, row_number() over (partition by w.card_id order by d.df, w.w) spot from w join n using (card_id) join d using (w)),
-- a pair at 0.7 shares a word among the first n - ceil(0.7 n) + 1 in any fixed order
p as (select * from r where spot <= n - ceil(0.7 * n - 1e-9) + 1),
k as (select distinct a.card_id card_a, b.card_id card_b from p a join p b on a.w = b.w and a.card_id < b.card_id and a.n >= 0.7 * b.n - 1e-9 and b.n >= 0.7 * a.n - 1e-9),
s as (select card_a, card_b, count(*) shared from k join w a on a.card_id = card_a join w b on b.card_id = card_b and a.w = b.w group by 1, 2)
select card_a, card_b from s join n a on a.card_id = card_a join n b on b.card_id = card_b where shared >= 0.7 * (a.n + b.n - shared) - 1e-9"""
}
