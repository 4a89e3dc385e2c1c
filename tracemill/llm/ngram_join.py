"""Exact Jaccard self-join of texts on word n-grams, and near-duplicate classes from it.

Method: universe-partition pigeonhole. Shingles are hashed; a hash range is a segment of the universe.
Sets are grouped in bands of sizes, and two sets that link have sizes of one band or of neighbouring
bands, so each set carries keys for its own band and for the next. In a band, two linked sets differ in
at most H shingles. Every segment gets a value: 1, whose key is the segment's whole subset, or 2, whose
keys are the subset and all its one-deletion neighbours. The values add up to H + 1 + slack, so segments
of a total value of slack + 1 at least agree, and a set may leave out up to slack keys of empty subsets
(which very many sets share) without losing a link. A cost model allocates values and slack by band.

A set may also leave out as many keys as it shares too many with any set that it links with. It leaves out the most
frequent of its frequent keys, in one order of all keys, so a passage or a subset that very many sets have brings
together only those of them that have little else to meet by.

Keys only bring up candidates, and only classes are asked for, so pairs within one class needn't be looked
at. In each round a key has a hub, a block of about BLOCK similar sets at most; every other set on the key is
verified exactly against the hub, the links found are contracted, and the hub's sets leave the key. A key
is done when its sets are in one class, and a set when it has fewer keys left than a link needs. A group of
near copies is one class after a round or two, with work in proportion to its sets. Keys whose sets don't
link take further rounds, with more hubs in each. Equal sets are merged first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .resident import release
from .textkeys import mix, shingle_sets, slices

#: Sets and shingles of a block, on average at most; the same for the sets that meet a block in one group.
BLOCK, BLOCK_SHINGLES, GROUP, GROUP_SHINGLES = 4096, 1_000_000, 4096, 2_000_000
#: Sets from which a key is a frequent one.
FREQUENT = 64
#: In the cost model: keys that a chance meeting of two sets is worth.
CHANCE = 10_000


@lru_cache(maxsize=None)
def bands(percent: int, upto: int) -> list[int]:
    """Largest size of each band, as far as needed for a set of `upto` shingles and the band after it."""
    highs, low = [], 1
    while len(highs) < 2 or highs[-2] < upto:
        highs.append(low * 100 // percent)
        low = highs[-1] + 1
    return highs


@lru_cache(maxsize=None)
def allocation(percent: int, least: int, high: int) -> tuple[int, int, int, int]:
    """(H, segments, segments of value 2, slack) for a band up to `high` shingles whose keys sets of `least` or more carry.

    Cost: the keys of a set, and the chance of a set to carry a key of an empty subset, which very many
    sets share. Only the choice of segments and slack hangs on it, never the result.
    """
    most = (100 - percent) * 2 * high // (100 + percent)
    best = None
    for slack in range(0, most // 2 + 8, max(1, most // 40)):
        half = (most + 1 + slack) // 2
        for double in range(0, half + 1, max(1, half // 16)):
            m = most + 1 + slack - double
            empty = (1 - 1 / m) ** least
            mean = (m - double) * empty
            over = 1.0 if mean > slack + 1 else exp(slack + 1 - mean + (slack + 1) * log(mean / (slack + 1))) if mean else 0.0
            cost = (m - double) + double * (1 + high / m) + CHANCE * min(1.0, over + double * (empty + least / m * (1 - 1 / m) ** (least - 1)))
            if best is None or cost < best[0]:
                best = cost, m, double, slack
    return most, *best[1:]


def set_keys(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The keys of one set, given as sorted distinct hashes, and how many of them it shares at least with any set that it links with.

    An empty set has none. Of the agreeing segments, of a total value of slack + 1, at most those that are
    empty in this set go without a shared key; a segment of value 2 gives one shared key at least.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), 1
    highs = bands(percent, n)
    own = int(np.searchsorted(highs, n))
    sums = np.zeros(n + 1, np.uint64)
    mixed = mix(hashes, 11)
    np.cumsum(mixed, out=sums[1:])
    out, least = [], n
    for band in (own, own + 1):
        _, m, double, slack = allocation(percent, highs[band - 2] + 1 if band >= 2 else 1, highs[band])
        edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
        cut = np.concatenate(([0], np.searchsorted(hashes, edges), [n]))
        subset = sums[cut[1:]] - sums[cut[:-1]]
        label = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 24), 13)
        single = np.arange(m) >= double
        blank = single & (cut[1:] == cut[:-1])
        blanks = int(blank.sum())
        keep = ~blank if blanks <= slack else np.ones(m, bool)
        least = min(least, -(-max(1, slack + 1 - blanks) // (2 if double else 1)))
        out.append(mix(subset[keep] + label[keep], 17))
        if double:
            inside = cut[double]
            at = np.searchsorted(cut[1 : double + 1], np.arange(inside), "right")
            out.append(mix(subset[at] - mixed[:inside] + label[at], 17))
    return np.unique(np.concatenate(out)), least


def _describe(words: int):
    """doc_id, text -> doc_id, n_shingles, two 64-bit sums that name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                rows = list(shingle_sets(data, offsets, words))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(x) for x in rows], pa.int64()),
                    pa.array([int(mix(x, 3).sum(dtype=np.uint64).view(np.int64)) for x in rows], pa.int64()),
                    pa.array([int(mix(x, 5).sum(dtype=np.uint64).view(np.int64)) for x in rows], pa.int64()),
                ], ["doc_id", "n_shingles", "h1", "h2"])

    return run


def _keys(percent: int, words: int):
    """doc_id, text -> key, doc_id, least (keys shared with any set that links); a row for each key of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a).to_numpy()
                keys, least = zip(*(set_keys(x, percent) for x in shingle_sets(data, offsets, words)), strict=True)
                sizes = [len(x) for x in keys]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(np.array(least, np.int32), sizes)),
                ], ["key", "doc_id", "least"])

    return run


def _sets(words: int):
    """doc_id, text -> doc_id, the number of shingles, the sorted hashes of its set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                rows = [x.tobytes() for x in shingle_sets(data, offsets, words)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(x) // 8 for x in rows], pa.int64()), pa.array(rows, pa.binary()),
                ], ["doc_id", "n", "hashes"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order of their first column -> those whose key isn't alone, and the partition's first and last row."""
    held, same = None, True  # the last row so far, and whether it is the first one or has the key of the row before it
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        keys = rows.column(0).to_numpy()
        equal = keys[1:] == keys[:-1]
        before = np.concatenate(([same], equal))
        yield rows.slice(0, len(keys) - 1).filter(pa.array(before[:-1] | equal))
        held, same = rows.slice(len(keys) - 1), bool(before[-1])
    if held is not None:
        yield held


def _verify(percent: int):
    """A hub's block (side 0) and sets that meet it (side 1): (doc_id, side, hashes) -> links (a, b) that span all links of the hub's sets."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("side")
        ids, hubs = table.column("doc_id").to_numpy(), int((table.column("side").to_numpy() == 0).sum())
        rows = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in rows], np.int64)
        # Columns: hashes of the hub's sets that more than one row has.
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *rows[:hubs]]))
        where, column = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for i, x in enumerate(rows if len(known) else []):
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            at = at[known[at] == x]
            where.append(np.full(len(at), i, np.int32))
            column.append(at.astype(np.int32))
        where, column = np.concatenate(where), np.concatenate(column)
        several = np.bincount(column, minlength=len(known)) > 1
        shared = several[column]
        where, column = where[shared], (np.cumsum(several, dtype=np.int32) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        column, where, step, tile = column[order], where[order], 512, 512
        common = np.zeros((hubs, len(rows)), np.int32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            a, b = np.searchsorted(column, [start, start + step])
            part = np.zeros((len(rows), step), np.float32)
            part[where[a:b], column[a:b] - start] = 1
            some = np.unique(where[a:b])  # the rows that have any of these hashes
            near = some[some < hubs]
            common[np.ix_(near, some)] += (part[near] @ part[some].T).astype(np.int32)
        linked = np.empty((hubs, len(rows)), bool)
        for a in range(0, hubs, tile):
            n = common[a : a + tile].astype(np.int64)
            linked[a : a + tile] = 100 * n >= percent * (sizes[a : min(a + tile, hubs), None] + sizes[None, :] - n)
        # Every linked set hangs on its first hub set; hub sets that link, or link with the same set, are joined by a spanning forest.
        far = np.flatnonzero(linked[:, hubs:].any(0))
        out = [(np.argmax(linked[:, hubs + far], 0), hubs + far)] if len(far) else []
        left = np.ones(hubs, bool)
        for root in range(hubs):
            if left[root]:
                left[root], reach = False, linked[root]
                while True:
                    met = left & (linked[:, reach].any(1) if reach.any() else False)
                    if not met.any():
                        break
                    left &= ~met
                    out.append((np.full(int(met.sum()), root), np.flatnonzero(met)))
                    reach = linked[met].any(0) & ~reach
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)]) for i in (0, 1))
        return pa.table({"a": ids[a], "b": ids[b]})

    return run


def _thinned(met: DataFrame) -> DataFrame:
    """key, doc_id, least -> the rows of sets with enough keys, without those that may be left out, with what a link still needs.

    Of its frequent keys a set leaves out the most frequent, least - 1 of them at most. What two linked sets leave out of
    the keys they share is the end of these in the common order, and no longer than what one of them leaves out; so each
    keeps as many shared keys as its least less the number that it has left out.
    """
    frequent = met.groupBy("key").agg(F.count("*").alias("sets")).where(F.col("sets") >= FREQUENT)
    own = Window.partitionBy("doc_id")
    ranked = met.join(frequent, "key", "left").withColumn("keys", F.count("*").over(own)).withColumn(
        "place", F.row_number().over(own.orderBy(F.coalesce("sets", F.lit(0)).desc(), "key"))
    ).where("keys >= least")
    out = F.col("sets").isNotNull() & (F.col("place") < F.col("least"))
    left = ranked.withColumn("out", out).withColumn("least", (F.col("least") - F.sum(F.col("out").cast("int")).over(own)).cast("int"))
    return left.where("not out").select("key", "doc_id", "least")


def _round(step: int, live: DataFrame, members: DataFrame, hashes: DataFrame, percent: int, folder: str, at_first: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """One round over live (key, doc_id) and members (doc_id, least, comp, size: sets of that class).

    Returns links, and live and members of the next round; None if no key holds sets of two classes. Every key has
    a hub, and more of them in later rounds and where few of the at_first rows of the first round are left.
    """
    spark = live.sparkSession
    put = lambda df, name: store.written(df, folder, f"{name}{step}")
    at = live.join(members, "doc_id")
    # A key's first set, of a small class if there is one, gives its sets a common home.
    keys = at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("size", "doc_id")).alias("first")).where("low < high")
    held = put(at.join(keys.select("key", F.col("first.doc_id").alias("first")), "key"), "held")
    rows = held.count()
    if not rows:
        store.freed(spark, folder, f"held{step}")
        return None
    # The home of a set is that which most of its keys name.
    homes = held.groupBy("doc_id", "first").agg(F.count("*").alias("n"), F.first("least").alias("least"), F.first("comp").alias("comp"), F.first("size").alias("size"))
    homes = homes.groupBy("doc_id").agg(
        F.sum("n").alias("keys"), F.first("least").alias("least"), F.first("comp").alias("comp"), F.first("size").alias("size"),
        F.min(F.struct(-F.col("n"), F.col("first").alias("home")))["home"].alias("home"),
    ).where("keys >= least").join(hashes.select("doc_id", "n"), "doc_id")
    # Blocks: sets of one home, all of one class or all of classes of their own, split by hash into parts of a bounded expected size.
    homes = homes.withColumn("kind", F.when(F.col("size") > 1, F.col("comp")).otherwise(-1))
    parts = homes.groupBy("home", "kind").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).alias("parts"))
    block = F.xxhash64("home", "kind", F.pmod(F.xxhash64("doc_id"), "parts"))
    blocks = put(homes.join(parts, ["home", "kind"]).select("doc_id", "least", "comp", "size", "n", block.alias("block")), "blocks")
    spots = held.select("key", "doc_id").join(blocks, "doc_id").withColumn("kind", F.when(F.col("size") > 1, F.col("comp")))
    # A key's hub is its largest block of sets that are alone in their classes, else a block of its smallest class; with several hubs, one for each share of the blocks.
    share = F.pmod(F.xxhash64(F.lit(step), "block"), F.lit(max(1 << max(0, step - 2), at_first // rows)))
    there = spots.groupBy("key", "block").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("kind").alias("kind"))
    choice = F.struct(F.when(F.col("kind").isNull(), 0).otherwise(F.col("size")).alias("size"), (-F.col("n")).alias("n"), "block", "kind")
    hubs = put(there.groupBy("key", share.alias("share")).agg(F.min(choice).alias("h")).select("key", F.col("h.block").alias("hub"), F.col("h.kind").alias("hub_kind")), "hubs")
    meet = spots.join(hubs, "key").where("block <> hub and not coalesce(kind = hub_kind, false)")
    needed = put(meet.groupBy("hub", "doc_id").agg(F.first("n").alias("n")), "needed")
    groups = needed.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / F.lit(GROUP)), F.ceil(F.sum("n") / F.lit(GROUP_SHINGLES))).alias("groups"))
    groups = hubs.select("hub").distinct().join(groups, "hub", "left").select("hub", F.coalesce("groups", F.lit(1)).cast("int").alias("groups"))
    own = blocks.select(F.col("block").alias("hub"), "doc_id").join(groups, "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "doc_id", F.lit(0).alias("side"))
    others = needed.join(groups, "hub").select("hub", F.pmod(F.xxhash64("doc_id"), "groups").cast("int").alias("group"), "doc_id", F.lit(1).alias("side"))
    met = own.unionByName(others).join(hashes.select("doc_id", "hashes"), "doc_id")
    links = put(met.groupBy("hub", "group").applyInArrow(_verify(percent), "a long, b long"), "links")
    # Classes of the next round, and keys without the sets that have met everything on them.
    comp = lambda side: blocks.select(F.col("doc_id").alias(side), F.col("comp").alias(f"c{side}"))
    across = links.join(comp("a"), "a").join(comp("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    merged = store.components(across, folder, f"merged{step}").withColumnRenamed("id", "comp")
    members = blocks.join(merged, "comp", "left").select("doc_id", "least", F.coalesce("component_id", "comp").alias("comp"))
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"))
    members = put(members.join(sizes, "comp").select("doc_id", "least", "comp", "size"), "members")
    live = put(spots.join(hubs.select("key", F.col("hub").alias("block")), ["key", "block"], "left_anti").select("key", "doc_id"), "live")
    store.freed(spark, folder, *(f"{x}{step}" for x in ("held", "blocks", "hubs", "needed", "merged")), f"live{step - 1}", f"members{step - 1}")
    return links, live, members


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """Classes of texts whose word n-gram sets link, directly or through others.

    docs: doc_id (long, unique) and text; more columns are ignored. Words are `[^\\x20\\x09-\\x0D]+` with A-Z
    lower-cased; a text's set is that of its distinct shingles of `words` words, with fewer words the whole
    sequence as one. Two texts link when 100 * |intersection| >= percent * |union|, for 1 <= percent <= 100.
    Returns doc_id, n_shingles (0 without words), component_id (smallest doc_id that links reach). A null
    or empty text links with nothing; equal texts always link; rows with a null doc_id are left out; an
    empty table gives no rows. Shingles are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    folder = store.shared_dir(spark)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = store.written(docs.mapInArrow(_describe(words), "doc_id long, n_shingles long, h1 long, h2 long"), folder, "described")
    # Equal sets: the smallest doc_id stands for all.
    named = described.where("n_shingles > 0")
    classes = named.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copied = store.written(classes.where("copies > 1").select("n_shingles", "h1", "h2", "rep"), folder, "copied")
    copies = store.written(named.join(copied, ["n_shingles", "h1", "h2"]).where("doc_id <> rep").select("doc_id", "rep"), folder, "copies")
    # Keys that several sets have. Ranges of (key, doc_id) split a frequent key over many tasks.
    singles = docs.join(copies.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text")
    keyed = singles.mapInArrow(_keys(percent, words), "key long, doc_id long, least int")
    shared = store.written(keyed.repartitionByRange("key", "doc_id").sortWithinPartitions("key").mapInArrow(_repeated, keyed.schema), folder, "shared")
    met = store.written(_thinned(shared), folder, "live0")
    store.freed(spark, folder, "shared")
    # Sets with as many of them as a link needs, each a class of its own to begin with.
    enough = met.groupBy("doc_id").agg(F.first("least").alias("least"))
    members = store.written(enough.select("doc_id", "least", F.col("doc_id").alias("comp"), F.lit(1).cast("long").alias("size")), folder, "members0")
    hashes = store.written(
        docs.join(members.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(words), "doc_id long, n long, hashes binary"), folder, "hashes"
    )
    live, step, at_first, links = met.select("key", "doc_id"), 0, met.count(), copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    while (done := _round(step := step + 1, live, members, hashes, percent, folder, at_first)) is not None:
        links, live, members = links.unionByName(done[0]), *done[1:]
    joined = store.components(links, folder).withColumnRenamed("id", "doc_id")
    store.freed(spark, folder, "copied", "copies", "hashes", "live0", "members0", *(f"{x}{k}" for k in range(1, step) for x in ("links", "live", "members")))
    return described.select("doc_id", "n_shingles").join(joined, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
