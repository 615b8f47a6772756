"""SimHash near-dedup: a Gray-order hierarchical index inside pigeonhole buckets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import (
    NO_ID, boxed, field, map_batches, number_id, shuffle_partitions, utf8)
from tallyloom.llm.graph import components
from tallyloom.session import materialise

SHINGLE = 4
MAX_BITS = 4
SEED = 42

FAN_OUT = 8          # children of an index node
HASHES = 1 << 15     # shingle hashes turned into bits at once
FRONTIER = 1 << 21   # (query, node) pairs held at once
BUCKET_ROWS = 4096   # fingerprints expected in a bucket
WINDOW_ROWS = 1 << 17
BLOCK_ROWS = 1 << 15  # fingerprints expected in a block of a crowded bucket
SEARCH = ["mask", "part", "i", "j"]  # one search: two blocks of a bucket, or one twice


def shingle_hashes(text: bytes, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of blank-separated, A-Z lower-cased words, in bounded runs."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) < width:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:len(words) - width]]
    ends = ends[width - 1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES):
        yield np.array([digest(joined[a:b - 1], SEED) for a, b in zip(
            starts[at:at + HASHES], ends[at:at + HASHES])], np.uint64)


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """A bit is set if it is set in over half of the text's shingle hashes."""
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    waiting: list[np.ndarray] = []
    owners: list[int] = []

    def count() -> None:
        hashes = np.concatenate(waiting)
        sizes = [len(x) for x in waiting]
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        sums = np.add.reduceat(bits, np.cumsum([0, *sizes[:-1]]), axis=0, dtype=np.int32)
        np.add.at(ones, owners, sums)
        np.add.at(total, owners, sizes)
        waiting.clear()
        owners.clear()

    held = 0
    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, width):
            waiting.append(hashes)
            owners.append(i)
            held += len(hashes)
            if held >= HASHES:
                count()
                held = 0
    if waiting:
        count()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def linked_roots(buckets: np.ndarray, values: np.ndarray, max_bits: int) -> np.ndarray:
    """Index of a row of the same chain of links for every row: the chain's first in Gray order.

    Rows of one bucket within ``max_bits`` of each other are linked. Rows are sorted by Gray
    rank; each run of FAN_OUT rows, then of FAN_OUT nodes, becomes a node that holds the bits
    its rows share. A child keeps only the shared bits its parent does not have, so the
    differences accumulate from the root down and a whole group falls away once they exceed
    ``max_bits``. Groups already in one chain with the query are not entered again.
    """
    order = np.lexsort((gray_rank(values), buckets))
    bucket, fp = buckets[order], values[order]
    n = len(fp)
    # levels[0] are the rows; every node covers children first[i]:first[i + 1] of the level below
    level = {"same": np.full(n, ~np.uint64(0)), "bits": fp, "last": np.arange(n), "bucket": bucket}
    levels, firsts = [level], []
    while True:
        b = levels[-1]["bucket"]
        new = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        if len(new) == len(b):
            break
        inside = np.arange(len(b)) - np.repeat(new, np.diff(np.r_[new, len(b)]))
        first = np.flatnonzero(inside % FAN_OUT == 0)
        below = levels[-1]
        ones = np.bitwise_and.reduceat(below["bits"] & below["same"], first)
        zeros = np.bitwise_and.reduceat(~below["bits"] & below["same"], first)
        levels.append({"same": ones | zeros, "bits": ones, "bucket": b[first],
                       "last": below["last"][np.r_[first[1:], len(b)] - 1]})
        firsts.append(np.r_[first, len(b)])
    for upper, below, first in zip(levels[1:], levels, firsts):
        parent = np.repeat(np.arange(len(first) - 1), np.diff(first))
        below["own"] = below["same"] & ~upper["same"][parent]
    levels[-1]["own"] = levels[-1]["same"]

    chain = np.arange(n)
    top = np.searchsorted(levels[-1]["bucket"], bucket)
    step = max(1, FRONTIER // (FAN_OUT * FAN_OUT))
    for at in range(0, n, step):
        lows, highs = [chain], [chain]
        for first in firsts:
            lows.append(np.minimum.reduceat(lows[-1], first[:-1]))
            highs.append(np.maximum.reduceat(highs[-1], first[:-1]))
        queries = np.arange(at, min(n, at + step))
        todo = [(len(levels) - 1, queries, top[queries], np.zeros(len(queries), np.int64))]
        found = []
        while todo:
            depth, query, node, spent = todo.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                todo += [(depth, query[:half], node[:half], spent[:half]),
                         (depth, query[half:], node[half:], spent[half:])]
                continue
            at_level = levels[depth]
            spent = spent + np.bitwise_count((fp[query] ^ at_level["bits"][node]) & at_level["own"][node])
            done = (lows[depth][node] == highs[depth][node]) & (lows[depth][node] == chain[query])
            go = (spent <= max_bits) & (at_level["last"][node] > query) & ~done
            query, node, spent = query[go], node[go], spent[go]
            if depth == 0:
                found.append((query, node))
            elif len(query):
                first = firsts[depth - 1]
                counts = first[node + 1] - first[node]
                child = np.repeat(first[node] - np.r_[0, np.cumsum(counts)[:-1]], counts)
                child += np.arange(len(child))
                todo.append((depth - 1, np.repeat(query, counts), child, np.repeat(spent, counts)))
        chain = _joined(chain, found)
    roots = np.empty(n, np.int64)
    roots[order] = order[chain]
    return roots


def _joined(chain: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Give linked rows the smallest index of their chains."""
    pairs = [(a, b) for a, b in found if len(a)]
    if not pairs:
        return chain
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    chain = chain.copy()
    while True:
        x, y = chain[a], chain[b]
        if (x == y).all():
            return chain
        low = np.minimum(x, y)
        np.minimum.at(chain, x, low)
        np.minimum.at(chain, y, low)
        while (chain[chain] != chain).any():
            chain = chain[chain]


def pigeonholes(rows: int, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Masks of which at least one agrees on any two fingerprints within ``max_bits``.

    The 64 bits are split into n blocks; of n blocks at most ``max_bits`` can differ, so the
    masks are all choices of n - ``max_bits`` blocks. n is the smallest for which evenly
    spread fingerprints fill a bucket with no more than ``bucket_rows``; every n is exact.
    """
    for n in range(max_bits + 1, 65):
        if rows / 2 ** (64 * (n - max_bits) // n) <= bucket_rows or n == 2 * max_bits:
            break
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(n)]
    return [sum(chosen) for chosen in combinations(blocks, n - max_bits)]


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) that join the distinct fingerprints ``fp`` of every chain of links.

    Fingerprints meet where a mask's bits agree. A bucket of n fingerprints is split into
    ceil(n / block_rows) blocks by a hash, and every two blocks are searched together, so
    that a family around one centre spreads over tasks of bounded size. A task streams
    through its sorted buckets and hands on one edge per linked row and search, never the
    pairs.
    """
    masks = pigeonholes(prints.count(), max_bits)
    holes = F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(_signed(m)).alias("part"))
        for i, m in enumerate(masks)])).alias("hole")
    held = prints.select("fp", holes).select("fp", "hole.mask", "hole.part")
    crowds = materialise(
        held.groupBy("mask", "part").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        .where("blocks > 1"), "crowds")
    placed = held.join(crowds, ["mask", "part"], "left").select(
        "fp", "mask", "part", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn(
        "block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "fp", "mask", "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.repartition(shuffle_partitions(prints.sparkSession), *SEARCH).sortWithinPartitions(*SEARCH)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, keys in _windows(batches):
            buckets = np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(axis=1)])
            roots = linked_roots(buckets, fp, max_bits)
            moved = np.flatnonzero(roots != np.arange(len(roots)))
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[moved].astype(np.int64)), pa.array(fp[roots[moved]].astype(np.int64))],
                    ["a", "b"])

    return dealt.mapInArrow(search, "a long, b long")


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole searches (fingerprints, keys), WINDOW_ROWS or more rows each."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows, enough = 0, WINDOW_ROWS
    for batch in batches:
        held.append((batch.column("fp").to_numpy().astype(np.uint64),
                     np.stack([batch.column(k).to_numpy().astype(np.int64) for k in SEARCH], axis=1)))
        rows += batch.num_rows
        if rows < enough:
            continue
        fp, keys = (np.concatenate(x) for x in zip(*held))
        others = np.flatnonzero((keys != keys[-1]).any(axis=1))
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield fp[:cut], keys[:cut]
        held, rows = [(fp[cut:], keys[cut:])], len(fp) - cut
        enough = max(WINDOW_ROWS, 2 * rows)
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*held))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id), one row per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most ``max_bits``
    differing bits, the row's own included. NULL or blank text has fingerprint zero and is
    linked like any other. Rows of equal id or text are rows like others (same fingerprint,
    same component); a NULL id is never the smallest unless its component has no other, and
    then component_id is NULL. An empty table gives no rows. Other columns are not read.
    """

    rows = _fingerprinted(docs, text, doc_id, width)
    rooted = _rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), max_bits)
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = materialise(rooted.join(least, "root").select("fp", "component_id"), "known")
    return rows.join(known, "fp").select("doc_id", "fp", "fingerprint", "component_id")


def _fingerprinted(docs: DataFrame, text: str, doc_id: str, width: int, **marks: Column) -> DataFrame:
    """(doc_id, marks, fp, fingerprint), one row per input row; the marks are longs."""
    kept = ["doc_id", *marks]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fingerprints(utf8(batch), width)
        return pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in kept], pa.array(made.astype(np.int64)),
             pa.array([f"{v:016x}" for v in made.tolist()])], [*kept, "fp", "fingerprint"])

    base = boxed(docs, doc_id=number_id(doc_id), **marks, text=field(text).cast("string")).drop("row")
    shape = "".join(f"{k} long, " for k in kept) + "fp long, fingerprint string"
    return materialise(map_batches(base, work, shape), "fingerprints")


def _rooted(classes: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least, root) of the distinct fingerprints ``classes`` (fp, least)."""
    classes = materialise(classes, "classes")
    roots = components(fingerprint_links(classes.select("fp"), max_bits))
    return materialise(classes.join(roots, classes.fp == roots.id, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The columns of ``docs`` for one row of every component: that of its smallest doc_id.

    A row without an id stays only if its component has no id at all. Of rows that share the
    id, or have none, the text's hash decides, so the choice is the same in every run; of rows
    equal in id and text any one stays. Rows of one id whose texts belong to different
    components are judged each in its own.
    """
    # a key without NULLs: the join's partitioning then serves the choice of one row as well
    words, none = field(text).cast("string"), number_id(doc_id).isNull()
    key = {"id": F.coalesce(number_id(doc_id), F.lit(NO_ID)),
           "h1": F.xxhash64(words), "h2": F.xxhash64(none, words)}
    rows = _fingerprinted(docs, text, doc_id, width, **key)
    first = F.struct(F.col("doc_id").isNull().alias("none"), *key)
    rooted = _rooted(rows.groupBy("fp").agg(F.min(first).alias("least")), max_bits)
    stay = materialise(rooted.groupBy("root").agg(F.min("least").alias("least")).select(
        *[f"least.{k}" for k in key]), "stay")
    return boxed(docs, **key).join(stay, [*key], "left_semi").dropDuplicates([*key]).select("row.*")
