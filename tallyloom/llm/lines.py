"""Line dedup: Bloom filters of keys seen once and twice, exact confirmation of suspects."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import (
    BLANKS, NO_ID, boxed, field, map_batches, number_id, utf8, with_row)
from tallyloom.llm.mixing import field_of
from tallyloom.session import materialise

MIN_KEY = 10

# Bits of each filter: about sixteen for a line of forty bytes, up to 2**FILTER_BITS. The
# twice-seen filter is broadcast, 64 MB at most. A fuller filter (beyond about 100 million
# distinct lines) only makes more lines suspects, it never changes a result.
LEAST_BITS = 22
FILTER_BITS = 29
LINE_BYTES = 40


def bits_for(size: int, most: int = FILTER_BITS) -> int:
    """Filter bits for so many bytes of text."""
    return min(most, max(LEAST_BITS, (16 * size // LINE_BYTES).bit_length()))


BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS

# Filter positions a task gathers before it sorts them into those it has seen.
MERGE_AT = 1 << 20


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None if it is too short to count."""
    key = line.strip(BLANKS).lower()
    if len(key) < MIN_KEY or (len(key) < 4 * MIN_KEY and len(key.decode()) < MIN_KEY):
        return None
    return key


def line_keys(text: bytes) -> list[bytes | None]:
    return [line_key(line) for line in text.split(b"\n")]


def positions(keys: Iterable[bytes], bits: int) -> np.ndarray:
    """Two filter positions per key, one row each."""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)
    mask = np.uint64(2**bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask]).astype(np.int64)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                filter_bits: int | None = None) -> DataFrame:
    """(row, doc_id, text, n_lines, n_dropped), one row per input row.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of at least ten
    code points that stand in two or more documents lose their lines everywhere except in the
    smallest doc_id that holds them; repeats inside one document stay. NULL or empty text is
    one empty line. Rows that share a doc_id are one document; NULL ids are one document
    that sorts last. An empty table gives no rows. Columns of any name travel in ``row``.

    Pass one: every task sends the filter positions of its documents' keys, marked once or
    twice seen, as sparse blocks; merged, they leave the twice-seen filter, which is broadcast
    and of bounded size. Pass two: only lines it knows (suspects) shuffle, as 16-byte hashes,
    and are confirmed exactly. Pass three: documents without a suspect go straight through;
    the others meet their own list of lines to drop. Lists go by id and text, so that rows
    without an id, however many, share none.
    """
    base = boxed(docs, id=F.coalesce(number_id(doc_id), F.lit(NO_ID)),
                 version=F.xxhash64(field(text).cast("string")),
                 doc_id=number_id(doc_id), text=field(text).cast("string"))
    # rows of one id drop the same keys, so equal versions of different texts do no harm
    document = ["id", "version"]
    if filter_bits is None:
        filter_bits = bits_for(base.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    twice = _twice_seen(base, filter_bits)
    suspects = materialise(
        map_batches(base.select(*document, "text"), _suspects(twice, filter_bits),
                    "id long, version long, key binary"),
        "suspects")
    repeated = materialise(
        suspects.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last").select("key", "first"), "repeated")
    drops = materialise(
        suspects.join(repeated, "key").where("id > first")
        .groupBy(*document).agg(F.collect_set("key").alias("keys")), "drops")
    shape = with_row(base, "doc_id long, text string, n_lines long, n_dropped long")
    whole = with_row(base, "id long, version long, doc_id long, text string")
    clean = map_batches(base, _pass_clean(twice, filter_bits), shape)
    dirty = map_batches(base, _only_suspect(twice, filter_bits), whole).join(drops, document, "left")
    return clean.unionAll(map_batches(dirty, _drop, shape))


def deduped_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` with repeated lines gone; ``n_chars`` follows the new text."""
    made, name = dedup_lines(docs, **options), options.get("text", "text")
    types = dict(docs.dtypes)
    cut = F.col("n_dropped") > 0
    changed = {name: F.when(cut, F.col("text")).otherwise(field_of(name)),
               "n_chars": F.when(cut, F.length("text")).otherwise(field_of("n_chars"))}
    return made.select(*[
        (changed[c].cast(types[c]) if c in changed else field_of(c)).alias(c) for c in docs.columns])


def _twice_seen(base: DataFrame, bits: int) -> Broadcast:
    """The bits set by at least two documents, as one broadcast array of 2**bits / 8 bytes."""

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.empty(0, np.int64), np.empty(0, np.int64)
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            # one entry per document and position: a count of two means two documents
            seen, counts = np.unique(np.concatenate([once, *held]), return_counts=True)
            return seen, np.union1d(twice, seen[counts > 1])

        for batch in batches:
            own = [np.unique(positions({k for k in line_keys(t) if k is not None}, bits))
                   for t in utf8(batch)]
            held += own
            size += sum(map(len, own))
            # as much again as is there already, so that every position is sorted a few times
            if size >= max(MERGE_AT, len(once)):
                once, twice = merged()
                held, size = [], 0
        once, twice = merged()
        if not len(once):
            return
        blocks, starts = np.unique(once >> BLOCK_BITS, return_index=True)
        again = np.isin(once, twice, assume_unique=True)
        for block, low, high in zip(blocks, starts, [*starts[1:], len(once)]):
            inside = (once[low:high] & (BLOCK - 1)).astype(np.uint16)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int32()),
                "once": pa.array([inside.tobytes()], pa.binary()),
                "twice": pa.array([inside[again[low:high]].tobytes()], pa.binary())})

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
        for part in parts:
            for o, t in zip(part.column("once").to_pylist(), part.column("twice").to_pylist()):
                o, t = np.frombuffer(o, np.uint16), np.frombuffer(t, np.uint16)
                twice[o[once[o]]] = True
                twice[t] = True
                once[o] = True
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([key[0].as_py()], pa.int32()),
            "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    parts = base.select("id", "text").mapInArrow(collect, "block int, once binary, twice binary")
    merged = parts.groupBy("block").applyInArrow(merge, "block int, bits binary")
    whole = np.zeros(2**bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # a fixed number of blocks: 2**bits / 8 bytes in all
        start = row["block"] * BLOCK // 8
        whole[start:start + BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return base.sparkSession.sparkContext.broadcast(whole)


def _hits(text: bytes, twice: np.ndarray, bits: int) -> list[bytes]:
    """The distinct keys of a document that the filter takes for repeated."""
    keys = [k for k in dict.fromkeys(line_keys(text)) if k is not None]
    if not keys:
        return []
    at = positions(keys, bits)
    known = (twice[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return [k for k, hit in zip(keys, known.all(axis=0)) if hit]


def _suspects(twice: Broadcast, bits: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, keys = [], []
        for row, text in enumerate(utf8(batch)):
            found = _hits(text, twice.value, bits)
            keys += [xxhash.xxh3_128_digest(k) for k in found]
            rows += [row] * len(found)
        owner = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(owner), batch.column("version").take(owner),
             pa.array(keys, pa.binary())], ["id", "version", "key"])

    return work


def _marks(batch: pa.RecordBatch, twice: Broadcast, bits: int) -> list[bool]:
    return [bool(_hits(text, twice.value, bits)) for text in utf8(batch)]


def _only_suspect(twice: Broadcast, bits: int):
    return lambda batch: batch.filter(pa.array(_marks(batch, twice, bits), pa.bool_()))


def _pass_clean(twice: Broadcast, bits: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array([not m for m in _marks(batch, twice, bits)], pa.bool_()))
        texts = utf8(batch)
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()),
             pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()),
             pa.array([0] * len(texts), pa.int64())],
            ["row", "doc_id", "text", "n_lines", "n_dropped"])

    return work


def _drop(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, n_lines, n_dropped = [], [], []
    for text, keys in zip(utf8(batch), batch.column("keys").to_pylist()):
        lines, drop = text.split(b"\n"), set(keys or ())
        kept = lines if not drop else [
            line for line, key in zip(lines, map(line_key, lines))
            if key is None or xxhash.xxh3_128_digest(key) not in drop]
        texts.append(b"\n".join(kept))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
    return pa.RecordBatch.from_arrays(
        [batch.column("row"), batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()),
         pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
        ["row", "doc_id", "text", "n_lines", "n_dropped"])
