"""Phrase collocations by dynamic itemset counting over cyclic shard scans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import boxed, chunks, field, shuffle_partitions
from tallyloom.llm.cutting import Cut
from tallyloom.session import materialise, scratch_path

MAX_WORDS = 3
LEAST = 10
COVER = 50
TOP = 2000

# Shards of the corpus. A phrase may become active after each of them, and is counted from
# there until every shard has been scanned once.
SHARDS = 2

# Slots of the activity table of one length, which is broadcast: a byte each, 16 MB whatever the
# input. Phrases that share a slot only make one another active early; the last pass counts
# what is left by its words.
SLOT_BITS = 24

# Bytes of text for each block of keys, which one task merges; blocks follow the input.
BLOCK_TEXT = 1 << 23
LEAST_BLOCKS = 64

CHUNK_BYTES = 4 << 20

# Parts a language's phrases are dealt to before its best are taken.
TOP_PARTS = 64

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 0x09]] = False
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True

_SPREAD = np.uint64(0x9E3779B97F4A7C15)

COUNTED = "k int, block int, rests binary, counts binary"
SPELLED = "name string, n long"  # phrase, tab, language: no phrase holds a tab


class Words(Cut):
    """The words of some texts of one language."""

    def __init__(self, lang: str, texts: pa.Array):
        super().__init__(texts, _INSIDE & ~_BREAK)
        self.lang = lang
        breaks = np.flatnonzero(_BREAK[self.data] | self.edge[:-1])
        piece = np.searchsorted(breaks, self.starts, "right")
        self.joined = piece[1:] == piece[:-1]  # does the next word stand in the same piece?

    def hashes(self) -> np.ndarray:
        head = self.lang.encode() + b"\t"
        return np.fromiter((xxhash.xxh64_intdigest(head + w) for w in self.names.to_pylist()),
                           np.uint64, len(self.names))


def _extend(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The keys of phrases that are one word longer."""
    return (keys ^ (keys >> np.uint64(31))) * _SPREAD + words


def by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[list[Words]]:
    """The words of every chunk of texts, by language."""
    for table in chunks(batches, CHUNK_BYTES):
        langs, texts = table.column("lang"), table.column("text")
        yield [Words(lang, texts.filter(pc.equal(langs, lang)).combine_chunks())
               for lang in langs.unique().to_pylist()]


def _active(words: Words, since: list[np.ndarray], longest: int) -> Iterator[tuple]:
    """(k, keys, active): for each length the key of the phrase at every place, and the step
    from which it is counted (0: a part of it has not reached the threshold)."""
    mask = np.uint64(len(since[0]) - 1)
    hashes = words.hashes()
    single = hashes[words.codes]
    keys, active = single, np.zeros(len(single), np.uint8)
    yield 1, keys, active
    reached = since[0][hashes & mask][words.codes]
    for k in range(2, longest + 1):
        if len(keys) < 2:
            return
        both = (reached[:-1] > 0) & (reached[1:] > 0)
        if k == 2:
            both &= words.joined
        active = np.where(both, np.maximum(reached[:-1], reached[1:]), 0)
        keys = _extend(keys[:-1], single[k - 1:])
        yield k, keys, active
        if k < longest:
            # a shared slot may be older than the phrase, which was not counted before its time
            reached = since[k - 1][keys & mask]
            reached = np.where((active > 0) & (reached > 0), np.maximum(reached, active), 0)


def _count(since: Broadcast, step: int, shards: int, longest: int, blocks: int, least: int):
    """Sum up what is active in this step: every word in the first cycle, longer phrases for one
    cycle from the step that activates them. Keys are dealt to blocks by their first bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in by_language(batches):
            found: list[list[np.ndarray]] = [[] for _ in range(longest + 1)]
            for words in parts:
                for k, keys, active in _active(words, since.value, longest):
                    if k == 1:
                        found[1].append(keys if step < shards else keys[:0])
                    else:
                        found[k].append(keys[(active > 0) & (step < active.astype(np.int64) + shards)])
            for k in range(1, longest + 1):
                keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found[k]]), return_counts=True)
                bounds = np.searchsorted(keys, _first_keys(blocks))
                yield _block_rows(k, range(blocks), [*bounds.tolist(), len(keys)], keys, n, least)

    return run


def _first_keys(blocks: int) -> np.ndarray:
    """The first key of every block; ``blocks`` is a power of two."""
    return np.arange(blocks, dtype=np.uint64) << np.uint64(64 - (blocks.bit_length() - 1)) if blocks > 1 else (
        np.zeros(1, np.uint64))


def _block_rows(k: int, blocks: Iterable[int], bounds: list[int], keys: np.ndarray, n: np.ndarray,
                least: int) -> pa.RecordBatch:
    """One row a block: the last 32 bits of its keys, and counts, as far as they matter."""
    rests, counts = keys.astype(np.uint32), np.minimum(n, least).astype(_count_type(least))
    rows = [(block, rests[low:high].tobytes(), counts[low:high].tobytes())
            for block, low, high in zip(blocks, bounds, bounds[1:]) if high > low]
    return pa.RecordBatch.from_arrays(
        [pa.array([k] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
         pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
        ["k", "block", "rests", "counts"])


def _count_type(least: int) -> type:
    return np.uint8 if least < 256 else np.uint32


def _merge(least: int, slot_bits: int):
    """Sum up the counts of a block. Keys that reach the threshold leave it as marked slots."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for k, rest, n in zip(*(batch.column(c).to_pylist() for c in ("k", "rests", "counts"))):
                rests, counts = parts.setdefault(k, ([], []))
                rests.append(np.frombuffer(rest, np.uint32))
                counts.append(np.frombuffer(n, _count_type(least)))
        rows = []
        for k, (rests, counts) in parts.items():
            rest, n = np.concatenate(rests), np.concatenate(counts)
            order = np.argsort(rest, kind="stable")
            rest = rest[order]
            first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]][:len(rest)])
            total = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else first
            rest, high = rest[first], total >= least
            slots = np.unique(rest[high] & np.uint32(2**slot_bits - 1)).astype(np.int32)
            rows.append((k, rest[~high].tobytes(), total[~high].astype(_count_type(least)).tobytes(), slots))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()),
             pa.array([key[0].as_py()] * len(rows), pa.int32()),
             pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
             pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
            ["k", "block", "rests", "counts", "slots"])

    return run


def _spell(reached: Broadcast, longest: int):
    """The phrases whose slots have reached the threshold, in words, and the number of all
    words as the empty phrase."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in by_language(batches):
            for words in parts:
                yield _rows(words.lang, pa.array([b""], pa.binary()), [len(words.codes)])
                size = max(1, len(words.names))
                mask = np.uint64(len(reached.value[0]) - 1)
                single = words.hashes()[words.codes]
                keys = single
                ids, spelled = words.codes, words.names
                hit = reached.value[0][single & mask]
                for k in range(1, longest + 1):
                    if k > 1:
                        if len(keys) < 2:
                            break
                        keys = _extend(keys[:-1], single[k - 1:])
                        hit = hit[:-1] & hit[1:] & reached.value[k - 1][keys & mask]
                        if k == 2:
                            hit &= words.joined
                        # one number for the shorter phrase and the word behind it, exact
                        pairs = ids[:-1][hit] * size + words.codes[k - 1:][hit]
                        distinct, number = np.unique(pairs, return_inverse=True)
                        spelled = pc.binary_join_element_wise(
                            spelled.take(pa.array(distinct // size)), words.names.take(pa.array(distinct % size)),
                            pa.scalar(b" ", pa.binary()))
                        ids = np.zeros(len(hit), np.int64)
                        ids[hit] = number
                    n = np.bincount(ids[hit], minlength=len(spelled))
                    some = np.flatnonzero(n)
                    if len(some):
                        yield _rows(words.lang, spelled.take(pa.array(some)), n[some])

    return run


def _rows(lang: str, phrases: pa.Array, n) -> pa.RecordBatch:
    named = pc.binary_join_element_wise(
        phrases, pa.scalar(lang.encode(), pa.binary()), pa.scalar(b"\t", pa.binary()))
    return pa.RecordBatch.from_arrays([named.cast(pa.string()), pa.array(n, pa.int64())], ["name", "n"])


class _Tally:
    """What has been counted so far: per length and block the keys below the threshold, and per
    length a flag for each slot in which a phrase has reached it."""

    def __init__(self, longest: int, least: int, slot_bits: int):
        self.least, self.slot_bits = least, slot_bits
        self.flags = [np.zeros(2**slot_bits, bool) for _ in range(longest)]
        self.held: DataFrame | None = None

    def add(self, counted: DataFrame, lengths: list[int]) -> None:
        """Merge the counts of a step; ``lengths`` are those that it counted."""
        if self.held is not None:
            kept = self.held.where(F.col("k").isin(lengths)).select(*counted.columns)
            counted = counted.unionAll(kept)
        shape = f"{COUNTED}, slots array<int>"
        self.held = materialise(
            counted.groupBy("block").applyInArrow(_merge(self.least, self.slot_bits), shape), "phrase-counts")
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63))
        bits = self.held.select("k", F.explode("slots").alias("slot")).groupBy(
            "k", F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
        marked = bits.toArrow()  # at most 2**slot_bits / 64 rows a length, whatever the input
        k, word, found = (marked.column(c).to_numpy() for c in ("k", "word", "bits"))
        for length, flags in enumerate(self.flags, 1):
            words = np.zeros(max(1, len(flags) // 64), np.int64)
            words[word[k == length]] = found[k == length]
            flags |= np.unpackbits(words.view(np.uint8), bitorder="little")[:len(flags)].astype(bool)


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS,
                  least: int = LEAST, shards: int = SHARDS, slot_bits: int = SLOT_BITS) -> DataFrame:
    """(lang, phrase, n): all phrases of up to ``max_words`` words that occur ``least`` times in
    their language, and the number of its words as the empty phrase.

    The corpus is dealt into shards, which are scanned in turn, again and again. Words are
    counted from the first step. After each step the phrases that have reached the threshold so
    far are marked; a longer phrase becomes active once both its parts (all but the last word,
    all but the first) are marked, is counted from the next shard on, and is complete when all
    shards have passed once. So lengths are interleaved, and the scans end when no phrase is
    inside its cycle. A phrase is counted under a 64-bit key; a last scan counts what reached
    the threshold by its words, so that equal keys leave no trace in the result.

    No step gathers anything but the marks, whose size is fixed. Keys are summed up in every
    task and shuffle as blocks of hash ranges, so a word or phrase with a third of all places is
    a few entries and every block has its share; the number of blocks follows the input.
    """
    spark = docs.sparkSession
    base = boxed(docs, lang=F.coalesce(field(lang).cast("string"), F.lit("und")),
                 text=F.coalesce(field(text).cast("string"), F.lit("")))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    path = scratch_path(spark, "phrase-shards")
    base.select("lang", "text", dealt.alias("shard")).write.partitionBy("shard").parquet(path)
    corpus = spark.read.schema("lang string, text string, shard int").parquet(path)
    size = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 << max(LEAST_BLOCKS - 1, shuffle_partitions(spark) - 1, size // BLOCK_TEXT).bit_length()

    tally = _Tally(max_words, least, slot_bits)
    # since[k]: from which step on the marks of length k + 1 count; last[k]: the newest of those
    since = [np.zeros(2**slot_bits, np.uint8) for _ in range(max(1, max_words - 1))]
    last = [0] * max_words
    step = 0
    while True:
        # a length is counted until a cycle after the last mark of the length below
        lengths = [k for k in range(1, max_words + 1)
                   if (step < shards if k == 1 else 0 < last[k - 2] and step < last[k - 2] + shards)]
        if not lengths:
            break
        shard = corpus.where(F.col("shard") == step % shards).select("lang", "text")
        known = spark.sparkContext.broadcast(since)
        tally.add(shard.mapInArrow(_count(known, step, shards, max_words, blocks, least), COUNTED), lengths)
        known.destroy()
        step += 1
        for k, table in enumerate(since):
            new = tally.flags[k] & (table == 0)
            table[new] = step
            last[k] = step if new.any() else last[k]
    reached = spark.sparkContext.broadcast(tally.flags)
    # Fewer, longer tasks: the more text a task has seen, the fewer rows a phrase is afterwards.
    tasks = max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // 4)
    spelled = corpus.select("lang", "text").coalesce(tasks).mapInArrow(_spell(reached, max_words), SPELLED)
    counts = spelled.groupBy("name").agg(F.sum("n").alias("n")).where(
        (F.col("n") >= least) | F.col("name").startswith("\t"))
    return materialise(counts.select(
        F.expr("substring(name, instr(name, '\t') + 1)").alias("lang"),
        F.substring_index("name", "\t", 1).alias("phrase"), "n"), "phrases")


def mine_collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST,
                      cover: int = COVER, top: int = TOP, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` collocations.

    Texts are lower-cased (A-Z), cut into pieces at marks and line ends and into words at blanks
    and tabs; NULL text is empty, NULL lang is ``und``. A phrase of two words or more that occurs
    at least ``least`` times is a candidate. Its score is floor(1000000 a a / (l r)) for the cut
    that gives the least, where l and r count the parts before and behind the cut; of equal
    scores the first cut counts. A candidate inside a longer one that occurs ``cover`` percent
    as often or more is dropped. Repeated rows count each time; an empty table gives no rows.
    Other input columns are not read. Exact below 10**16 occurrences of a phrase.
    """
    known = count_phrases(docs, max_words=max_words, least=least, **options)
    words = F.split("phrase", " ", -1)
    phrases = known.where("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"))
    candidates = phrases.withColumn("words", words).where(F.size("words") >= 2)
    cuts = candidates.select(
        "lang", "phrase", "a", "words",
        F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _span("words", F.lit(1), F.col("cut")).alias("first"),
        _span("words", F.col("cut") + 1, F.size("words") - F.col("cut")).alias("rest"))
    part = phrases.withColumnRenamed("phrase", "part")
    cuts = cuts.join(part.select("lang", F.col("part").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("part").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(a AS DECIMAL(18,0)) * CAST(a AS DECIMAL(18,0)) * 1000000BD"
                   " div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    longer = (
        candidates.where(F.size("words") >= 3)
        .select("lang", "a", F.explode(_inner_spans("words")).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "least.l", "least.r", "least.score")
    totals = known.where("phrase = ''").select("lang", "n")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))
    rows = rows.withColumn("share", share).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _span(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.col(words), start, length), " ")


def _inner_spans(words: str) -> Column:
    """All shorter runs of two words or more."""
    sizes = F.sequence(F.lit(2), F.size(words) - 1)
    return F.flatten(F.transform(sizes, lambda size: F.transform(
        F.sequence(F.lit(1), F.size(words) - size + 1),
        lambda at: F.array_join(F.slice(F.col(words), at, size), " "))))
