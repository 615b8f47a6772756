"""Ranked lexical search with posting lists in blocks of similar documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import boxed, chunks, field, number_id
from tallyloom.llm.cutting import Cut
from tallyloom.llm.transducer import spread
from tallyloom.session import materialise

TOP = 20

# Distinct terms of the items searched together, which bounds what is broadcast and what a
# document can weigh in a shard; more items are searched in further blocks.
BLOCK_TERMS = 1 << 16

# Documents and postings of one shard, on average: what one task indexes and searches.
SHARD_DOCS = 4096
SHARD_POSTINGS = 1 << 19

# One shard in so many is searched first; its scores say what the others may skip.
SEED = 16

# Documents of one block of a posting list, on average, and the axes of the sketches by which
# documents are told to be similar.
LIST_BLOCK = 32
SKETCH = 32

CHUNK_BYTES = 4 << 20

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

FORWARD = "rid long, doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item long, rid long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return _TERM.findall((text or "").encode().lower())


def forward_rows(docs: DataFrame, asked: list[bytes], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rid, doc_id, n, terms, tfs) of every document that has a term: the number of its terms,
    and which of the asked terms it holds how often."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(asked, pa.binary())
        for table in chunks(batches, CHUNK_BYTES):
            cut = Cut(table.column("text").combine_chunks().fill_null(""), _INSIDE)
            owner = cut.owners()
            sizes = np.bincount(owner, minlength=len(table))
            known = pc.fill_null(pc.index_in(cut.names, value_set=wanted), -1).to_numpy()[cut.codes]
            hits = known >= 0
            pairs, tf = np.unique(owner[hits] * len(asked) + known[hits], return_counts=True)
            held = np.bincount(pairs // max(1, len(asked)), minlength=len(table))
            bounds = pa.array(np.r_[0, np.cumsum(held)], pa.int32())
            made = pa.RecordBatch.from_arrays(
                [*(table.column(c).combine_chunks() for c in ("rid", "doc_id")), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(bounds, pa.array(pairs % max(1, len(asked)), pa.int32())),
                 pa.ListArray.from_arrays(bounds, pa.array(tf, pa.int32()))],
                ["rid", "doc_id", "n", "terms", "tfs"])
            yield made.filter(pa.array(sizes > 0))

    base = boxed(docs, doc_id=number_id(doc_id), text=field(text).cast("string"))
    return base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, FORWARD)


class ShardIndex:
    """The documents of a shard by row and by term; posting lists are cut into blocks of similar
    documents when a query first needs them."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, gains: np.ndarray, n_terms: int):
        self.starts, self.sizes = np.r_[0, ends[:-1]], np.diff(np.r_[0, ends])
        self.terms, self.gains, self.n_terms = terms, gains, n_terms
        owner = np.repeat(np.arange(len(ends)), self.sizes)
        order = np.argsort(terms, kind="stable")
        self.list_docs = owner[order]
        counts = np.bincount(terms, minlength=n_terms)
        self.list_ends = np.cumsum(counts)
        self.list_sizes = counts
        self.most = np.zeros(n_terms, np.int64)  # the largest gain of each term
        held = np.flatnonzero(counts)
        if len(held):
            self.most[held] = np.maximum.reduceat(gains[order], (self.list_ends - counts)[held])
        self.sketch = self._sketches()
        self.blocks: dict[int, tuple] = {}

    def _sketches(self) -> np.ndarray:
        """Random projections of the documents, of length one."""
        axes = np.random.default_rng(12).standard_normal((self.n_terms, SKETCH)).astype(np.float32)
        made = np.zeros((len(self.sizes), SKETCH), np.float32)
        some = np.flatnonzero(self.sizes)
        if len(some):
            weighted = axes[self.terms] * self.gains[:, None].astype(np.float32)
            made[some] = np.add.reduceat(weighted, self.starts[some])
        return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-30)

    def block_list(self, term: int) -> tuple:
        """(docs, block ends, summary terms, summary gains, summary starts) of a posting list.

        Documents go to the most similar of some documents of the list, spread over it. The
        summary of a block is the largest gain of every term in it.
        """
        if term not in self.blocks:
            end = self.list_ends[term]
            docs = self.list_docs[end - self.list_sizes[term]:end]
            label = np.zeros(len(docs), np.int64)
            if len(docs) > LIST_BLOCK:
                points = self.sketch[docs]
                centres = points[::LIST_BLOCK]
                label = np.argmax(points @ centres.T, axis=1)
            order = np.argsort(label, kind="stable")
            docs, label = docs[order], label[order]
            label = np.r_[0, np.cumsum(label[1:] != label[:-1])]
            at = spread(self.starts[docs], self.sizes[docs])
            key = np.repeat(label, self.sizes[docs]) * self.n_terms + self.terms[at]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            most = np.maximum.reduceat(self.gains[at][order], first)
            block, covered = np.divmod(key[first], self.n_terms)
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = np.cumsum(np.bincount(label))
            self.blocks[term] = docs, ends, covered.astype(np.int32), most, starts
        return self.blocks[term]

    def search(self, terms: np.ndarray, times: np.ndarray, floor: int, top: int
               ) -> tuple[np.ndarray, np.ndarray]:
        """(docs, scores) of all documents that can be among the ``top`` best and reach ``floor``.

        Lists are taken from the heaviest term on, until the rest together cannot reach the
        least score that still counts. Of a list, the blocks whose summary can reach it are
        scored, the most promising first; a skipped block holds no document that counts.
        """
        weight = np.zeros(self.n_terms, np.int64)
        weight[terms] = times
        heavy = times * self.most[terms]
        order = np.argsort(-heavy, kind="stable")
        rest = np.cumsum(heavy[order][::-1])[::-1]  # what a list and all lighter ones can give
        seen = np.zeros(len(self.sizes), bool)
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for term, reach in zip(terms[order].tolist(), rest.tolist()):
            if reach < floor or not self.list_sizes[term]:
                break
            listed, ends, covered, most, starts = self.block_list(term)
            bounds = np.add.reduceat(weight[covered] * most, starts)
            sizes = np.diff(np.r_[0, ends])
            by_bound = np.argsort(-bounds, kind="stable")
            first = int(np.searchsorted(np.cumsum(sizes[by_bound]), top)) + 1
            for blocks in (by_bound[:first], by_bound[first:]):
                blocks = blocks[bounds[blocks] >= floor]
                new = listed[spread((ends - sizes)[blocks], sizes[blocks])]
                new = new[~seen[new]]
                if not len(new):
                    continue
                seen[new] = True
                at = spread(self.starts[new], self.sizes[new])
                made = np.add.reduceat(weight[self.terms[at]] * self.gains[at],
                                       np.cumsum(self.sizes[new]) - self.sizes[new])
                docs, scores = np.r_[docs, new], np.r_[scores, made]
                if len(scores) >= top:
                    floor = max(floor, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
                    keep = scores >= floor
                    docs, scores = docs[keep], scores[keep]
        keep = scores >= floor
        return docs[keep], scores[keep]


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _search_shard(queries: list[tuple], weights: np.ndarray, n_docs: int, n_words: int,
                  floors: np.ndarray, top: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists, n = table.column("terms").combine_chunks(), table.column("n").to_numpy()
        terms = lists.flatten().to_numpy()
        tf = table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        length = 75 + 25 * n * n_docs // n_words
        gains = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(length, sizes)))
        owner = np.repeat(np.arange(len(sizes)), sizes)[gains > 0]
        ends = np.cumsum(np.bincount(owner, minlength=len(sizes)))
        index = ShardIndex(ends, terms[gains > 0].astype(np.int64), gains[gains > 0], len(weights))
        rid = table.column("rid").to_numpy()
        ids = table.column("doc_id")
        # equal scores go by doc_id, no id last, then by row
        place = np.empty(len(rid), np.int64)
        place[pc.sort_indices(pa.table({"doc_id": ids, "rid": rid}), sort_keys=[
            ("doc_id", "ascending"), ("rid", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(rid))
        item, doc, score = [], [], []
        for at, (number, asked, times) in enumerate(queries):
            docs, scores = index.search(asked, times, max(1, int(floors[at])), top)
            best = np.lexsort((place[docs], -scores))[:top]
            item.append(np.full(len(best), number))
            doc.append(docs[best])
            score.append(scores[best])
        doc = np.concatenate([np.empty(0, np.int64), *doc])
        return pa.table({
            "item": pa.array(np.concatenate([np.empty(0, np.int64), *item])), "rid": pa.array(rid[doc]),
            "doc_id": ids.take(pa.array(doc)), "score": pa.array(np.concatenate([np.empty(0, np.int64), *score]))})

    return run


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, items: list[tuple], top: int, **columns) -> DataFrame:
    """(item, rank, doc_id, score) for the items of one block, by their numbers."""
    asked = sorted({term for _, terms in items for term in terms})
    number = {term: i for i, term in enumerate(asked)}
    queries = [(item, np.array([number[t] for t in terms], np.int64), np.array(list(terms.values()), np.int64))
               for item, terms in items]
    rows = materialise(forward_rows(docs, asked, **columns), "forward")
    total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("l"), F.sum(F.size("terms")).alias("p"),
                     F.count(F.when(F.size("terms") > 0, 1)).alias("d")).first()
    df = np.zeros(len(asked), np.int64)
    for row in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one per asked term
        df[row["t"]] = row["count"]
    weights = term_weights(df, total["n"])
    shards = max(1, -(-total["d"] // SHARD_DOCS), -(-(total["p"] or 0) // SHARD_POSTINGS))
    dealt = rows.where(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)))

    def search(part: DataFrame, floors: np.ndarray) -> DataFrame:
        work = _search_shard(queries, weights, total["n"], total["l"] or 1, floors, top)
        return part.groupBy("shard").applyInArrow(work, FOUND)

    floors = np.ones(len(queries), np.int64)
    seeds = -(-shards // SEED)
    first = materialise(search(dealt.where(F.col("shard") < seeds), floors), "seeds")
    place = {item: i for i, (item, _, _) in enumerate(queries)}
    for row in _best(first, top).where(F.col("rank") == top).select("item", "score").collect():
        floors[place[row["item"]]] = row["score"]
    found = first.unionAll(search(dealt.where(F.col("shard") >= seeds), floors))
    return _best(found, top).select("item", "rank", "doc_id", "score")


def _blocks(items: DataFrame, text: str, limit: int) -> Iterator[list[tuple]]:
    """Items by number with their terms, as many at a time as ask for ``limit`` terms."""
    held, asked = [], set()
    for row in items.select("item", text).toLocalIterator():
        terms = Counter(terms_of(row[1]))
        if held and len(asked | terms.keys()) > limit:
            yield held
            held, asked = [], set()
        held.append((row[0], terms))
        asked |= terms.keys()
    if held:
        yield held


def search_documents(docs: DataFrame, items: DataFrame, top: int = TOP, item_id: str = "item_id",
                     item_text: str = "text", block_terms: int = BLOCK_TERMS, **columns) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``top`` documents of the highest score.

    Terms are runs of digits, letters A-Z (lower-cased) and characters beyond ASCII, in whole
    texts; NULL text has none. Scores are whole numbers: a term's weight times its occurrences,
    damped by the length of the document, summed over the item's terms with repeats. Equal
    scores go by doc_id, no id last; repeated rows are documents of their own, repeated items
    are answered one by one. Items and documents without a term have no rows.

    Items are read in blocks of at most ``block_terms`` distinct terms (an item with more is a
    block by itself). For a block the documents are reduced to the asked terms they hold and
    dealt at random into shards of bounded size. Every task indexes a shard: the posting list
    of a term is clustered into blocks of similar documents, each with the largest gain of every
    term as its summary, and a block is scored unless its summary shows that nothing in it can
    be among the best. The scores of the first shards are a floor for all others, so those
    return little more than what is asked for. All documents are indexed; nothing is estimated.
    """
    numbered = materialise(boxed(items, item_id=field(item_id), text=field(item_text).cast("string")).select(
        "item_id", "text", F.monotonically_increasing_id().alias("item")), "items")
    found = [_search_block(docs, block, top, **columns) for block in _blocks(numbered, "text", block_terms)]
    if not found:
        return numbered.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                               F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionAll, found).join(numbered.select("item", "item_id"), "item").select(
        "item_id", "rank", "doc_id", "score")
