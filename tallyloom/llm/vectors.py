"""Embedding near-dedup: sorted projection passes, windows, blocks for long runs, exact links per component."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import boxed, field, number_id, shuffle_partitions
from tallyloom.llm.graph import components
from tallyloom.llm.simhash import _joined
from tallyloom.session import materialise

THRESHOLD = 0.93
WINDOW = 48          # neighbours compared with each vector of a pass
BITS = 62            # random hashes concatenated into a sort key
MISS = 0.001         # share of links at the threshold that all passes may miss
BLOCK = 256          # vectors of a component compared with each other at once
RUN_BLOCK = 2048     # vectors of a long run compared with each other at once
STRIP = 512          # rows of such a comparison held at once
SEED = 7


def depth_for(rows: int, window: int = WINDOW) -> int:
    """Leading hash bits that cut ``rows`` vectors of even spread into runs below the window."""
    return min(BITS, max(1, ceil(log2(max(2, rows / window))) + 1))


def passes_for(rows: int, threshold: float = THRESHOLD, window: int = WINDOW,
               miss: float = MISS) -> int:
    """Passes that leave at most ``miss`` of the links between vectors at the threshold.

    Two vectors at cosine t agree on one hash with probability p = 1 - acos(t) / pi, however
    the other vectors lie. In a pass they are compared if they agree on all leading bits, so a
    pass fails with 1 - p ** depth.
    """
    found = (1 - acos(threshold) / pi) ** depth_for(rows, window)
    return max(4, ceil(log(miss) / log(1 - found)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares cannot overflow."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def vector_links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                 label: str = "label", threshold: float = THRESHOLD,
                 window: int = WINDOW, block: int = RUN_BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors of the same label and dimension link at a cosine of ``threshold`` or more, in
    double precision. Vectors that are NULL, empty or zero, hold NULL or non-finite numbers,
    or have a NULL label or id link with nothing: no links, their own component, kept.
    Identical rows and vectors link like any others. An empty table gives no rows. Other
    columns are not read.

    Equal vectors are one class. In every pass the classes of a label are ordered by random hash
    bits, and each is compared with its next ``window`` neighbours; a task hands on one edge per
    linked class, not the pairs. Runs of classes that share all leading bits and are longer than
    the window, as vectors with a common direction make them, are compared block against block.
    So two vectors that agree on the leading bits of any pass are compared, wherever the others
    lie and however many tasks there are, and the chance that a link at the threshold is missed
    in all passes is below ``MISS``. Components of the verified links are then compared within
    themselves, block by block, which counts links that no pass holds.
    """
    numbers = field(embedding).cast("array<double>")
    proper = (F.size(numbers) > 0) & ~F.exists(
        numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ) & F.exists(numbers, lambda x: x != 0)
    sound = F.coalesce(proper, F.lit(False)) & field(label).isNotNull() & field(vec_id).isNotNull()
    base = boxed(vectors, vec_id=number_id(vec_id), x=numbers, label=field(label).cast("string"),
                 sound=sound).drop("row")
    # 128 bits stand for the vector wherever only its identity matters
    marked = base.withColumns({
        "dim": F.when(F.col("sound"), F.size("x")), "h1": F.xxhash64("x"),
        "h2": F.xxhash64(F.lit(1), F.col("x"))})
    same = ["label", "dim", "h1", "h2"]
    classes = materialise(
        marked.where("sound").groupBy(*same).agg(
            F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x")),
        "classes")
    sizes = materialise(classes.groupBy("label", "dim").agg(F.count("*").alias("rows")), "sizes")
    edges = _pass_edges(classes.join(sizes, ["label", "dim"]), threshold, window, block)
    roots = materialise(components(edges), "roots")
    counted = materialise(_component_links(classes, roots, threshold), "links")
    per_class = materialise(
        classes.join(counted, "rep", "left").join(roots, F.col("rep") == F.col("id"), "left").select(
            *same, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "rep").alias("component_id")), "per_class")
    met = marked.drop("x").join(per_class, same, "left")
    component = F.coalesce("component_id", "vec_id")
    return met.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))


RUN = ["pass", "label", "dim", "prefix"]
KEYS = "pass int, label string, dim int, prefix long, code long, rep long"


def _coded(classes: DataFrame, threshold: float, window: int, with_x: bool) -> DataFrame:
    """Every class once for each pass of its label: the hash bits as one number, and those
    leading ones that make it a run."""

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple, np.ndarray] = {}
        for batch in batches:
            kinds = list(zip(batch.column("dim").to_pylist(), batch.column("rows").to_pylist()))
            for dim, rows in set(kinds):
                part = batch.filter(pa.array([kind == (dim, rows) for kind in kinds], pa.bool_()))
                x, depth = matrix(part.column("x"), dim), depth_for(rows, window)
                for p in range(passes_for(rows, threshold, window)):
                    if (dim, p) not in planes:
                        planes[dim, p] = np.random.default_rng([SEED, dim, p]).standard_normal((dim, BITS))
                    codes = (x @ planes[dim, p] > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    columns = [pa.array([p] * part.num_rows, pa.int32()), part.column("label"),
                               part.column("dim"), pa.array(codes >> (BITS - depth)), pa.array(codes),
                               part.column("rep")]
                    names = ["pass", "label", "dim", "prefix", "code", "rep"]
                    if with_x:
                        columns, names = [*columns, part.column("x")], [*names, "x"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    needed = classes.select("label", "dim", "rep", "x", "rows")
    return needed.mapInArrow(code, KEYS + ", x array<double>" * with_x)


def _pass_edges(classes: DataFrame, threshold: float, window: int, block: int) -> DataFrame:
    """Edges (a, b) of verified links between class representatives, one chain per group."""
    long_runs = materialise(
        _coded(classes, threshold, window, False).groupBy(*RUN).agg(F.count("*").alias("length"))
        .where(F.col("length") > window + 1), "long-runs")
    full = _coded(classes, threshold, window, True)
    short = full.join(long_runs.select(*RUN), RUN, "left_anti")
    edges = _window_edges(short, threshold, window)
    if long_runs.isEmpty():
        return edges
    return edges.unionAll(_block_edges(full.join(long_runs, RUN), threshold, block))


def _window_edges(coded: DataFrame, threshold: float, window: int) -> DataFrame:
    """Each vector against its next ``window`` neighbours in the order of the codes of its run."""

    def slide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains = Chains()
        for (_, _, dim, _), table in _groups(batches, RUN):
            x, ids = matrix(table.column("x").combine_chunks(), dim), table.column("rep").to_numpy()
            for offset in range(1, min(window, len(ids) - 1) + 1):
                near = np.flatnonzero(np.einsum("ij,ij->i", x[:-offset], x[offset:]) >= threshold)
                for i in near.tolist():
                    chains.join(int(ids[i]), int(ids[i + offset]))
        a, b = chains.edges()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                             ["a", "b"])

    return coded.repartition(shuffle_partitions(coded.sparkSession), *RUN).sortWithinPartitions(
        *RUN, "code", "rep").mapInArrow(slide, "a long, b long")


def _block_edges(coded: DataFrame, threshold: float, block: int) -> DataFrame:
    """Edges that join all linked classes of a long run, by every two of its blocks."""
    blocks = F.ceil(F.col("length") / block).cast("int")
    keys = [*RUN, "i", "j"]
    own = coded.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        *RUN, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "x")
    dealt = pairs.repartition(shuffle_partitions(coded.sparkSession), *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, dim, _, _, _), table in _groups(batches, keys):
            x, ids = matrix(table.column("x").combine_chunks(), dim), table.column("rep").to_numpy()
            chain = np.arange(len(ids))
            for at in range(0, len(ids), STRIP):
                a, b = np.nonzero(x[at:at + STRIP] @ x[at:].T >= threshold)
                chain = _joined(chain, [(a[a < b] + at, b[a < b] + at)])
            moved = np.flatnonzero(chain != np.arange(len(ids)))
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[moved]), pa.array(ids[chain[moved]])], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


class Chains:
    """Union-find over the linked ids of one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        root = x
        while self.up.get(root, root) != root:
            root = self.up[root]
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> tuple[list[int], list[int]]:
        ids = list(self.up)
        return ids, [self.top(x) for x in ids]


def _component_links(classes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(rep, others): vectors of other classes of its component that each class links with.

    A component of n classes is split into ceil(n / BLOCK) blocks, and pairs of blocks are the
    unit of work: a large component spreads over many tasks, and none holds more than two
    blocks of it.
    """
    # the root of a component has no row of its own in ``roots``
    member = materialise(roots.select(F.col("id").alias("rep"), "root").unionAll(
        roots.select(F.col("root").alias("rep"), "root").distinct()), "members")
    sizes = materialise(member.groupBy("root").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    placed = member.join(sizes, "root").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    full = placed.join(classes.select("rep", "copies", "dim", "x"), "rep")
    pairs = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "rep", "copies", "dim", "x")
    keys = ["root", "i", "j"]
    sorted_pairs = pairs.repartition(
        shuffle_partitions(classes.sparkSession), *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), table in _groups(batches, keys):
            dim = table.column("dim")[0].as_py()
            x = matrix(table.column("x").combine_chunks(), dim)
            copies, block = table.column("copies").to_numpy(), table.column("block").to_numpy()
            linked = x @ x.T >= threshold
            if i == j:
                np.fill_diagonal(linked, False)
            else:
                linked &= block[:, None] != block[None, :]
            yield pa.RecordBatch.from_arrays(
                [table.column("rep").combine_chunks(), pa.array(linked @ copies)], ["rep", "others"])

    return sorted_pairs.mapInArrow(compare, "rep long, others long").groupBy("rep").agg(
        F.sum("others").alias("others"))


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple]:
    """Runs of equal keys of a sorted partition, as tables."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        found = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        starts = [i for i, k in enumerate(found) if not i or k != found[i - 1]]
        for low, high in zip(starts, [*starts[1:], len(found)]):
            if held and found[low] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = found[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield current, pa.Table.from_batches(held)
