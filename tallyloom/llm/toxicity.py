"""Toxicity: a linear-chain conditional random field over words, document scores, offsets."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field as dataclass_field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import (
    boxed, field, map_batches, number_id, strings, with_row, worker_cache)

TOKEN = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7

# Bounds of what the model is fitted on: documents of each label, and the longest of them.
SAMPLE_TOXIC = 1000
SAMPLE_CLEAN = 2000
SAMPLE_CHARS = 50_000

# A word's feature marks toxic tokens if its odds in toxic documents are surely (by this many
# standard errors) this many times those in clean ones.
SURE = 1.64
ODDS = 8.0

STEPS = 40
RATE = 0.3
SHRINK = 0.002
BLOCK = 128           # words of a block of the forward-backward scan
CHUNK_CHARS = 1 << 21
CACHE_WORDS = 300_000
LIMIT = 30.0          # largest emission, so that odds stay finite


def features(word: str) -> list[int]:
    """Hashes of a lower-cased word and its beginnings; 0 where it is too short for one."""
    digest = xxhash.xxh3_64_intdigest
    return [digest(word), *[digest(f"{word[:n]}*") if len(word) >= n else 0 for n in PREFIXES]]


@dataclass
class Tagger:
    """Weights for the toxic state (the clean state's are zero), and the chain's factors."""

    weights: dict[int, float] = dataclass_field(default_factory=dict)
    bias: float = -LIMIT
    start: float = 1.0                    # odds of a toxic first word
    steps: tuple = ((1.0, 1.0), (1.0, 1.0))  # factor of each pair of neighbouring states

    def emission(self, word: str) -> float:
        total = self.bias + sum(self.weights.get(f, 0.0) for f in features(word.lower()))
        return min(LIMIT, max(-LIMIT, total))


def forward(x: np.ndarray, fresh: np.ndarray, start: float, steps: np.ndarray) -> np.ndarray:
    """Odds of the toxic state at every word, given the words of its chain so far.

    ``x`` holds each word's emission odds, ``fresh`` marks the first word of a chain. Two
    states make each word a 2x2 matrix: blocks are multiplied out side by side, the products
    are chained once per block, and a second run side by side fills the words in. Exact for
    chains of any length; the loops have BLOCK and n / BLOCK rounds.
    """
    n = len(x)
    width = -(-n // BLOCK)
    pad = width * BLOCK - n
    x = np.r_[x, np.ones(pad)].reshape(width, BLOCK)
    fresh = np.r_[fresh, np.ones(pad, bool)].reshape(width, BLOCK)
    (a00, a01), (a10, a11) = steps
    p, q, r, s = np.ones(width), np.zeros(width), np.zeros(width), np.ones(width)
    for t in range(BLOCK):  # [[p, q], [r, s]] carries (clean, toxic) from block start to word t
        f, e = fresh[:, t], x[:, t]
        p, q, r, s = (np.where(f, p + r, a00 * p + a10 * r), np.where(f, q + s, a00 * q + a10 * s),
                      e * np.where(f, start * (p + r), a01 * p + a11 * r),
                      e * np.where(f, start * (q + s), a01 * q + a11 * s))
        size = p + q + r + s
        p, q, r, s = p / size, q / size, r / size, s / size
    before, odds = np.empty(width), 1.0
    for i, (pi, qi, ri, si) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        before[i] = odds
        odds = (ri + si * odds) / (pi + qi * odds)
    out, odds = np.empty((width, BLOCK)), before
    for t in range(BLOCK):
        odds = x[:, t] * np.where(fresh[:, t], start, (a01 + a11 * odds) / (a00 + a10 * odds))
        out[:, t] = odds
    return out.ravel()[:n]


def marginals(emissions: np.ndarray, starts: np.ndarray, tagger: Tagger) -> tuple:
    """(odds before, odds after, p): forward odds, backward odds and marginals of each word."""
    x, steps = np.exp(emissions), np.array(tagger.steps)
    first = np.zeros(len(x), bool)
    first[starts] = True
    last = np.r_[first[1:], True]
    ahead = forward(x, first, tagger.start, steps)
    behind = forward(x[::-1], last[::-1], 1.0, steps.T)[::-1] / x
    both = ahead * behind
    return ahead, behind, both / (1 + both)


def fit(texts: list[tuple[str, int]]) -> Tagger:
    """Train on whole documents with a toxic flag, all in bounded memory.

    Near copies count once (same smallest hash of a three-word run). A token is labelled
    toxic if its document is and one of its features is surely more common in toxic
    documents; the chain then learns from those token labels by gradient steps (Adam).
    Without documents of both kinds, or without such a feature, nothing is toxic.
    """
    seen, docs, known = set(), [], {}
    for text, toxic in texts:
        words = [w.lower() for w in TOKEN.findall(text)]
        if not words:
            continue
        sketch = min(xxhash.xxh3_64_intdigest(" ".join(words[i:i + 3]))
                     for i in range(max(1, len(words) - 2)))
        if sketch not in seen:
            seen.add(sketch)
            docs.append((np.array([known.setdefault(w, len(known)) for w in words]), int(toxic)))
    sizes = [sum(t == kind for _, t in docs) for kind in (0, 1)]
    if not sizes[0] or not sizes[1]:
        return Tagger()
    hashes, table = np.unique(np.array([features(w) for w in known], np.uint64), return_inverse=True)
    table = table.reshape(-1, 1 + len(PREFIXES))
    del known
    held = np.zeros((2, len(hashes)))
    for words, toxic in docs:
        held[toxic, np.unique(table[np.unique(words)])] += 1
    a, b = held[1] + 0.5, held[0] + 0.5
    c, d = sizes[1] + 1 - a, sizes[0] + 1 - b
    surely = np.log(a * d / (b * c)) - SURE * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    lexicon = (surely > np.log(ODDS)) & (held[1] > 1) & (hashes > 0)
    if not lexicon.any():
        return Tagger()
    marked = lexicon[table].any(axis=1)
    common = ((held.sum(axis=0) > 2) | lexicon) & (hashes > 0)
    none = int(common.sum())
    table = np.where(common, np.cumsum(common) - 1, none)[table]
    hashes = hashes[common]
    tokens = [t for t, _ in docs]

    word = np.concatenate(tokens)
    lengths = np.array([len(t) for t in tokens])
    starts = np.cumsum(np.r_[0, lengths[:-1]])
    label = marked[word] & np.repeat(np.array([t for _, t in docs], bool), lengths)
    inner = np.ones(len(word), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    pair = 2 * label[inner - 1] + label[inner]
    wanted = np.bincount(pair, minlength=4)

    theta = np.zeros(none + 1 + 6)  # features, bias, start, four steps
    theta[none] = np.log(max(1, label.sum()) / len(label))
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w = np.r_[theta[:none], 0.0]
        emission = np.clip(w[table].sum(axis=1) + theta[none], -LIMIT, LIMIT)
        tagger = Tagger({}, theta[none], float(np.exp(theta[none + 1])),
                        tuple(map(tuple, np.exp(theta[none + 2:none + 6]).reshape(2, 2))))
        e = emission[word]
        ahead, behind, p = marginals(e, starts, tagger)
        miss = label - p
        by_type = np.bincount(word, miss, minlength=len(table))
        slope = np.zeros_like(theta)
        slope[:none] = np.bincount(table.ravel(), np.repeat(by_type, table.shape[1]), minlength=none + 1)[:none]
        slope[none] = miss.sum()
        slope[none + 1] = miss[starts].sum()
        (a00, a01), (a10, a11) = tagger.steps
        r, q, x = ahead[inner - 1], behind[inner], np.exp(e[inner])
        joint = np.stack([np.full(len(r), a00), a01 * x * q, r * a10, r * a11 * x * q])
        slope[none + 2:none + 6] = wanted - (joint / joint.sum(axis=0)).sum(axis=1)
        slope = slope / len(docs) - SHRINK * theta
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        theta += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        theta[none + 1:] = np.clip(theta[none + 1:], -6, 6)
    weights = {int(f): float(w) for f, w in zip(hashes, theta) if abs(w) > 1e-3}
    return Tagger(weights, float(theta[none]), float(np.exp(theta[none + 1])),
                  tuple(map(tuple, np.exp(theta[none + 2:none + 6]).reshape(2, 2).tolist())))


def is_held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
          toxic: str = "toxic", label_id: str = "doc_id") -> Tagger:
    """Fit on at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents, chosen by a hash.

    Only labels of documents that are not held out are read; NULL ids and labels are left
    out; of contradicting labels the higher counts; of rows that share an id the smallest
    text. Longer documents than SAMPLE_CHARS are scored but not learnt from.
    """
    known = boxed(labels, id=number_id(label_id), toxic=field(toxic).cast("int")).drop("row")
    known = known.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1)
                        & ~is_held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    picks = None
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        some = known.where(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(most)
        picks = some if picks is None else picks.unionAll(some)
    base = boxed(docs, id=number_id(doc_id), text=field(text).cast("string")).drop("row")
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers
    chosen = base.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(picks), "id").groupBy(
        "id", "toxic").agg(F.min("text").alias("text"))
    return fit([(r["text"], r["toxic"]) for r in sorted(chosen.collect(), key=lambda r: r["id"])])


def runs_of(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Neighbouring texts, about ``chars`` characters together."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def score_documents(docs: DataFrame, tagger: Tagger, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, score, spans), one row per input row, from the whole text alone.

    ``spans`` are the runs of words that are toxic with probability one half or more:
    (start, stop, score), offsets in code points, score the highest marginal of the run. The
    document's score is the probability that one of its spans is toxic, or its highest
    marginal if it has none. Empty, blank and NULL texts score 0 and have no spans. Repeated
    rows score alike; an empty table gives no rows. Columns of any name travel in ``row``.
    """
    base = boxed(docs, doc_id=number_id(doc_id), text=field(text).cast("string"))
    shape = with_row(base, "doc_id long, score double, "
                           "spans array<struct<start:int,stop:int,score:double>>")
    sent, mark = docs.sparkSession.sparkContext.broadcast(tagger), uuid.uuid4().hex

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        emissions = worker_cache("toxicity", mark, make=lambda: Emissions(sent.value))
        scores, spans = [], []
        for texts in runs_of(strings(batch), CHUNK_CHARS):
            found = score_texts(texts, emissions)
            scores += found[0]
            spans += found[1]
        kind = pa.list_(pa.struct(
            [("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(scores, pa.float64()),
             pa.array(spans, kind)], ["row", "doc_id", "score", "spans"])

    return map_batches(base, work, shape)


class Emissions(dict):
    """Emission of each spelling met so far."""

    def __init__(self, tagger: Tagger):
        super().__init__()
        self.tagger = tagger

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = self.tagger.emission(word)
        return value


def score_texts(texts: list[str], emissions: Emissions) -> tuple[list[float], list[list[dict]]]:
    """Scores and spans of some texts, each a chain of its own."""
    scores: list[float] = []
    spans: list[list[dict]] = []
    tagger, look = emissions.tagger, emissions.__getitem__
    parts = [np.array([look(w) for w in TOKEN.findall(t)]) for t in texts]
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths)
    if not lengths.any():
        return [0.0] * len(texts), [[] for _ in texts]
    p = marginals(np.concatenate(parts), (ends - lengths)[lengths > 0], tagger)[2]
    for text, end, length in zip(texts, ends.tolist(), lengths.tolist()):
        own = p[end - length:end]
        hot = np.flatnonzero(own >= 0.5)
        if not len(hot):
            scores.append(float(own.max()) if length else 0.0)
            spans.append([])
            continue
        places = [m.span() for m in TOKEN.finditer(text)]
        runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1)
        peaks = [float(own[r].max()) for r in runs]
        scores.append(float(1 - np.prod([1 - x for x in peaks])))
        spans.append([{"start": places[r[0]][0], "stop": places[r[-1]][1], "score": x}
                      for r, x in zip(runs, peaks)])
    return scores, spans


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                    **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their own columns."""
    tagger = train(docs, labels, **options)
    return score_documents(docs, tagger, **options).where(F.col("score") < threshold).select("row.*")
