"""License scans: exact seeds find candidates, bounded-error matching verifies them."""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyloom.llm.common import boxed, field, map_batches, number_id, utf8

# Phrases whose exact places are counted, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Short notices found with up to so many edits (single characters, blanks included).
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("apache license", "apache", 1),
    ("apache license version 2 0", "apache", 3),
    ("mit license", "mit", 1),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    ("bsd license", "bsd", 1),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("creative commons attribution", "cc-by", 2),
    ("cc by", "cc-by", 0),
    ("cc by sa", "cc-by-sa", 0),
    ("cc by nc", "cc-by-nc", 0),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 7),
)

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
SPAN = "struct<label:string,first_word:bigint,last_word:bigint,edits:int>"


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    pattern: regex.Pattern


class Scanner:
    """Finds notices in text of lower-case words joined by one blank."""

    def __init__(self, notices: tuple = NOTICES):
        self.notices = [Notice(p, label, k, regex.compile(
            r"(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(p, literal_spaces=True), k),
            regex.BESTMATCH)) for p, label, k in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(self.notices):
            for at, piece in pigeonhole_pieces(notice.phrase, notice.edits):
                seeds.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, phrase length) of every verified place, in characters.

        A place is at most a phrase and its edits long, so every seed has a window of its own
        and the work is in proportion to the number of seeds, however close they stand.
        """
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for n, at in uses:
                notice = self.notices[n]
                low = end + 1 - length - at - notice.edits
                high = low + len(notice.phrase) + 2 * notice.edits + 1
                windows.setdefault(n, set()).add((max(0, low), min(len(text), high)))
        return [(self.notices[n].label, start, end, edits, len(self.notices[n].phrase))
                for n, own in windows.items()
                for start, end, edits in best_places(self.notices[n].pattern, text, own)]


def best_places(pattern: regex.Pattern, text: str, windows: Iterable[tuple[int, int]]
                ) -> list[tuple[int, int, int]]:
    """(start, end, edits) of places that do not overlap: the best of all windows first, and
    again the best of what the places taken so far leave of each window."""
    heap: list[tuple[int, int, int, int, int]] = []

    def look(low: int, high: int) -> None:
        while low < high:
            match = pattern.search(text, low, high)
            if not match:
                return
            end = match.end()
            if end == len(text) or text[end] == " ":
                heapq.heappush(heap, (sum(match.fuzzy_counts), match.start(), end, low, high))
                return
            high = end - 1  # the window, not a word, ended there

    for low, high in windows:
        look(low, high)
    taken: list[tuple[int, int, int]] = []
    while heap:
        edits, start, end, low, high = heapq.heappop(heap)
        # what is taken does not overlap, so starts and ends are in the same order
        first = bisect.bisect_right(taken, low, key=lambda place: place[1])
        last = bisect.bisect_left(taken, high, key=lambda place: place[0])
        if all(b <= start or a > end for a, b, _ in taken[first:last + 1]):
            bisect.insort(taken, (start, end, edits))
            continue
        for a, b, _ in taken[first:last + 1]:
            # the blank before a place stays out, so that the stretch ends with a word
            look(low, min(high, a - 1))
            low = max(low, b)
        look(low, high)
    return taken


def pigeonhole_pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces with their places; that many edits leave one of them untouched."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def scanner(notices: tuple) -> Scanner:
    return Scanner(notices)


def exact_places(joined: str, base: tuple = BASE) -> list[tuple[str, int]]:
    """(label, first word) of every place where a phrase's words stand one after another."""
    padded, places = f" {joined} ", []
    for phrase, label in base:
        at, word, seen = padded.find(f" {phrase} "), 0, 0
        while at >= 0:
            word += padded.count(" ", seen, at)
            seen = at
            places.append((label, word))
            at = padded.find(f" {phrase} ", at + 1)
    return places


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  notices: tuple = NOTICES, base: tuple = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    One row per input row. Words are runs of digits, letters (A-Z lower-cased) and characters
    beyond ASCII. ``n_base`` counts the exact places of the base phrases; ``spans`` are the
    places of notices within their allowed edits, in words; ``labels`` joins both. ``score``
    is the best share of a found phrase that needed no edit, 0 without a find. NULL text is
    empty: no words, empty labels, NULL first and last word. Repeated rows are scanned each;
    a very long text, also one of a notice repeated, takes time in proportion to its length;
    an empty table gives no rows. Other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scan, out = scanner(notices), [[] for _ in range(8)]
        for content in utf8(batch):
            words = WORDS.findall(content.lower())
            joined = b" ".join(words).decode()
            exact = exact_places(joined, base)
            spans = scan.spans(joined)
            starts = [w for _, w in exact]
            own = {label for label, _ in exact}
            best = max([1.0] * bool(exact) + [1 - e / size for _, _, _, e, size in spans],
                       default=0.0)
            blanks = [m.start() for m in re.finditer(" ", joined)] if spans else []
            row = (len(words), len(exact), min(starts, default=None), max(starts, default=None),
                   ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})),
                   max(0.0, best), [
                       {"label": label, "first_word": bisect.bisect_left(blanks, a),
                        "last_word": bisect.bisect_left(blanks, b), "edits": e}
                       for label, a, b, e, _ in spans])
            for column, value in zip(out, row):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
            [("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
             ("edits", pa.int32())]))]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                 "spans"]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
            ["doc_id", *names])

    shape = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
             f"base_labels string, labels string, score double, spans array<{SPAN}>")
    return map_batches(boxed(docs, doc_id=number_id(doc_id), text=field(text).cast("string")).drop("row"),
                       work, shape)
