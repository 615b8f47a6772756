"""Packing: first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.common import boxed, chunks, field, number_id, worker_cache
from tallyloom.session import materialise

CAPACITY = 4096
END_ID = 2
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

# Pieces of one group, on average: what one task packs by itself.
GROUP_PIECES = 8192

# Words without the marks behind them, kept with their ids by one worker; a full cache starts
# anew.
CACHE_WORDS = 1_000_000
MARKS = ".,;:!?|"

# Text looked up at once: every distinct word of it meets the cache one time.
CHUNK_BYTES = 8 << 20

# Byte-level vocabularies write each byte as a character: printable ones as themselves, the
# others as the next free characters from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}

PIECES = "rid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class WordIds(dict):
    """Ids of a blank-free word, little-endian 32-bit; unknown words go to the tokenizer.

    The tokenizer turns every run of blanks into one, drops it and never joins characters
    across it, so a text's ids are the ids of its words one after another. It drops letter
    case, so A-Z can be lowered first; and letters never share a token with the marks behind
    them. Both let a word be met again more often.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a string array, in order."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = lists.flatten().dictionary_encode()
        made = self._words(words.dictionary)
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        pool, starts = np.frombuffer(b"".join(made), "<u4"), np.cumsum(sizes) - sizes
        codes = words.indices.to_numpy()
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        ids = pool[np.repeat(starts[codes] - ends + lengths, lengths)
                   + np.arange(ends[-1] if len(ends) else 0)]
        at = np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        control = pc.match_substring(texts, "<|").to_pylist()
        for i, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if control[i]:  # lowering could have made a control string of it
                yield self._whole(texts[i].as_py())
            else:
                yield ids[low:high].tobytes()

    def _words(self, words: pa.Array) -> list[bytes]:
        """The ids of distinct words: those of the letters, then those of the marks behind."""
        bare = pc.utf8_rtrim(words, characters=MARKS)
        # U+0130 lowers to a letter and a mark, which would join the marks behind it
        parted = pc.and_not(pc.utf8_is_alpha(bare), pc.match_substring(bare, "\u0130"))
        bare = pc.if_else(parted, bare, words).dictionary_encode()
        made = list(map(self.__getitem__, bare.dictionary.to_pylist()))
        cut = pc.not_equal(bare.cast(pa.string()), words).to_numpy(False)
        made = [made[i] for i in bare.indices.to_pylist()]
        for i, word in zip(np.flatnonzero(cut).tolist(), words.filter(pa.array(cut)).to_pylist()):
            made[i] += self[word[len(word.rstrip(MARKS)):]]
        return made

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        plain = unicodedata.normalize("NFC", word)
        small = plain.lower()
        if plain.isalpha() and small.isalpha() and "\u03a3" not in plain:  # sigma lowers by place
            shown = small.encode().decode("latin-1").translate(_BYTE_CHARS)
            made = _packed([token.id for token in self.tokenizer.model.tokenize(shown)])
        else:
            made = self._whole(word)
        self[word] = made
        return made

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; the leftmost bin with room takes the next longest.

    The tree holds the largest free room below each node, so the leftmost bin that fits is
    found by walking down once, and its new room is carried up once.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    width = 1
    while width < len(lengths):
        width *= 2
    room = [capacity] * (2 * width)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        need, node = lengths[i], 1
        while node < width:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - width, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return bins, offsets


def token_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
                 ids: bool = False) -> DataFrame:
    """Every document's ids and ``end_id``, cut into pieces of at most ``capacity`` ids.

    With ``ids`` the pieces carry their ids (little-endian unsigned 32-bit). NULL text is
    empty: its only id is ``end_id``. ``rid`` tells apart rows that share an id.
    """
    end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache("packing", tokenizer, make=lambda: WordIds(tokenizer))
        for table in chunks(batches, CHUNK_BYTES):
            out: list[list] = [[] for _ in range(7)]
            texts = table.column("text").combine_chunks().fill_null("")
            for rid, doc, made in zip(table.column("rid").to_pylist(),
                                      table.column("doc_id").to_pylist(), words.encode(texts)):
                data = made + end
                for at in range(0, len(data), size):
                    piece = data[at:at + size]
                    for column, value in zip(out, (
                            rid, doc, at // 4, len(piece) // 4, zlib.crc32(piece),
                            len(data) // 4, piece)):
                        column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in out[:6]]
            names = ["rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if ids:
                arrays, names = [*arrays, pa.array(out[6], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    base = boxed(docs, doc_id=number_id(doc_id), text=field(text).cast("string")).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return base.mapInArrow(cut, PIECES + ", ids binary" * ids)


def pack(docs: DataFrame, group_pieces: int = GROUP_PIECES, capacity: int = CAPACITY,
         **options) -> DataFrame:
    """(rid, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    Pieces shorter than a sequence are dealt to random groups by a hash and packed there by
    first-fit decreasing, longest first and ties by id and start. The hash includes the row's
    place in its partition, which tells repeated rows apart: reruns over the same files agree,
    while other partitions of the same rows may give other sequences. A piece of full length is a sequence by itself. ``sequence_id`` is unique over all groups and
    offsets run from 0 without a gap. Documents of equal id are packed one by one; NULL ids
    and NULL texts are packed like others; an empty table gives no rows.

    A group is about ``group_pieces`` narrow rows at any input size, because the number of
    groups follows the number of pieces; a hot source or document spreads over all groups.
    """
    pieces = materialise(
        token_pieces(docs, capacity=capacity, **{k: v for k, v in options.items() if k != "ids"}),
        "pieces")
    groups = max(1, pieces.count() // group_pieces)

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"),
                               ("start", "ascending"), ("ids_crc32", "ascending"),
                               ("rid", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        first = key[0].as_py() << 32
        return table.drop_columns(["grp"]).append_column(
            "sequence_id", pa.array([first + b for b in bins], pa.int64())).append_column(
            "offset", pa.array(offsets, pa.int64()))

    dealt = pieces.withColumn("grp", F.pmod(
        F.xxhash64("doc_id", "start", "length", "ids_crc32", "rid"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(fill, PACKED)
