"""Byte-level BPE: frequent words from a memory-mapped transducer, all others merged exactly."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.common import boxed, chunks, field, map_batches, number_id, with_row, worker_cache
from tallyloom.llm.transducer import Transducer, compiled, spread
from tallyloom.session import materialise, scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# Most frequent words the lexicon holds: the bound of what the driver compiles and of the file
# every executor gets (a few MB at this size).
LEXICON_WORDS = 1 << 17

# Bins of the word counts for each doubling; 64 doublings bound the histogram.
COUNT_BINS = 16

# Text taken at once: every distinct word of it is looked up one time.
CHUNK_BYTES = 6 << 20

# A blank can be cut off with the word behind it, as both stand in one piece: unless the blank
# stands between white space and white space, where runs of it are told apart by their length.
_SPACE = r"\t-\r \x{85}\p{Z}"
_WS = r"\t-\r \x85\p{Z}"  # the same for the regex library
_UNSAFE = rf"[{_SPACE}] (?:[{_SPACE}]|$)"

# The cuts of the vocabulary for stretches joined by NUL. Which characters are letters or digits
# depends on the Unicode version of a library, except in the old scripts before U+0530; stretches
# with others, or with a NUL, are cut by the tokenizer itself.
_JOIN = "\0"
_WORDS = regex.compile(
    rf"{_JOIN}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}{_JOIN}\p{{L}}\p{{N}}]+"
    rf"|[{_WS}]+(?![^{_WS}{_JOIN}])|[{_WS}]+")
_BEYOND = r"[\x{00}\x{530}-\x{10FFFF}]"

_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {
    chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}


class Vocabulary:
    """What a worker keeps of a tokenizer file: its merges, its cuts and the bytes of its ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        self.special = {a["content"]: (a["id"],) for a in added}
        self.cut_special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        pieces = {i: bytes(_BYTE_OF[c] for c in t) for t, i in
                  self.tokenizer.get_vocab(with_added_tokens=False).items()}
        pieces |= {ids[0]: t.encode() for t, ids in self.special.items()}
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.sizes = np.array([len(p) for p in table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def _by_library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, stretches: pa.Array) -> tuple[list[str], np.ndarray]:
        """The pieces that merging never crosses, of all stretches, and how many each has."""
        beyond = pc.match_substring_regex(stretches, _BEYOND).to_numpy(False)
        plain = stretches.filter(pa.array(~beyond)).to_pylist()
        found = _WORDS.findall(_JOIN.join(plain)) if plain else []
        breaks = np.flatnonzero(np.fromiter((w == _JOIN for w in found), bool, len(found)))
        others = [self._by_library(t) for t in stretches.filter(pa.array(beyond)).to_pylist()]
        sizes = np.zeros(len(stretches), np.int64)
        sizes[~beyond] = np.diff(np.r_[-1, breaks, len(found)])[:len(plain)] - 1
        sizes[beyond] = [len(o) for o in others]
        found = [w for w in found if w != _JOIN]
        if others:  # put each in its place
            pool = found + [w for o in others for w in o]
            starts = np.zeros(len(stretches), np.int64)
            starts[~beyond] = np.cumsum(sizes[~beyond]) - sizes[~beyond]
            starts[beyond] = len(found) + np.cumsum(sizes[beyond]) - sizes[beyond]
            found = list(map(pool.__getitem__, spread(starts, sizes).tolist()))
        return found, sizes

    def words_and_specials(self, text: str) -> list[str]:
        parts = self.cut_special.split(text) if self.cut_special else [text]
        return [w for part in parts if part
                for w in ([part] if part in self.special else self._by_library(part))]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): every word by the merge rules themselves, one word after another."""
        made = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        owner = np.fromiter(made.word_ids, np.int64, len(made.ids))
        return np.array(made.ids, np.uint32), np.bincount(owner, minlength=len(words))

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(words, word codes, bounds): distinct words, and the texts as runs of their codes.

        Texts are cut at blanks first and only the distinct stretches are cut further.
        """
        odd = pc.match_substring_regex(texts, _UNSAFE)
        for content in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        odd = odd.to_numpy(False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        stretches = lists.flatten().dictionary_encode()
        begins = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        codes = 2 * stretches.indices.to_numpy().astype(np.int64) + 1
        codes[begins[:-1]] -= 1  # the first stretch of a text has no blank before it
        used = np.flatnonzero(np.bincount(codes))
        place = np.empty(2 * len(stretches.dictionary) + 2, np.int64)
        place[used] = np.arange(len(used))
        codes = place[codes]
        blank = pc.if_else(pa.array(used & 1 == 1), " ", "")
        pieces, sizes = self.words(pc.binary_join_element_wise(
            blank, stretches.dictionary.take(pa.array(used >> 1)), ""))
        # a text cut as a whole is one more stretch, in place of its empty one
        whole = [self.words_and_specials(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        codes[begins[:-1][odd]] = len(sizes) + np.arange(len(whole))
        sizes = np.r_[sizes, np.fromiter(map(len, whole), np.int64, len(whole))]
        pieces += [w for each in whole for w in each]
        encoded = pa.array(pieces, pa.string()).dictionary_encode()
        runs = spread((np.cumsum(sizes) - sizes)[codes], sizes[codes])
        bounds = np.r_[0, np.cumsum(sizes[codes])][begins]
        return encoded.dictionary, encoded.indices.to_numpy()[runs], bounds

    def encode(self, texts: pa.Array, lexicon: Transducer) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]."""
        words, codes, bounds = self.cut(texts)
        raw = words.cast(pa.binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        known, ids, sizes = lexicon.find(data, offsets[:-1].astype(np.int64), np.diff(offsets))
        merged, merged_sizes = self.merge(words.filter(pa.array(~known)).to_pylist())
        places = np.cumsum(sizes) - sizes
        sizes[~known] = merged_sizes
        places[~known] = len(ids) + np.cumsum(merged_sizes) - merged_sizes
        pool = np.concatenate([ids, merged])
        return pool[spread(places[codes], sizes[codes])], np.r_[0, np.cumsum(sizes[codes])][bounds]

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes[spread(self.starts[ids], self.sizes[ids])].tobytes().decode("utf-8", "replace")


def _vocabulary(path: str) -> Vocabulary:
    return worker_cache("bpe", path, make=lambda: Vocabulary(path))


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS, text: str = "text",
                   tokenizer: str = TOKENIZER) -> DataFrame:
    """(word, n): the most frequent words of all texts, at most ``words`` of them.

    Every task sums up its own words chunk by chunk, so what shuffles is one row a distinct
    word and task. A histogram of the counts then says from which count on the words are few
    enough; words of the last count bin are all in or all out.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(tokenizer)
        for table in chunks(batches, CHUNK_BYTES):
            found, codes, _ = vocabulary.cut(table.column("text").combine_chunks().fill_null(""))
            yield pa.RecordBatch.from_arrays(
                [found, pa.array(np.bincount(codes, minlength=len(found)), pa.int64())], ["word", "n"])

    counted = materialise(
        boxed(docs, text=field(text).cast("string")).select("text")
        .mapInArrow(count, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n") * COUNT_BINS).cast("int")
    held, lowest = 0, None
    for row in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held += row["count"]
        if held > words:
            break
        lowest = row["level"]
    return counted.where(level >= lowest if lowest is not None else F.lit(False))


def build_lexicon(docs: DataFrame, words: int = LEXICON_WORDS, text: str = "text",
                  tokenizer: str = TOKENIZER) -> str:
    """Compile the most frequent words and hand the file to all executors; returns its name.

    The words are counted over all texts; only ``words`` of them reach the driver, which turns
    them into one file in the shared work folder. Spark copies it once to every executor, also
    to one that joins later, and the Python workers there map the same copy into memory.
    """
    spark = docs.sparkSession
    listed = [row["word"] for row in frequent_words(docs, words, text, tokenizer).collect()]
    ids, sizes = Vocabulary(tokenizer).merge(listed)
    ends = np.cumsum(sizes)
    path = scratch_path(spark, "lexicon")
    _write(spark, path, compiled(
        (word.encode(), tuple(ids[end - size:end].tolist())) for word, size, end in zip(listed, sizes, ends)))
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def encode_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                     tokenizer: str = TOKENIZER, words: int = LEXICON_WORDS,
                     lexicon: str | None = None, rows: bool = True) -> DataFrame:
    """(row, doc_id, ids: array<int>), one row per input row; columns of any name travel in ``row``,
    which is left out without ``rows``.

    The ids are those of the tokenizers library for the whole text, without special tokens
    added; a special token's string inside a text is that token, as there. A text is cut into
    words as the tokenizer cuts it. Words of the lexicon get their ids from the transducer, all
    distinct words of a chunk of texts at once; every other word is merged by the rules of the
    file. NULL text is empty and has no ids; repeated rows and NULL ids stay rows of their own;
    an empty table gives no rows. A very long text is one array of ids.
    """
    name = lexicon or build_lexicon(docs, words, text, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, machine = _vocabulary(tokenizer), Transducer(SparkFiles.get(name))
        for table in chunks(batches, CHUNK_BYTES):
            ids, bounds = vocabulary.encode(table.column("text").combine_chunks().fill_null(""), machine)
            made = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            done = table.drop_columns(["text"]).append_column("ids", made)
            yield from done.combine_chunks().to_batches()

    base = boxed(docs, doc_id=number_id(doc_id), text=field(text).cast("string"))
    shape = with_row(base, "doc_id long, ids array<int>")
    if not rows:
        base, shape = base.drop("row"), "doc_id long, ids array<int>"
    return base.mapInArrow(run, shape)


def decode_documents(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``encoded`` with ``text``, the text of its ``ids``; special tokens are kept.

    NULL ids are none and give an empty text. Bytes that are no UTF-8 become U+FFFD.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = _vocabulary(tokenizer)
        lists = batch.column("ids")
        flat = lists.flatten().to_numpy()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        texts = [vocabulary.decode(flat[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                          [*batch.schema.names, "text"])

    schema = type(encoded.schema)(list(encoded.schema.fields)).add("text", "string")
    return map_batches(encoded, work, schema)


def round_trip_digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over UTF-8.
    """
    tokenizer = options.get("tokenizer", TOKENIZER)
    encoded = encode_documents(docs, rows=False, **options)
    return decode_documents(encoded, tokenizer).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))
