"""Shortest-pack-first packing over the histogram of lengths."""
from __future__ import annotations

import gc
import re
import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verstore.llm.common import chunks, gathered, in_batches, read, tidy, words

#: Ids in a sequence; the id that ends a document; cells by which equal lengths are ranked.
SEQUENCE, END, CELLS = 4096, 2, 1024
#: Bytes of text that a worker encodes at a time: more share more words, fewer take less memory.
GATHER = 32 << 20
MARK = "\x01"
#: Words cached by a task, and words encoded in one string.
CACHE, JOINED = 800_000, 200
# Lower-case letters that neither the tokenizer's normalisation changes nor its split divides, and these with ASCII marks.
LETTERS = re.compile("[a-zß-öø-ÿā-ſ]+").fullmatch
SIMPLE = re.compile("[!-@[-~ß-öø-ÿā-ſ]+").fullmatch
# Such letters and then marks, apostrophes aside: the split divides them, so each part is encoded alone.
PARTS = re.compile(r"([a-zß-öø-ÿā-ſ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


class Encoder:
    """Ids of words as the tokenizer gives them in running text.

    The tokenizer's own split drops white space and no token crosses it, so a
    text's ids are those of its words in a row.  A distinct word is encoded
    once, many in one string with a mark between that is a token of its own; words of
    plain lower-case letters go without the normalisation and the split, which leave them as they are.
    Words that differ in case only, or in the marks after their letters, share the letters' encoding.
    """

    def __init__(self, path: str | None = None, cache: int | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.cache = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json")), cache or CACHE
        whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        none = normalizers.Sequence([])
        plain = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # One vocabulary in memory; its steps before the merges are changed with the kind of word.
        self.kinds = [(none, plain), (none, whole[1]), whole]
        (self.mark,) = self._set(2).encode(MARK, add_special_tokens=False).ids
        self.clear()

    def _set(self, kind: int):
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.kinds[kind]
        return self.tokenizer

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _many(self, tokenizer, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings in a row, and how many each has."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(strings), JOINED):
            own = np.array(tokenizer.encode_batch_fast([f" {MARK} ".join(strings[i : i + JOINED])], add_special_tokens=False)[0].ids, np.uint32)
            here = own == self.mark
            at = np.concatenate([[-1], np.flatnonzero(here), [len(own)]])
            ids.append(own[~here])
            sizes.append(np.diff(at) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, strings: list[str]) -> None:
        """Adds words that are not in the cache."""
        units: list[dict[str, None]] = [{}, {}, {}, {}]  # what is encoded, by kind of tokenizer; the last ones alone
        single, double = [], []
        for s in strings:
            low = s.lower()
            if LETTERS(low):
                k, own = 0, low
            elif MARK in s or "<|" in s:
                k, own = 3, s
            elif both := PARTS(low):
                head, tail = both.groups()
                units[0][head] = units[1][tail] = None
                double.append((s, head, tail))
                continue
            else:
                k, own = (1, low) if SIMPLE(low) else (2, s)
            units[k][own] = None
            single.append((s, own))
        coded = [self._many(self._set(kind), list(units[kind])) for kind in range(3)]
        alone = [np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, np.uint32) for s in units[3]]
        coded.append((np.concatenate(alone) if alone else self.ids[:0], np.array([len(x) for x in alone], np.int64)))
        ids = np.concatenate([c[0] for c in coded])
        start = np.concatenate([[0], np.cumsum(np.concatenate([c[1] for c in coded]))])
        place = {u: i for i, u in enumerate(u for own in units for u in own)}
        first = len(self.start) - 1
        for s, own in single:
            self.number[s] = first + place[own]
        first += len(place)
        for i, (s, _, _) in enumerate(double):
            self.number[s] = first + i
        pairs = np.array([place[x] for _, *own in double for x in own], np.int64)
        size = np.diff(start)[pairs]
        run = np.concatenate([[0], np.cumsum(size)])
        joined = ids[np.repeat(start[pairs] - run[:-1], size) + np.arange(run[-1])]
        at = self.start[-1]
        self.ids = np.concatenate([self.ids, ids, joined])
        self.start = np.concatenate([self.start, at + start[1:], at + start[-1] + run[2::2]])

    def encode(self, texts: pa.Array, slice_words: int = 1 << 19):
        """(first text, ids in a row, each text's start with the end at last) for runs of texts of about `slice_words` words.

        The ids are without an end id.  Words are looked up once for all texts, ids are laid out run by run.
        """
        at, flat = words(texts)
        coded = flat.dictionary_encode()
        strings = coded.dictionary.to_pylist()
        new = [s for s in strings if s not in self.number]
        if self.number and len(self.number) + len(new) > self.cache:
            self.clear()
            new = strings
        if new:
            self._learn(new)
        index = np.fromiter(map(self.number.__getitem__, strings), np.int32, len(strings))[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int32)
        sizes = np.diff(self.start)
        edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(at[:-1] // slice_words)) + 1, [len(texts)]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = index[at[a] : at[b]]
            size = sizes[own]
            run = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[np.repeat(self.start[own] - run[:-1], size) + np.arange(run[-1])]
            yield a, ids, run[at[a : b + 1] - at[a]]


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end: int = END, gather: int = GATHER, cache: int | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document cut every `sequence` ids."""

    def run(batches):
        gc.disable()  # hundreds of thousands of words and no cycles: collections only cost time
        try:
            yield from encoded(batches)
        finally:
            gc.enable()  # the worker serves other tasks later

    def encoded(batches):
        encoder = Encoder(path, cache)
        for part in chunks(gathered(batches, gather), limit=2 * gather):
            rows: list[list] = [[], [], [], [], []]
            for first, ids, at in encoder.encode(part.column("text")):
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()), first):
                    own = np.append(ids[a:b], np.uint32(end)).astype("<u4", copy=False)
                    for i in range(0, len(own), sequence):
                        piece = own[i : i + sequence]
                        for column, value in zip(rows, (k, i, len(piece), zlib.crc32(piece), len(own))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows[0], pa.int64())), *[pa.array(x, pa.int64()) for x in rows[1:]]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs that hold every piece of the histogram once.

    Lengths are placed longest first; each goes to the packs in use whose room
    is the largest (the shortest packs), all equal pieces and packs at a time, and
    opens new packs for what fits nowhere.  Packs alike are one pattern with a count.
    """
    room: dict[int, list[list]] = {}  # by room left: [count, lengths]
    order: list[int] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = order[-1] if order and order[-1] >= length else 0
            if fits:
                pack = room[fits].pop()
                if not room[fits]:
                    del room[fits]
                    order.pop()
            else:
                pack, fits = [left, ()], sequence
            use = min(left, pack[0])
            if pack[0] > use:
                if fits not in room:
                    room[fits] = []
                    insort(order, fits)
                room[fits].append([pack[0] - use, pack[1]])
            rest = fits - length
            if rest not in room:
                room[rest] = []
                insort(order, rest)
            room[rest].append([use, (*pack[1], length)])
            left -= use
    return [(count, lengths) for r in sorted(room) for count, lengths in room[r]]


def slots(found: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): which pieces of a length go where."""
    out, used, sequence = [], {}, 0
    for count, lengths in found:
        offset = 0
        for length in lengths:
            out.append((length, used.get(length, 0), count, sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """rows with rank: 0, 1, ... among pieces of a length, by cells so that no task holds a length's pieces together."""
    keyed = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start"), F.lit(CELLS)).cast("int"))
    sizes = keyed.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("before", F.sum("n").over(before) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    return keyed.join(sizes, ["length", "cell"]).withColumn("rank", F.col("before") + inside - 1).drop("cell", "before")


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end: int = END, gather: int = GATHER, cache: int | None = None, batch: int = 10_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone.  Documents longer than a sequence
    fill whole sequences; their rests and all other documents are packed.
    Ranks go by a hash of (doc_id, start); rows alike in all columns are
    interchangeable, so reruns agree.  Other columns are not read.  The driver sees
    the histogram of lengths (at most `sequence` rows) and its patterns.
    """
    spark = docs.sparkSession
    rows = in_batches(pieces(docs, path, sequence, end, gather, cache), batch)
    histogram = {r.length: r["count"] for r in rows.groupBy("length").count().collect()}
    places = slots(patterns(histogram, sequence))
    table = spark.createDataFrame(places, "length long, first long, n long, at long, offset long")
    numbered = ranked(rows)
    # At most a slot for each length of a pattern: bounded by the histogram, not by the documents.
    joined = numbered.join(F.broadcast(table), (numbered.length == table.length) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))).drop(table.length)
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("at") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


SQL = None
