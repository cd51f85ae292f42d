"""Language identification by segmentation-marginalised unigram models."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verstore.llm.common import chunks, held_out, in_batches, read, share, taken, tidy, with_rows, without, words

#: Labelled documents that a language's model is fitted on, at most, and their distinct words, the most frequent first.
SAMPLE, WORDS = 300, 100_000
#: Longest word that training uses, in characters.
WORD = 32
ROUNDS, SMOOTHING = 3, 0.05
#: The vocabulary's mark of a space before a word.
SPACE = "▁"
#: Numbers that the forward sum holds at a time, about.
CELLS = 1 << 20


def public_pieces(path: str | None = None) -> list[str]:
    """All pieces of a public sentencepiece vocabulary, as they are, but for control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return sorted({sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and each string's start with the end at last."""
    size = pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(strings):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    edges = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    flat = np.frombuffer((data.to_pybytes()[edges[0] : edges[-1]] if data else b"").decode().encode("utf-32-le"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(size)])


class Model:
    """Piece probabilities by language over a trie of the pieces; row 0 of the table is a character without a piece of its own."""

    def __init__(self, langs: list[str], pieces: list[str]):
        self.langs = langs
        nodes: dict[tuple[int, int], int] = {}
        rows = [-1]
        for row, piece in enumerate(pieces, 1):
            at = 0
            for c in piece:
                at = nodes.setdefault((at, ord(c)), len(rows))
                if at == len(rows):
                    rows.append(-1)
            rows[at] = row
        keys = np.array([(a << 21) + c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.child, self.row = keys[order], np.array(list(nodes.values()), np.int32)[order], np.array(rows, np.int32)
        self.longest = max(map(len, pieces), default=1)
        self.table = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))

    def matches(self, flat: np.ndarray, pos: np.ndarray, left: np.ndarray):
        """(which, length, table row) of the pieces that begin at each of pos within `left` characters, length by length.

        Where no piece of one character fits, the unknown character's row stands for it.
        """
        live, node = np.arange(len(pos)), np.zeros(len(pos), np.int64)
        for k in range(self.longest):
            inside = left[live] > k
            live, node = live[inside], node[inside]
            if not len(live):
                return
            key = (node << 21) + flat[pos[live] + k]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[i] == key
            next_node = self.child[i]
            row = np.where(known, self.row[next_node], -1)
            if k == 0:
                row = np.maximum(row, 0)
            hit = row >= 0
            if hit.any():
                yield live[hit], k + 1, row[hit]
            live, node = live[known], next_node[known].astype(np.int64)

    def log_likelihood(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(string | language), the sum over all segmentations, for each string; 0 for empty ones."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        order = np.argsort(-np.diff(at), kind="stable")
        step = max(1, CELLS // max(1, (self.longest + 1) * len(self.langs)))
        for i in range(0, len(order), step):
            part = order[i : i + step]
            out[part] = self._forward(flat, at[:-1][part], np.diff(at)[part])
        return out

    def _forward(self, flat: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Strings from the longest on, all one character at a time; a ring holds the sums of the next `longest` places."""
        langs, turn = len(self.langs), self.longest + 1
        logs, ring = np.zeros((len(start), langs)), np.zeros((turn, len(start), langs))
        ring[0] = 1
        for i in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -i, side="left"))  # those longer than i
            here = ring[i % turn, :m]
            for which, k, row in self.matches(flat, start[:m] + i, left[:m] - i):
                ring[(i + k) % turn, which] += here[which] * self.table[row]
            if i % 8 == 7:
                top = np.maximum(ring[:, :m].max(axis=0), 1e-300)
                ring[:, :m] /= top
                logs[:m] += np.log(top)
            done = np.flatnonzero(left[:m] == i + 1)
            if len(done):
                logs[done] += np.log(np.maximum(ring[(i + 1) % turn, done], 1e-300))
            ring[i % turn, :m] = 0
        return logs

    def fit(self, counts: list[dict[str, int]]) -> "Model":
        """Expectation maximisation from distinct words and their counts, by language."""
        known = [self._edges({w: n for w, n in own.items() if 0 < len(w) <= WORD}) for own in counts]
        sums = [np.zeros(len(self.table)) for _ in counts]
        for _ in range(ROUNDS):
            sums = [self._expected(edges, self.table[:, lang]) for lang, edges in enumerate(known)]
            pooled = sum(sums) + 1.0
            pooled /= pooled.sum()
            for lang, s in enumerate(sums):
                self.table[:, lang] = (1 - SMOOTHING) * s / max(s.sum(), 1e-9) + SMOOTHING * pooled
        return self

    def _edges(self, own: dict[str, int]):
        """Sizes and weights of the words, and by place the pieces that begin there."""
        flat, at = code_points(pa.array(list(own), pa.string()))
        size = np.diff(at)
        steps = []
        for i in range(int(size.max(initial=0))):
            inside = np.flatnonzero(size > i)
            steps.append([(inside[which], k, row) for which, k, row in self.matches(flat, at[:-1][inside] + i, size[inside] - i)])
        return size, np.array(list(own.values()), float), steps

    def _expected(self, edges, p: np.ndarray) -> np.ndarray:
        """How often each piece is used in the words, over all segmentations by their probability."""
        size, weight, steps = edges
        ahead, after = np.zeros((len(steps) + self.longest, len(size))), np.zeros((len(steps) + self.longest, len(size)))
        ahead[0], out = 1, np.zeros(len(p))
        after[size, np.arange(len(size))] = 1
        for i, step in enumerate(steps):
            for which, k, row in step:
                ahead[i + k, which] += ahead[i, which] * p[row]
        for i, step in reversed(list(enumerate(steps))):
            for which, k, row in step:
                after[i, which] += p[row] * after[i + k, which]
        share = weight / np.maximum(after[0], 1e-300)
        for i, step in enumerate(steps):
            for which, k, row in step:
                out += np.bincount(row, weights=ahead[i, which] * p[row] * after[i + k, which] * share[which], minlength=len(p))
        return out


def spaced(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each word an index into the distinct ones, these with the mark of a space before them."""
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), pc.binary_join_element_wise(SPACE, coded.dictionary, "")


def train(docs: DataFrame, sample: int = SAMPLE, pieces: list[str] | None = None) -> Model:
    """A model of the languages of documents that are not held out, from at most `sample` documents of each.

    Documents are taken in order of a hash of their id.  Their words are counted in Spark; the driver
    sees the WORDS most frequent ones of each language.  Null texts and null languages teach nothing;
    without any known language there is a model without languages.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    n = known.groupBy("lang").count().orderBy("lang").collect()
    # The hash below which a language has about `sample` documents; the rank then makes the bound exact.
    below = [(r.lang, int(-(2**63) + min(1.0, 1.5 * sample / r["count"]) * (2**64 - 1) // 1)) for r in n]
    if not below:
        return Model([], ["a"])
    bound = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(top, 2**63 - 1))) for lang, top in below])
    few = known.where(F.col("h") <= bound).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= sample).select("doc_id")
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull()).join(F.broadcast(few.distinct()), "doc_id").select("lang", "text")

    def count(batches):
        for part in chunks(batches):
            at, flat = words(part.column("text"))
            index, strings = spaced(flat)
            doc = np.repeat(part.column("lang").dictionary_encode().indices.to_numpy(zero_copy_only=False), np.diff(at))
            pair, many = np.unique(doc.astype(np.int64) * max(1, len(strings)) + index, return_counts=True)
            lang, word = np.divmod(pair, max(1, len(strings)))
            yield pa.RecordBatch.from_arrays([part.column("lang").dictionary_encode().dictionary.take(pa.array(lang)), strings.take(pa.array(word)), pa.array(many)], names=["lang", "word", "n"])

    totals = rows.mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = totals.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= WORDS)
    langs = [r.lang for r in n]
    counts: list[dict[str, int]] = [{} for _ in langs]
    for r in sorted(top.select("lang", "word", "n").collect()):
        counts[langs.index(r.lang)][r.word] = r.n
    return Model(langs, pieces or public_pieces()).fit(counts)


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text; und and 0 for texts without a letter."""
    at, flat = words(texts)
    letter = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    index, strings = spaced(flat)
    sums = model.log_likelihood(*code_points(strings))
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    total = np.stack([np.bincount(doc, weights=own[index], minlength=len(texts)) for own in sums.T], axis=1)
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    best, share_of = odds.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1)
    return [model.langs[b] if c else "und" for b, c in zip(best, letter)], np.where(letter, share_of, 0.0)


def identify(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """`key`, lang_pred and score for each row of docs.

    A text is its words with a space before each; as no piece of the vocabulary has an inner space, the sum over
    all segmentations of a text is the product of the sums of its words, so texts of any length take the
    memory of one chunk.  A word of any length is one sum.  All characters count, white space as one space.  Null texts
    and texts without a letter get 'und' and 0, as does everything
    if there was no language to learn.  Rows are judged one by one, so repeated rows repeat; an empty table gives an empty result.
    """
    shared = share(docs.sparkSession, model)

    def run(batches):
        model = taken(shared)
        for part in chunks(batches):
            lang, score = predict(model, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    rows = docs.select(key, "text")
    return in_batches(rows.mapInArrow(tidy(run), f"`{key}` {dict(rows.dtypes)[key]}, lang_pred string, score double"))


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that have a language: at least one letter and a score of 0.5 or more.

    Rows are judged one by one, so equal rows stay or go together, and ids may be null
    or repeat.  Null and empty texts go.  An empty table stays empty; columns of any name, lang_pred and score too, are kept as they are.
    """
    rows, row = with_rows(docs)
    found = identify(rows.select(F.col(row).alias("row"), "text"), model, "row")
    return without(rows, row, found.where("lang_pred = 'und' OR score < 0.5").select("row"), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


SQL = None
