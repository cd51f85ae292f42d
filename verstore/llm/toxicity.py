"""Toxicity by Levenshtein automata over a lexicon trie, with context-window scores."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verstore.llm.common import chunks, held_out, in_batches, read, share, taken, tidy, words
from verstore.llm.langid import code_points
from verstore.llm.minhash import shingle_sets

#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE = 4000
#: Least letters of terms and stems that may be misspelt; letters of stems.
LONG, STEMS = 5, range(4, 8)
#: States of the automaton made at once and held at a time, about, and strings judged between two looks at the latter.
BUILT, HELD, STRINGS = 20_000, 200_000, 20_000
#: Items of a state beside 0 and 1 errors: an exact walk, a stem behind it, a misspelt stem behind it.
EXACT, STEM, NEAR = 2, 3, 4
#: Words on either side in which a reporting verb or a quote marks a hit as quotation.
WINDOW, CUT = 6, 0.3
#: Marks and verbs of quotation, and look-alikes of letters.
QUOTES = '["“”„«»]'
#: Words that begin or end with a mark; one that is only a mark does both where its form doesn't tell; ends of sentences.
OPENS, CLOSES, ENDS = r'^[^\pL\pN"“”„«»]*(["“„«]|["“”„«»][^\pL\pN]*[\pL\pN])', r'(["”»]|[\pL\pN][^\pL\pN]*["“”„«»])[^\pL\pN"“”„«»]*$', r'[.!?]["“”»)\]]*$'
REPORTING = ["said", "says", "wrote", "writes", "quoted", "quote", "called", "calling", "alleged", "reported", "reads", "word", "term"]
ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = 7


def plain(flat: pa.Array) -> pa.DictionaryArray:
    """Words in lower case without marks at their ends, coded."""
    coded = flat.dictionary_encode()
    low = pc.utf8_lower(coded.dictionary)
    own = pc.replace_substring_regex(low, pattern=r"^[^\pL\pN@$]+|[^\pL\pN]+$", replacement="").dictionary_encode()
    return pa.DictionaryArray.from_arrays(own.indices.take(coded.indices), own.dictionary)


class Automaton:
    """The Levenshtein automata of all terms and stems intersected with their trie, as one table of states.

    A state is the set of (trie node, errors so far), as numbers; its verdict is 1 for a
    term, 2 for a stem followed by anything, 3 for a term with one letter wrong,
    missing or too many, 4 for such a stem followed by anything, and 0 else.
    The first BUILT states are made at once, further ones when a word first leads
    to them; more than HELD of them are forgotten and made anew, so a lexicon of any size fits.
    """

    def __init__(self, terms: list[str], stems: list[str], fuzzy: list[str], near: list[str] = ()):
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for w in [*terms, *stems, *fuzzy, *near] for c in w}))}
        # Roots 0: exact terms and stems, 1: terms that may be misspelt, 2: stems that may be.
        self.kids: list[dict[int, int]] = [{}, {}, {}]

        def add(word: str, root: int) -> int:
            node = root
            for c in word:
                k = self.letters[c]
                if k not in self.kids[node]:
                    self.kids[node][k] = len(self.kids)
                    self.kids.append({})
                node = self.kids[node][k]
            return node

        self.term, self.stem = {add(w, 0) for w in terms}, {add(w, 0) for w in stems}
        self.soft, self.near = {add(w, 1) for w in fuzzy}, {add(w, 2) for w in near}
        self._begin()
        done = 0
        while done < len(self.sets) <= BUILT:
            for c in range(len(self.letters) + 1):
                self._link(done, c)
            done += 1

    def _begin(self) -> None:
        self.index, self.sets = {}, []
        self.table, self.verdict = np.full((64, len(self.letters) + 1), -1, np.int32), np.zeros(64, np.int8)
        self._number(self._close({self._item(0, EXACT), self._item(1, 0), self._item(2, 0)}))
        self.dead = self._number(frozenset())

    @staticmethod
    def _item(node: int, e: int) -> int:
        return node * 8 + e

    def _number(self, state: frozenset) -> int:
        k = self.index.setdefault(state, len(self.sets))
        if k == len(self.sets):
            self.sets.append(state)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.verdict = np.concatenate([self.verdict, np.zeros_like(self.verdict)])
            self.verdict[k] = self._verdict(state)
        return k

    def _close(self, state: set) -> frozenset:
        out = set(state)
        for item in state:
            if item % 8 == 0:
                out |= {self._item(k, 1) for k in self.kids[item // 8].values()}
        if any(item % 8 == 1 and item // 8 in self.near for item in out):
            out.add(self._item(0, NEAR))
        return frozenset(out)

    def _link(self, k: int, c: int) -> None:
        out = set()
        for item in self.sets[k]:
            node, e = divmod(item, 8)
            if e in (STEM, NEAR):
                out.add(item)
                continue
            if e == EXACT and node in self.stem:
                out.add(self._item(0, STEM))
            if c in self.kids[node]:
                out.add(self._item(self.kids[node][c], e))
            if e == 0:
                out.add(self._item(node, 1))
                out |= {self._item(n, 1) for n in self.kids[node].values()}
        self.table[k, c] = self._number(self._close(out))  # the table may have been replaced by then

    def _verdict(self, state: frozenset) -> int:
        if any(i % 8 == EXACT and i // 8 in self.term for i in state):
            return 1
        if any(i % 8 == STEM or (i % 8 == EXACT and i // 8 in self.stem) for i in state):
            return 2
        if any(i % 8 <= 1 and i // 8 in self.soft for i in state):
            return 3
        return 4 if self._item(0, NEAR) in state else 0

    def judge(self, strings: pa.Array) -> np.ndarray:
        """The verdict of each string; all strings take a step at a time, those in the dead state drop out."""
        parts = [self._judge(strings.slice(i, STRINGS)) for i in range(0, len(strings), STRINGS)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int8)

    def _judge(self, strings: pa.Array) -> np.ndarray:
        if len(self.sets) > HELD:
            self._begin()
        flat, at = code_points(strings)
        of = np.zeros(int(max(flat.max(initial=0), 255)) + 1, np.int32)
        for c, k in self.letters.items():
            if ord(c) < len(of):
                of[ord(c)] = k
        for c, like in ALIKE.items():
            of[ord(c)] = self.letters.get(like, 0) if c not in self.letters else self.letters[c]
        size, state = np.diff(at), np.zeros(len(strings), np.int32)
        live, i = np.flatnonzero(size > 0), 0
        while len(live):
            old, by = state[live], of[flat[at[live] + i]]
            miss = self.table[old, by] < 0
            for pair in np.unique(old[miss].astype(np.int64) * self.table.shape[1] + by[miss]).tolist() if miss.any() else ():
                self._link(*divmod(pair, self.table.shape[1]))
            state[live] = self.table[old, by]
            i += 1
            live = live[(size[live] > i) & (state[live] != self.dead)]
        return self.verdict[state]


def within(raw: pa.DictionaryArray, hit: np.ndarray, first: np.ndarray, last: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether each hit's nearest mark before it opens and its nearest one after it closes, both in its window or sentence.

    first, last: edges of the hit's document; lo, hi: of its window.  A mark at a word's
    beginning opens and one at its end closes, so inch signs and quotes cut off pair with nothing.
    """
    if not len(hit):
        return np.zeros(0, bool)
    of = raw.indices.to_numpy(zero_copy_only=False)
    has = lambda pattern: pc.match_substring_regex(raw.dictionary, pattern=pattern).to_numpy(zero_copy_only=False)[of]
    opens, closes, place = has(OPENS), has(CLOSES), np.arange(len(of))
    letters = has(r"[\pL\pN]")
    left = np.maximum.accumulate(np.where(opens | closes, place, -1))  # the last word with a mark up to each word
    right = np.minimum.accumulate(np.where(opens | closes, place, len(of))[::-1])[::-1]
    ends = has(ENDS)
    begun = np.maximum.accumulate(np.where(np.concatenate([[True], ends[:-1]]), place, 0))
    ended = np.minimum.accumulate(np.where(ends, place + 1, len(of))[::-1])[::-1]
    lo, hi = np.maximum(first, np.minimum(lo, begun[hit])), np.minimum(last, np.maximum(hi, ended[hit]))
    # The hit's own mark counts on its own side only.
    before = np.where(opens[hit], hit, np.where(hit > 0, left[hit - 1], -1))
    after = np.where(closes[hit], hit, np.append(right, len(of))[hit + 1])
    b, a = np.maximum(before, 0), np.minimum(after, len(of) - 1)
    opened = (before >= lo) & opens[b] & ((b == hit) | ~closes[b] | ~letters[b])
    return opened & (after < hi) & closes[a] & ((a == hit) | ~opens[a] | ~letters[a])


def features(machine: Automaton, texts: pa.Array) -> np.ndarray:
    """By text: hits of terms, stems and misspellings in its own voice, quoted hits, any sure hit, hits per 100 words, misspelt stems."""
    at, flat = words(texts)
    coded = plain(flat)
    index = coded.indices.to_numpy(zero_copy_only=False)
    kind = machine.judge(coded.dictionary)[index] if len(index) else np.zeros(0, np.int8)
    raw = flat.dictionary_encode()
    marks = pc.count_substring_regex(raw.dictionary, pattern=QUOTES).to_numpy(zero_copy_only=False)[raw.indices.to_numpy(zero_copy_only=False)] if len(index) else np.zeros(0, int)
    cue = pc.is_in(coded.dictionary, value_set=pa.array(REPORTING)).to_numpy(zero_copy_only=False)[index] if len(index) else np.zeros(0, bool)
    quotes, cues = np.concatenate([[0], np.cumsum(marks)]), np.concatenate([[0], np.cumsum(cue)])
    hit = np.flatnonzero(kind)
    doc = np.searchsorted(at, hit, side="right") - 1
    lo, hi = np.maximum(at[doc], hit - WINDOW), np.minimum(at[doc + 1], hit + WINDOW + 1) if len(hit) else hit
    quoted = within(raw, hit, at[doc], at[doc + 1] if len(hit) else hit, lo, hi) | (marks[hit] >= 2) | (cues[hi] > cues[lo]) & (quotes[hi] > quotes[lo])
    n, out = len(texts), np.zeros((len(texts), FEATURES))
    for k in (1, 2, 3):
        out[:, k - 1] = np.log1p(np.bincount(doc[(kind[hit] == k) & ~quoted], minlength=n))
    out[:, 3] = np.log1p(np.bincount(doc[quoted], minlength=n))
    out[:, 4] = (out[:, 0] + out[:, 1]) > 0
    out[:, 5] = np.minimum(10, 100 * np.bincount(doc[~quoted], minlength=n) / np.maximum(1, np.diff(at)))
    out[:, 6] = np.log1p(np.bincount(doc[(kind[hit] == 4) & ~quoted], minlength=n))
    return out


class Model:
    def __init__(self, machine: Automaton, weights: np.ndarray):
        self.machine, self.weights = machine, weights

    def score(self, texts: pa.Array) -> np.ndarray:
        x = features(self.machine, texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 0.1) -> np.ndarray:
    """Ridge-penalised weights, intercept first, by Newton's method; the intercept is moved to the prior share of 1."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return w


def lexicon(counts: DataFrame, share: float) -> tuple[list[str], list[str], list[str], list[str]]:
    """Terms, stems, misspellable terms and stems: those that toxic documents use more than chance explains.

    counts: kind, term, bad, good (documents of the sample).  The share of toxic
    ones among a term's documents must be 0.8 (stems: 0.9) and so far from
    the sample's that it would arise among all terms once in a hundred samples.
    All that pass are taken.  Terms that begin with a stem count as the stem where they are spelt right.
    """
    many = max(1, counts.count())
    n, p = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    far = p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    sure = counts.where((F.col("bad") > 0) & (p >= F.when(F.col("kind") == 0, 0.8).otherwise(0.9)) & (n * far >= float(np.log(100 * many))))
    best = sure.orderBy(F.desc(n * far), "kind", "term").collect()
    terms = {r.term: r.bad for r in best if r.kind == 0}
    most: dict[str, int] = {}
    for t, bad in terms.items():
        for k in STEMS:
            most[t[:k]] = max(bad, most.get(t[:k], 0))
    stems: dict[str, None] = {}
    begins = lambda t: any(t[:k] in stems for k in STEMS)
    for r in sorted((r for r in best if r.kind), key=lambda r: (len(r.term), r.term)):
        if not most.get(r.term, -1) >= 0.8 * r.bad and not begins(r.term):
            stems[r.term] = None
    return [t for t in terms if not begins(t)], list(stems), [t for t in terms if len(t) >= LONG], [t for t in stems if len(t) >= LONG]


def unlike(rows: DataFrame) -> DataFrame:
    """The sample's rows without near copies of others: what many copies of one document say counts once.

    Documents that share 2 of 8 least hashes of their 3-word shingles with
    one earlier document go.  The driver sees 8 numbers for each document of the bounded sample.
    """

    def run(batches):
        for part in chunks(batches):
            sets = shingle_sets(part.column("text"), 3)
            odd = np.arange(1, 17, 2, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
            least = np.array([(s[None, :] * odd).min(axis=1) if len(s) else np.zeros(8, np.uint64) for s in sets]).reshape(-1, 8).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c) for c in least.T]], names=["doc_id", *[f"h{k}" for k in range(8)]])

    names = [f"h{k} long" for k in range(8)]
    found = rows.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(names)).collect()
    found.sort(key=lambda r: r[0])
    least = np.array([r[1:] for r in found], np.int64).reshape(-1, 8)
    gone = [(r[0],) for i, r in enumerate(found) if ((least[:i] == least[i]).sum(axis=1) >= 2).any()]
    drop = rows.sparkSession.createDataFrame(gone, f"doc_id {dict(rows.dtypes)['doc_id']}")
    return rows.join(F.broadcast(drop), "doc_id", "left_anti").select("toxic", "text")


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, float, float]:
    """toxic and text of at most `sample` documents of each label, the share of toxic ones there and among all labelled rows."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    each = [known.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(sample).select("doc_id", "toxic") for k in (0, 1)]
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(each[0].unionByName(each[1])), "doc_id").select("doc_id", "toxic", "text")
    few = {k: min(sample, n.get(k, 0)) for k in (0, 1)}
    clip = lambda a, b: min(max(a / max(1, a + b), 1e-3), 1 - 1e-3)
    return rows, clip(few[1], few[0]), clip(n.get(1, 0), n.get(0, 0))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.toxic from at most `sample` documents of each label that are not held out."""
    rows, part_toxic, prior = sampled(docs, labels, sample)
    rows = rows.repartition(max(1, docs.sparkSession.sparkContext.defaultParallelism)).persist()
    own = unlike(rows).persist()

    def count(batches):
        for part in chunks(batches):
            at, flat = words(part.column("text"))
            coded = plain(flat)
            index, strings = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            doc = np.repeat(np.arange(part.num_rows), np.diff(at))
            toxic = part.column("toxic").to_numpy() == 1
            out = []
            size = pc.utf8_length(strings).to_numpy(zero_copy_only=False) if len(strings) else np.zeros(0, int)
            for length in (0, *STEMS):
                own = strings if not length else pc.utf8_slice_codeunits(strings, 0, length)
                own = own.dictionary_encode()
                code = own.indices.to_numpy(zero_copy_only=False)[index] if len(index) else index
                use = size[index] > length if length else size[index] > 2
                pair = np.unique(doc[use].astype(np.int64) * max(1, len(own.dictionary)) + code[use])
                d, t = np.divmod(pair, max(1, len(own.dictionary)))
                bad, good = (np.bincount(t[toxic[d] == k], minlength=len(own.dictionary)) for k in (True, False))
                out.append((np.full(len(bad), length), own.dictionary, bad, good))
            for kind, terms, bad, good in out:
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), terms.cast(pa.string()), pa.array(bad, pa.int64()), pa.array(good, pa.int64())], names=["kind", "term", "bad", "good"])

    counts = own.mapInArrow(tidy(count), "kind int, term string, bad long, good long").groupBy("kind", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad + good > 1").persist()
    machine = Automaton(*lexicon(counts, part_toxic))
    counts.unpersist()
    shared = share(docs.sparkSession, machine)

    def measure(batches):
        machine = taken(shared)
        for part in chunks(batches):
            x = features(machine, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.float64()), *[pa.array(c) for c in x.T]], names=["y", *[f"f{k}" for k in range(FEATURES)]])

    got = own.mapInArrow(tidy(measure), "y double, " + ", ".join(f"f{k} double" for k in range(FEATURES))).toPandas().to_numpy()
    own.unpersist()
    rows.unpersist()
    if not len(got):
        return Model(machine, np.append(np.log(prior / (1 - prior)), np.zeros(FEATURES)))
    got = got[np.lexsort(got.T)]
    return Model(machine, logistic(got[:, 1:], got[:, 0], prior))


def toxicity(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted for each row of docs.

    Whole texts are matched, in chunks of bounded size.  Null and empty texts have no hits and get the
    score of a text without any; rows are scored one by one and other columns are not read.
    """
    shared = share(docs.sparkSession, model)

    def run(batches):
        model = taken(shared)
        for part in chunks(batches):
            score = model.score(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select("doc_id", "text")
    return in_batches(rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity(docs, train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


SQL = None
