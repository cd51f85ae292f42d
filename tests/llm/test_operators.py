import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verstore.llm import embedding_dedup, exact_dedup, langid, minhash, mixing, packing, suffix_dedup, token_counts, toxicity, url_filter
from verstore.llm.components import connected_components

from .conftest import TEXTS

SPACES = " \t\n\r\v\f"


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return out + [word] if word else out


def made(seed, n=60, words=40):
    """Texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            texts.append(r.choice(texts))
        elif texts and kind < 0.5:
            own = r.choice(texts).split(" ")
            for _ in range(r.randint(1, 3)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words))))
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# -- exact deduplication
@pytest.mark.parametrize("bits", [128, 4])
def test_exact(spark, docs, bits):
    """With 4 bits nearly all hashes collide; bytes keep the texts apart."""
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(docs, hash_bits=bits).collect()}
    assert got[(1, hashlib.sha256(TEXTS[0][1].encode()).hexdigest())].keep_id == 2
    empty = hashlib.sha256(b"").hexdigest()
    assert got[(3, empty)].keep_id == 4 and not got[(3, empty)].kept and got[(4, empty)].kept and got[(4, empty)].group_size == 2
    nameless = next(r for (i, _), r in got.items() if i is None)
    assert nameless.keep_id is None and nameless.kept
    assert exact_dedup.exact_dedup(docs).count() == len(TEXTS)
    assert sorted(r.doc_id or 0 for r in exact_dedup.drop_copies(docs).collect()) == [0, 2, 4, 5, 6, 7, 8, 9]
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    assert exact_dedup.exact_dedup(docs.where("false")).count() == 0


@pytest.mark.parametrize("large", [1, 1000])
def test_large_groups_of_copies(spark, monkeypatch, large):
    """A third of all rows are one text of 200,000 characters; with either way of telling rows their class."""
    monkeypatch.setattr(exact_dedup, "LARGE", large)
    rows = [(i, "long " * 40_000 if i % 3 == 0 else f"text {i // 4}") for i in range(60)]
    want = {i: max(j for j, o in rows if o == t) for i, t in rows}
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    assert {i: got[i].keep_id for i in want} == want and all(got[i].group_size == sum(o == t for _, o in rows) for i, t in rows)


# -- near duplicates
def components(links, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    rows = made(1, 120, 60)
    sets = {}
    for i, t in rows:
        w = split(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(links, sets)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows), n, percent).collect()}
    assert {i: got[i].component_id for i in sets} == want
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in sets)


def test_near_duplicates_of_odd_rows(spark, docs):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85).collect())
    assert got == sorted([(1, 4, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 4, 6), (7, 1, 7), (8, 1, 8), (9, 4, 1), (9, 4, 1), (-1, 2, None)])


def test_members_of_different_components_meet(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = [(1, i, 3, 0 if i < 200 else i // 4) for i in range(220)]  # one huge component and five small ones
    rows += [(2, 1000 + i, 3, 500 + i % 2) for i in range(40)]  # two of one size
    rows += [(3, 2000, 3, 600), (3, 2001, 3, 601)]
    out = minhash.opposed(spark.createDataFrame(rows, "key long, id long, n long, component long")).collect()
    blocks = {}
    for r in out:
        blocks.setdefault((r.gid, r.block), []).append((r.id, r.component))
    met = {(g, *sorted((a, b))) for (g, _), m in blocks.items() for a, p in m for b, q in m if p != q}
    assert met == {(k, *sorted((a, b))) for k, a, _, p in rows for l, b, _, q in rows if k == l and p != q}
    # 25, 3 and 1 parts of the largest components, 3, 3 and 1 of the rest.
    assert len(out) == (200 * 3 + 20 * (25 + 2)) + (20 * 3 + 20 * (3 + 2)) + 2
    # Of the huge component no two blocks are set against each other.
    assert len({b for g, b in blocks if g == 1}) <= 25 * 3 + 3


@pytest.mark.parametrize("block", [2, 1024])
def test_a_huge_group_beside_others_in_its_buckets(spark, monkeypatch, block):
    """Copies with one word changed at the end of a long text share buckets with texts that are near, but not near enough."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base[:-1] + [f"end{i}"]) for i in range(12)] + [" ".join([*base[: 33 - i], *(f"o{i}x{k}" for k in range(7 + i))]) for i in range(6)]
    rows = list(enumerate(texts))[::-1]
    sets = minhash.shingle_sets(pa.array([t for _, t in rows]), 3)
    links = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - k)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == components(links, [i for i, _ in rows])


def test_block_prunes_but_loses_no_component():
    sets = minhash.shingle_sets(pa.array([t for _, t in made(3, 80, 50)]), 3)
    ids = np.arange(len(sets))
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    assert components(minhash.link_block(ids, sets, ids, 85), ids) == components(links, ids)


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, k) for k in range(8, 40)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, **{i: 7 for i in range(7, 40)}}


# -- mixing
def test_mix(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * 3 for _ in range(r.randint(0, 50))), r.choice(["a", "b", "b", "b", "c", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(split(t))
    taken = Counter()
    for x in got:
        taken[x.source] += x.taken
        assert x.taken in (0, x.size, 2 * x.size) and x.source_size == sizes[x.source]
    targets = {x.source: x.target for x in got}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, t in targets.items():
        assert t <= 2 * sizes[s] + 1e-9 and abs(taken[s] - t) < 20
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_mix_of_odd_rows(spark, docs, nothing):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) and {x.taken for x in got if x.doc_id in (3, 4, 5)} == {0}
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


def greedy(rows, weights=(5, 2, 1)):
    """(doc_id: words taken, source: words left over) of the mix, one document after the other."""
    size = {i: len(split(t)) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    whole = {n: sum(size[i] for i, _, s in rows if s == n) for n in names}
    weight = {n: weights[k % 3] for k, n in enumerate(names)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(whole.values()) - sum(2 * whole[n] for n in full)
        target = {n: 2.0 * whole[n] if n in full else left * weight[n] / sum(weight[m] for m in names if m not in full) for n in names}
        more = {n for n in names if n not in full and target[n] > 2 * whole[n]}
        if not more:
            break
        full |= more
    taken, gaps = {}, {}
    for n in names:
        base = int(target[n] // whole[n]) if whole[n] else 0
        gap = int(target[n] - base * whole[n])
        budget = gap
        own = [(i, (int(hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) for i, _, s in rows if s == n]
        for i, u in sorted(own, key=lambda x: (x[1] / (1 - x[1]) * ((whole[n] - budget) / (budget + size[x[0]] or 1)), x[0])):
            fits = budget > 0 and 0 < size[i] <= gap
            taken[i] = size[i] * (base + fits)
            gap -= size[i] * fits
        gaps[n] = gap
    return taken, gaps


@pytest.mark.parametrize("seed, cells", [(3, 4096), (4, 3)])
def test_mix_takes_what_fits_until_nothing_does(spark, monkeypatch, seed, cells):
    """Sizes from 0 to 3,000 words, so large documents are passed over many times; also with three cells for all ranks."""
    monkeypatch.setattr(mixing, "CELLS", cells)
    r = random.Random(seed)
    rows = [(i, "w " * int(3000 ** r.random() - 1), r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(250)]
    rows += [(900 + i, "w " * 7, "e") for i in range(100)]
    want, gaps = greedy(rows)
    got = {x.doc_id: x.taken for x in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == want
    smallest = {s: min((len(split(t)) for i, t, o in rows if o == s and len(split(t)) and want[i] < 2 * len(split(t))), default=0) for s in gaps}
    assert sum(gaps.values()) < sum(map(len, (t for _, t, _ in rows))) and min(smallest.values()) >= 0


def test_larger_documents_have_larger_inclusion_odds():
    """Beside small ones, a document of a fifth of the budget is taken about as often as they are; with equal odds it is passed over more."""
    r = random.Random(1)
    sizes, budget = [1] * 60 + [8], 40
    whole, hits, changed = sum(sizes), Counter(), 0
    for _ in range(3000):
        u = [r.random() for _ in sizes]
        chosen = {}
        for name in ("size", "equal"):
            by = [x / (1 - x) / ((budget + s * (name == "size")) / (whole - budget)) for x, s in zip(u, sizes)]
            gap, took = budget, set()
            for k in sorted(range(len(sizes)), key=by.__getitem__):
                if sizes[k] <= gap:
                    gap -= sizes[k]
                    took.add(k)
            chosen[name] = took
            hits[name] += 60 in took
        changed += chosen["size"] != chosen["equal"]
    rate = budget / whole
    assert abs(hits["size"] - 3000 * rate) < abs(hits["equal"] - 3000 * rate) / 2 and changed > 50


def test_mixed_documents_puts_out_what_the_mix_took(spark):
    rows = [(1, "a b c d", "s"), (1, "e", "s"), (2, "f g", "t"), (None, "h i j", "t"), (None, "h i j", "t"), (3, None, "t")]
    docs = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, source string, __copy int, __copies int, __of int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words_out = sum(len(split(x.text)) for x in out.collect())
    rows_drawn = mixing.mix(docs.drop("doc_id").withColumn("doc_id", F.monotonically_increasing_id())).collect()
    assert words_out == sum(x.taken for x in rows_drawn) and {(x.asDict()["__copy"], x.asDict()["__of"]) for x in out.collect()} == {(7, 9)}


# -- repeated strings
def stripped(rows):
    seen, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings(spark, seed):
    rows = made(seed, 80, 80) + [(1000, "x" * 300), (1001, "x" * 49), (1002, "é" * 80 + "x" * 60), (1003, None), (1004, "")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_strings(frame(spark, rows)).collect()}
    assert got == stripped(rows)


def test_repeated_strings_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 100)
    rows = made(9, 150, 80)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_strings(frame(spark, rows)).collect()}
    assert got == stripped(rows)


def test_a_frequent_passage_is_dealt_by_whole_strings(spark, monkeypatch):
    """Half of the documents hold one passage between words of their own, and a line of one byte; its leads fill several ranges."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 40)
    found = []
    init = suffix_dedup.Ranges.__init__
    monkeypatch.setattr(suffix_dedup.Ranges, "__init__", lambda self, *a: (init(self, *a), found.append(len(self.hot)))[0])
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = "the quick brown fox, which everyone knows, jumps over the lazy dog"
    rows = [(i, word(r.randint(5, 40)) + (passage if i % 2 else "") + "x" * (80 * (i % 5 == 0)) + word(r.randint(5, 40))) for i in range(200)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.repeated_strings(frame(spark, rows)).collect()}
    assert got == stripped(rows) and found[0] > 0


@pytest.mark.parametrize("leaf", [2, 16, 1 << 14])
def test_multikey_quicksort(monkeypatch, leaf):
    monkeypatch.setattr(suffix_dedup, "LEAF", leaf)
    g = np.random.default_rng(leaf)
    for rows in (g.integers(0, 2, (3000, 20)), np.repeat(g.integers(0, 256, (40, 50)), 60, 0), np.zeros((500, 26)), np.zeros((0, 50)), g.integers(0, 3, (1000, 8))):
        rows = rows.astype(np.uint8)
        order = suffix_dedup.multikey_order(rows)
        texts = [rows[k].tobytes() for k in order]
        assert sorted(order.tolist()) == list(range(len(rows))) and texts == sorted(texts)
        shared = suffix_dedup.common_prefixes(rows, order)
        for a, b, n in zip(texts, texts[1:], shared[1:].tolist()):
            assert a[:n] == b[:n] and (n == rows.shape[1] or a[n] != b[n])


def test_repeated_strings_of_odd_rows(spark, docs, nothing):
    assert suffix_dedup.repeated_strings(docs).count() == len(TEXTS) and suffix_dedup.repeated_strings(nothing).count() == 0
    twice = frame(spark, [(1, "a" * 60), (1, "a" * 60), (None, "a" * 60)])
    assert sorted((r.doc_id or 9, r.n_removed) for r in suffix_dedup.repeated_strings(twice).collect()) == [(1, 0), (1, 0), (9, 60)]
    long = "".join(random.Random(1).choice("abc") for _ in range(3_000_000))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeated_strings(frame(spark, [(1, long), (2, long[1000:2_000_000]), (3, "z" * 60 + long[-70:])])).collect()}
    assert got == {1: 0, 2: 1_999_000, 3: 70}


# -- toxicity
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    r, terms, soft, stems = random.Random(4), ["idiot", "scum", "clown", "cloud"], ["idiot", "clown", "cloud"], ["lowe"]
    machine = toxicity.Automaton(terms, stems, soft)
    words = terms + ["lowe", "lowen", "lowest", "low", "id1ot", "clowm", "clwon", "cl", ""]
    for w in list(words[:4]) * 30:
        own = list(w)
        for _ in range(r.randint(0, 2)):
            own.insert(r.randrange(len(own) + 1), r.choice("abcdelnow")) if r.random() < 0.5 else own.pop(r.randrange(len(own)))
        words.append("".join(own))
    for w, v in zip(words, machine.judge(pa.array(words)).tolist()):
        plain = w.replace("1", "i")
        want = 1 if plain in terms else 2 if plain.startswith("lowe") else 3 if min(distance(plain, t) for t in soft) == 1 else 0
        assert v == want, w


def test_automaton_of_stems_and_of_a_large_lexicon(monkeypatch):
    r = random.Random(9)
    monkeypatch.setattr(toxicity, "BUILT", 50)
    monkeypatch.setattr(toxicity, "HELD", 500)
    monkeypatch.setattr(toxicity, "STRINGS", 40)
    terms = sorted({"".join(r.choice("abcdefgh") for _ in range(r.randint(5, 7))) for _ in range(400)})
    machine = toxicity.Automaton(terms, ["moron"], terms, ["moron"])
    words = ["moron", "moronic", "m0ronic", "morxnic", "mornic", "mmoronic", "maroons", "mxrxnic", "xmoron"]
    words += [w[:2] + "x" + w[3:] for w in terms] + [w[1:] for w in terms] + ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    for w, v in zip(words, machine.judge(pa.array(words)).tolist()):
        plain = w.replace("0", "o")
        soft = any(abs(len(t) - len(plain)) < 2 and distance(plain, t) == 1 for t in terms)
        near = any(distance(plain[:k], "moron") == 1 for k in range(len(plain) + 1))
        assert v == (1 if plain in terms else 2 if plain.startswith("moron") else 3 if soft else 4 if near else 0), w


def test_lexicon_takes_all_that_is_sure(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))[::-1]
    rows = [(0, name(i) + "zz", 100, 0) for i in range(1500)] + [(0, "reeuxab", 40, 0), (0, "reeuxac", 40, 0), (6, "reeuxa", 80, 0)]
    own, stems, fuzzy, near = toxicity.lexicon(spark.createDataFrame(rows, "kind int, term string, bad long, good long"), 0.5)
    assert len(own) == 1500 and stems == near == ["reeuxa"] and len(fuzzy) == 1502


def test_weights_are_the_best_ones():
    g = np.random.default_rng(2)
    x = g.normal(size=(400, 4))
    y = (x @ [1, -2, 0, 0.5] + g.normal(size=400) > 0.3).astype(float)
    w = toxicity.logistic(x, y, y.mean())
    loss = lambda w: np.log1p(np.exp(-(2 * y - 1) * (w[0] + x @ w[1:]))).sum() + 0.05 * (w[1:] ** 2).sum()
    assert all(loss(w) < loss(w + 0.01 * d) for d in g.normal(size=(200, 5)))


def test_lexicon_against_a_count(spark):
    """A term passes if toxic documents are 0.8 of its own and so many more than chance as one of a hundred samples would show."""
    r = random.Random(3)
    rows = [(0, f"w{i}", r.randint(0, 30), r.choice([0, 0, r.randint(0, 10)])) for i in range(400)]
    rows = [x for x in rows if x[2] + x[3]]
    want = set()
    for _, t, bad, good in rows:
        p = bad / (bad + good)
        if p >= 0.8:
            far = p * np.log(p / 0.3) + ((1 - p) * np.log((1 - p) / 0.7) if p < 1 else 0)
            want |= {t} if (bad + good) * far >= np.log(100 * len(rows)) else set()
    own, stems, fuzzy, near = toxicity.lexicon(spark.createDataFrame(rows, "kind int, term string, bad long, good long"), 0.3)
    assert set(own) == want and 0 < len(want) < len(rows) and not stems and not fuzzy


def test_quotation_is_told_apart():
    machine = toxicity.Automaton(["idiot"], [], ["idiot"])
    own, quoted, reported = toxicity.features(machine, pa.array(["you are an idiot", 'he said "you idiot you"', 'the word "idiot" is rude']))
    assert own[0] > 0 and own[3] == 0 and quoted[0] == 0 and quoted[3] > 0 and reported[3] > 0


def test_stray_marks_do_not_quote_the_rest():
    machine, far = toxicity.Automaton(["idiot"], [], ["idiot"]), " word" * 30
    own = ['a 6" pipe' + far + " you idiot", 'he said "cut off' + far + ". you idiot", '"one" you idiot "two"', '"well' + far + ". an idiot you are." + far + ' 6" pipe', 'you idiot"s', '"one" «two» idiot']
    told = ['6" pipe' + far + ' "you idiot" ok', '"you, idiot!" he', "« you idiot »", '" you idiot "', "„du idiot“ ja", '("you idiot")', '"an' + far + " idiot" + far + '" ok', '"idiot"', '"idiot of mine"']
    got = toxicity.features(machine, pa.array(own + told))
    assert [bool(x) for x in got[:, 3]] == [False] * len(own) + [True] * len(told)


def test_near_copies_are_of_one_document(spark):
    # The last row has half of its words from each of two others, so it is a near copy of none.
    r = random.Random(8)
    one, two = ([f"{c}{r.random()}" for _ in range(40)] for c in "ab")
    least = lambda t: {(k, int(x)) for k, x in enumerate((minhash.shingle_sets(pa.array([" ".join(t)]), 3)[0][None, :] * (np.arange(1, 17, 2, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).min(axis=1))}
    for _ in range(2000):
        a, b, new = r.randrange(36), r.randrange(36), [f"c{r.random()}" for _ in range(8)]
        mixed = one[a : a + 4] + new + two[b : b + 4]
        if len(least(mixed) & least(one)) == len(least(mixed) & least(two)) == 1:
            break
    else:
        raise AssertionError("no such row")
    rows = [(1, 1, " ".join(one)), (2, 0, " ".join(two)), (3, 1, " ".join(mixed)), (4, 1, " ".join(one) + " more"), (5, 0, None), (6, 0, "")]
    kept = toxicity.unlike(spark.createDataFrame(rows, "doc_id long, toxic int, text string")).collect()
    assert [x.text for x in sorted(kept, key=lambda x: -len(x.text or ""))][:3] == sorted([" ".join(one), " ".join(two), " ".join(mixed)], key=lambda t: -len(t))
    assert len(kept) == 4


def test_toxicity_on_held_out_rows(spark, docs):
    r, rows, labels = random.Random(6), [], []
    for i in range(1500):
        w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(20)]
        bad = r.random() < 0.3
        if bad:
            w[r.randrange(20)] = r.choice(["moronic", "wretch"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    train = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), train)
    got = {x.doc_id: x for x in toxicity.toxicity(frame(spark, rows), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == dict(labels)[i] for i in held) / len(held) > 0.97
    odd = toxicity.toxicity(docs, model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= x.score <= 1 for x in odd)
    assert toxicity.toxicity(docs, toxicity.train(docs, train.where("false"))).count() == len(TEXTS)


# -- urls
def test_urls(spark):
    page = '<a href="https://good.org/x">'
    rows = [(1, "https://A.com/x?y", page), (2, "http://example.com/en/1", None), (3, "http://www.example.com/en/", ""), (4, "https://x.net/fr/a#b", '<a href="http://bad.org">'), (5, None, None), (6, "no scheme", "x"), (7, "https://good.org/a", None), (8, "https://bad.org/a", '<a href="http://x.net/">'), (9, "https://notcom/", None), (9, "https://notcom/", None), (10, "https://example.com/english", None)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 4)] == [("a.com", "/x", "com/", "allow"), ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("x.net", "/fr/a", "net/fr/", "block")]
    assert got[5].host == got[6].host == got[6].path == "" and got[9].rule is None and got[10].rule == "com/"
    assert got[7].verdict == "allow" and got[7].trust > 0 and got[8].verdict == "block" and got[8].distrust > 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(empty).count() == 0


def test_trust_reaches_the_end_of_a_long_chain(spark):
    chain = [(i, f"https://h{i}.org/" if i else "https://x.net/fr/", f'<a href="http://h{i - 1}.org/">' if i > 1 else '<a href="http://x.net/">' if i else None) for i in range(20)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(chain, "page_id long, url string, html string")).collect()}
    assert all(got[i].verdict == "block" for i in range(20))
    assert all(abs(got[i].distrust / got[0].distrust / 0.85**i - 1) < 1e-6 for i in range(20)) and abs(sum(got[i].distrust for i in range(20)) - 1) < 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_against_a_dense_solution(spark, seed):
    """Personalised PageRank by solving (I - 0.85 P) x = 0.15 s, rows of hosts without links pointing to the seeds."""
    r, names = random.Random(seed), [f"h{i}.org" for i in range(12)]
    rows = [(i, f"https://{r.choice([*names, 'a.com', 'x.net'])}/{r.choice(['fr/', 'q'])}", "".join(f'<a href="http://{h}/">' for h in r.sample([*names, "a.com", "x.net", "y.net", "only.linked"], r.randint(0, 3)))) for i in range(60)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    host = {x.page_id: x.host for x in got}
    hosts = sorted(set(host.values()) | {h.split("/")[0] for _, _, html in rows for h in html.split("http://")[1:]})
    place, n = {h: k for k, h in enumerate(hosts)}, len(hosts)
    links = np.zeros((n, n))
    for i, _, html in rows:
        for h in (h.split("/")[0] for h in html.split("http://")[1:]):
            if h != host[i]:
                links[place[host[i]], place[h]] += 1
    want = {}
    for kind, verdict, table in (("trust", "allow", links), ("distrust", "block", links.T)):
        seeds = np.zeros(n)
        for x in got:
            if x.rule and x.verdict == verdict:
                seeds[place[x.host]] += 1
        seeds /= seeds.sum()
        out = table.sum(axis=1, keepdims=True)
        step = np.where(out > 0, table / np.maximum(out, 1), seeds)
        want[kind] = np.linalg.solve(np.eye(n) - 0.85 * step.T, 0.15 * seeds)
    for x in got:
        assert abs(x.trust - want["trust"][place[x.host]]) < 1e-4 and abs(x.distrust - want["distrust"][place[x.host]]) < 1e-4


# -- languages
def segmentations(word, p, longest=6):
    """All ways to cut word into pieces, with their probabilities; a character without a piece is the unknown one."""
    if not word:
        return [([], 1.0)]
    out = []
    for k in range(1, min(len(word), longest) + 1):
        piece = word[:k] if word[:k] in p else "?" if k == 1 else None
        if piece:
            out += [([piece, *rest], p[piece] * q) for rest, q in segmentations(word[k:], p, longest)]
    return out


PIECES = ["a", "b", "ab", "ba", "aba", "c", "▁", "▁a", "bab", "."]


def table_of(model, lang):
    return {x: model.table[r, lang] for r, x in enumerate(["?", *PIECES])}


def test_forward_sum_is_over_all_segmentations(monkeypatch):
    model = langid.Model(["x", "y"], PIECES).fit([{"▁abab": 3, "▁abc": 1}, {"▁bbb": 2, "▁c.ab": 2}])
    strings = ["abab", "c", "", "▁ababababababa.bab", "▁bca", "zaz日", "▁▁"]
    for cells in (1 << 20, 20):
        monkeypatch.setattr(langid, "CELLS", cells)
        got = model.log_likelihood(*langid.code_points(pa.array(strings)))
        for lang in (0, 1):
            assert np.allclose(got[:, lang], [np.log(sum(q for _, q in segmentations(s, table_of(model, lang)))) for s in strings])


def test_long_words_do_not_underflow():
    model = langid.Model(["x", "y"], PIECES).fit([{"▁abab": 3, "▁abc": 1}, {"▁bbb": 2, "▁c.ab": 2}])
    one, many = model.log_likelihood(*langid.code_points(pa.array(["zzzz", "z" * 4000])))
    assert np.allclose(many, 1000 * one)


def test_expected_counts_are_over_all_segmentations():
    model = langid.Model(["x", "y"], PIECES).fit([{"▁abab": 3, "▁abc": 1}, {"▁bbb": 2, "▁c.ab": 2}])
    own = {"▁ababa": 3, "cab.": 2, "zbab": 5, "a": 1}
    got = model._expected(model._edges(own), model.table[:, 0])
    want = Counter()
    for w, n in own.items():
        paths = segmentations(w, table_of(model, 0))
        total = sum(q for _, q in paths)
        for pieces, q in paths:
            for x in pieces:
                want[x] += n * q / total
    assert np.allclose(got, [want[x] for x in ["?", *PIECES]])


def test_whole_vocabulary_is_used():
    pieces = langid.public_pieces()
    assert len(pieces) > 30_000 and {"▁international", "The", ",", "1"} <= set(pieces)
    assert not any("▁" in x.lstrip("▁") for x in pieces)


def test_language_on_held_out_rows(spark, docs):
    r, rows = random.Random(8), []
    parts = {"aa": ["the", "ing", "tion", "er"], "bb": ["der", "sch", "ung", "keit"]}
    for i in range(400):
        lang = r.choice(["aa", "bb"])
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(10)), lang))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, sample=50)
    got = {x.doc_id: x for x in langid.identify(table, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2)
    odd = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert odd[3].lang_pred == odd[4].lang_pred == odd[5].lang_pred == "und" and odd[3].score == 0
    assert langid.known_language(docs, model).columns == docs.columns
    long = frame(spark, [(1, "the" * 50_000), (2, "der sch " * 30_000), (3, "1 2 ." * 1000)])
    assert {x.doc_id: x.lang_pred for x in langid.identify(long, model).collect()} == {1: "aa", 2: "bb", 3: "und"}
    assert langid.identify(docs.where("false"), model).count() == 0 and langid.known_language(docs.where("false"), model).count() == 0
    assert {x.lang_pred for x in langid.identify(docs, langid.train(docs.where("false"))).collect()} == {"und"}


# -- tokens
def test_spliced_counts_equal_whole_counts():
    sp = token_counts.load()
    pairs = token_counts.joined_pairs(sp)
    texts = ["the cat  sat on 日本 mat \n" * 60, "a" * 700, " " * 500, "é日本語" * 150, " lead", "", "x <s> y </s> " * 40, "ab\n" * 300, "ab\t\r\ncd" * 90, "".join(chr(0x4E00 + 7 * i) for i in range(400)), "\x00▁▁a▁" * 80, "😀e\u0301" * 90]
    r = random.Random(1)
    texts += ["".join(r.choice("ab  \n.,é日語▁ABthe1") for _ in range(400)) for _ in range(20)]
    for t in texts:
        for chunk, overlap in ((40, 4), (100, 16), (7, 1)):
            assert token_counts.count_tokens(sp, pairs, t, chunk, overlap) == len(sp.encode(t))


def test_texts_without_spaces_are_spliced_too():
    sp = token_counts.load()
    seen = []
    spy = type("Spy", (), {"encode": lambda self, t, **k: (seen.append(len(t)), sp.encode(t, **k))[1]})()
    text = "ab\n" * 30_000
    assert token_counts.count_tokens(spy, token_counts.joined_pairs(sp), text, 1000, 50) == len(sp.encode(text)) and max(seen) <= 1100


def test_token_counts(spark, docs, nothing):
    sp = token_counts.load()
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, chunk=8, overlap=2).collect())
    assert got == sorted((i or -1, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in TEXTS)
    assert token_counts.token_counts(nothing).count() == 0


# -- vectors
def test_vectors(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=(60, 16))
    v = np.vstack([base, base[:20] + 0.05 * g.normal(size=(20, 16)), np.repeat(base[:1], 40, 0) + 0.02 * g.normal(size=(40, 16)), base[5:6], 3 * base[5:6]])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.95
    links = [(a, b) for a, b in zip(*np.nonzero(near)) if a < b]
    want = components(links, range(len(v)))
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] * 8), (904, [float("nan")] * 16), (905, [float("inf")] * 16), (None, base[0].tolist()), (906, base[0][:15].tolist())]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(table, shards=2).collect()}
    assert len(got) == len(rows) + len(odd)
    assert [got[i].n_links for i in range(len(v))] == (near.sum(1) - 1).tolist()
    assert {i: got[i].component_id for i in range(len(v))} == want
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd if i) and got[None].component_id is None
    assert embedding_dedup.near_vectors(table.where("false")).count() == 0


def test_groups_of_copies_and_of_near_vectors(spark, monkeypatch):
    """Thirds of all rows are one vector, and one dense group: counts are exact, in pieces far smaller than the pairs."""
    monkeypatch.setattr(embedding_dedup, "PAIRS", 500)
    g = np.random.default_rng(5)
    base = g.normal(size=(150, 12))
    v = np.vstack([base, np.repeat(base[:1], 200, 0), base[1:2] + 0.02 * g.normal(size=(200, 12))])[g.permutation(550)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.95
    want = components([(a, b) for a, b in zip(*np.nonzero(near)) if a < b], range(len(v)))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(table, shards=2).collect()}
    assert [got[i].n_links for i in range(len(v))] == (near.sum(1) - 1).tolist()
    assert {i: got[i].component_id for i in range(len(v))} == want


def test_joined_passes_over_what_is_joined():
    joined = embedding_dedup.Joined(6)
    a, b = np.array([0, 1, 2, 4]), np.array([1, 2, 0, 5])
    assert len(joined.add(a, b)) == 3 and len(joined.add(b, a)) == 0
    assert len(set(joined.label.tolist())) == 3


def test_shards_far_above_the_exhaustive_size(spark):
    """600 vectors a shard, so graphs are searched; against all products."""
    g = np.random.default_rng(11)
    base = g.normal(size=(900, 24))
    v = np.vstack([base, base[:250] + 0.04 * g.normal(size=(250, 24)), base[300:310].repeat(5, 0) + 0.03 * g.normal(size=(50, 24))])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T) >= 0.95
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(table, shards=2).collect()}
    links = np.array([got[i].n_links for i in range(len(v))])
    assert (links <= near.sum(1) - 1).all() and links.sum() >= 0.99 * (near.sum() - len(v))
    want = components([(a, b) for a, b in zip(*np.nonzero(near)) if a < b], range(len(v)))
    assert sum(got[i].component_id == want[i] for i in want) >= 0.99 * len(v)


def test_graph_recall():
    g = np.random.default_rng(1)
    x = g.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embedding_dedup.Graph(x, embedding_dedup.level_of(np.arange(3000))).build()
    ids, _ = graph.search(x[::30].astype(np.float32), 64)
    truth = np.argsort(-(x[::30] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids.tolist(), truth.tolist())]) >= 9


# -- packing
def test_patterns_hold_every_piece_once():
    r = random.Random(1)
    histogram = {r.randint(1, 64): r.randint(1, 30) for _ in range(30)}
    found = packing.patterns(histogram, 64)
    placed = Counter()
    for count, lengths in found:
        assert sum(lengths) <= 64
        for n in lengths:
            placed[n] += count
    assert placed == Counter(histogram)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_against_piece_by_piece_packing(seed):
    """Longest pieces first, each to the pack with the most room, if it fits there; what fits nowhere opens packs once its length is dealt."""
    r = random.Random(seed)
    histogram = {n: r.randint(1, 20) for n in r.sample(range(1, 65), 25)}
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        opened = 0
        for _ in range(histogram[length]):
            best = max(range(len(rooms)), key=rooms.__getitem__, default=None)
            if best is not None and rooms[best] >= length:
                rooms[best] -= length
            else:
                opened += 1
        rooms += [64 - length] * opened
    found = packing.patterns(histogram, 64)
    assert sorted(rooms) == sorted(64 - sum(lengths) for count, lengths in found for _ in range(count))


def test_encoder_gives_the_tokenizers_ids(monkeypatch):
    """Random texts of letters, marks, digits, special strings and odd characters; the cache is cleared on the way."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 3000)
    r = random.Random(4)
    alphabet = [*"abzABZéÉß'`!?.,#*&<|>_-019 \n\x01\u0301\u212aİ日ñÑſŉ\u00a0$[]", "  ", "<|endoftext|>", "n't", "word!!", "Word..."]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False)
    encoder = packing.Encoder()
    for i in range(0, len(texts), 500):
        for first, ids, at in encoder.encode(pa.array(texts[i : i + 500]), 100):
            for k, (a, b) in enumerate(zip(at[:-1], at[1:]), i + first):
                assert ids[a:b].tolist() == want[k].ids


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = [(20, "A\x01b <|endoftext|> <|startoftext|>x ΣΑΣ İstanbul é ﬁ  　 don't we'll 123 !!?"), (21, "long " * 300)]
    table = docs.select("doc_id", "text").unionByName(frame(spark, odd))
    rows = packing.pack(table, sequence=64).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in [*TEXTS, *odd]}
    own = Counter()
    fill: dict = {}
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        own[r.doc_id] += r.length
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert own == Counter({i: len(x) * (2 if i == 9 else 1) for i, x in ids.items()})
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(nothing).count() == 0
