"""Removal of byte strings that documents of smaller id have: a sparse suffix array in Spark."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verstore.llm.common import cut, read, share, taken

#: Bytes of a string that counts as repeated; of the leading part by which suffixes are sampled and sorted.
LENGTH, LEAD = 50, 24
#: Bytes of text in a block of documents, about; anchors in a bucket, about.
BLOCK, BUCKET = 8 << 20, 1 << 20
PIECE = 1 << 19
#: Blocks of sampled documents from which splitters come, least and most, and suffixes sampled from each; rows sorted at once by the library.
SAMPLED, LEADS, LEAF = (4, 256), 8192, 1 << 14
REACH = LENGTH - LEAD
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * A
    return x ^ (x >> np.uint64(29))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number."""
    word = data.astype(np.uint64)
    for k in (1, 2, 4):
        word = (word[:-k] << np.uint64(8 * k)) | word[k:]
    return word


def lead_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the LEAD bytes from each place at which they fit."""
    word = eights(data)
    n = len(data) - LEAD + 1
    out = scramble(word[:n])
    for k in range(8, LEAD, 8):
        out = scramble(out * B + word[k : k + n])
    return out


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of rows of bytes by multikey quicksort, eight bytes a character.

    A range of rows that agree so far is split in three by a pivot of the next character; those equal to
    it go on with the character after.  Ranges of LEAF rows or fewer are finished by the library.
    """
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(">u8").astype(np.uint64)
    order, todo = np.arange(len(rows)), [(0, len(rows), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        own = order[lo:hi]
        if hi - lo <= LEAF:
            order[lo:hi] = own[np.lexsort(words[own, depth:].T[::-1])]
            continue
        column = words[own, depth]
        pivot = np.sort(column[:: max(1, len(column) // 255)])[min(127, (len(column) - 1) // 2)]
        less, more = column < pivot, column > pivot
        parts = own[less], own[~less & ~more], own[more]
        order[lo:hi] = np.concatenate(parts)
        for part, deeper in zip(parts, (0, 1, 0)):
            todo.append((lo, lo + len(part), depth + deeper))
            lo += len(part)
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many first bytes each row shares with the one before it in order; -1 for the first row."""
    out = np.full(len(order), -1, np.int16)
    for i in range(1, len(order), 1 << 16):
        some = rows[order[i - 1 : i + (1 << 16)]]
        differ = some[1:] != some[:-1]
        out[i : i + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def groups(order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """For each row a number that it has in common with those that agree in the first `length` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < length)
    return out


def anchors(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, key) of the sampled suffixes of all documents in data.

    Every string of LENGTH bytes samples, of the suffixes that start in it
    with LEAD bytes inside it, the one with the least hash of these bytes, the leftmost of equal ones.
    Equal strings sample the same place, so strings that repeat meet at their anchors.
    """
    span = REACH + 1
    found = []
    end = start + size
    i = 0
    while i < len(start):
        # Documents of about PIECE bytes together; long ones in pieces that overlap by a string.
        j = int(np.searchsorted(end, start[i] + PIECE, side="right"))
        if j > i:
            jobs, i = [(int(start[i]), int(end[j - 1]), i, j)], j
        else:
            jobs, i = [(a, min(a + PIECE + LENGTH - 1, int(end[i])), i, i + 1) for a in range(int(start[i]), max(int(start[i]) + 1, int(end[i]) - LENGTH + 1), PIECE)], i + 1
        for a, b, lo, hi in jobs:
            if b - a < LENGTH:
                continue
            keys = lead_hashes(data[a:b])
            low = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
            width = 1
            while width < span:
                step = min(width, span - width)
                low = np.minimum(low[:-step], low[step:])
                width += step
            ok = np.zeros(b - a + 1, np.int32)
            first, last = np.maximum(start[lo:hi], a), np.minimum(end[lo:hi], b) - LENGTH + 1
            fits = last > first
            np.add.at(ok, first[fits] - a, 1)
            np.add.at(ok, last[fits] - a, -1)
            place = (low & np.uint64(0xFFFFFFFF))[np.cumsum(ok)[: len(low)] > 0].astype(np.int64)
            place = place[np.concatenate([[True], np.diff(place) != 0])] if len(place) else place
            # Least hashes are small: mixed anew, one to one, they are spread evenly.
            found.append((place + a, scramble(keys[place] * B + A)))
    place = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    key = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
    once = np.concatenate([[True], np.diff(place) != 0]) if len(place) else np.zeros(0, bool)
    place, key = place[once], key[once]
    return np.searchsorted(start, place, side="right") - 1, place, key


class Block:
    """A block's texts as one array, with their anchors grouped by key and bucket in a fixed order."""

    def __init__(self, table: pa.Table, buckets: int):
        ids = table.column("doc_id").combine_chunks()
        texts = pc.fill_null(table.column("text").combine_chunks().cast(pa.large_binary()), b"")
        order = pc.sort_indices(ids) if len(ids) else pa.array([], pa.int64())
        self.ids, texts = ids.take(order), texts.take(order)
        texts = pa.concat_arrays([texts]) if texts.offset else texts
        at = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        # Empty texts take no place of their own; they are left out of the search.
        self.all_start, self.all_size = at[:-1], np.diff(at)
        full = self.all_size > 0
        self.start, self.size = self.all_start[full], self.all_size[full]
        self.doc = self.ids.filter(pa.array(full)).to_numpy(zero_copy_only=False) if len(self.ids) else np.zeros(0, np.int64)
        row, place, key = anchors(self.data, self.start, self.size)
        order = np.argsort(key, kind="stable")
        self.row, self.place, self.key = row[order], place[order], key[order]
        self.first = np.flatnonzero(np.concatenate([[True], np.diff(self.key) != 0])) if len(self.key) else np.zeros(0, np.int64)
        self.buckets = buckets
        # Keys are spread evenly, so equal splitters deal the leading parts out evenly.
        self.bound = np.searchsorted(self.key[self.first] >> np.uint64(32), (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets))

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """Bytes from REACH before the anchors to LENGTH after; the sides of a document are 0."""
        begin = self.place[at] - REACH
        lo = self.start[self.row[at]]
        hi = lo + self.size[self.row[at]]
        around = np.concatenate([np.zeros(REACH, np.uint8), self.data, np.zeros(LENGTH, np.uint8)])
        out = sliding_window_view(around, REACH + LENGTH)[begin + REACH]
        edge, column = np.flatnonzero((begin < lo) | (begin + REACH + LENGTH > hi)), np.arange(REACH + LENGTH)
        out[edge] *= (column >= (lo - begin)[edge, None]) & (column < (hi - begin)[edge, None])
        return out

    def leads(self, at: np.ndarray) -> np.ndarray:
        """The LEAD bytes from each anchor on, as byte strings that compare like them."""
        out = sliding_window_view(self.data, LEAD)[self.place[at]] if len(at) else np.zeros((0, LEAD), np.uint8)
        return out.view(f"S{LEAD}").ravel()

    def fits(self, at: np.ndarray) -> np.ndarray:
        """By anchor the first and last place in its context at which a string lies inside the document."""
        lo = self.start[self.row[at]]
        hi = lo + self.size[self.row[at]]
        begin = self.place[at] - REACH
        return np.stack([np.maximum(0, lo - begin), np.minimum(REACH, hi - LENGTH - begin)]).astype(np.int8)


def squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def stretch(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def deltas(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, byte plane by byte plane."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T if len(keys) else np.zeros((8, 0), np.uint8)


def undelta(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


MESSAGE = "block long, bucket long, n long, payload binary"


def message(rows) -> pa.Table:
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int64()), "n": pa.array([r[2] for r in rows], pa.int64()), "payload": pa.array([r[3] for r in rows], pa.binary())})


def send_keys(table: pa.Table, buckets: int) -> pa.Table:
    """To each bucket the block's distinct keys and whether several documents of the block have each."""
    block, b = table.column("block")[0].as_py(), Block(table, buckets)
    key = b.key[b.first]
    many = np.maximum.reduceat(b.row, b.first) != np.minimum.reduceat(b.row, b.first) if len(b.first) else np.zeros(0, bool)
    rows = []
    for k, (lo, hi) in enumerate(zip(b.bound[:-1], b.bound[1:])):
        if hi > lo:
            rows.append((block, k, int(hi - lo), squeeze(deltas(key[lo:hi]), np.packbits(many[lo:hi]))))
    return message(rows)


def repeated_keys(table: pa.Table) -> pa.Table:
    """Back to each block, a bit for each of its keys: whether other documents have it too."""
    raw = [(r["block"], r["bucket"], r["n"], stretch(r["payload"])) for r in table.to_pylist()]
    keys = [undelta(p[: 8 * n]) for _, _, n, p in raw]
    flags = [np.unpackbits(np.frombuffer(p[8 * n :], np.uint8), count=n).astype(bool) for _, _, n, p in raw]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    run = np.cumsum(np.concatenate([[0], np.diff(every[order]) != 0]))
    wide = (np.bincount(run) > 1)[run]
    back = np.empty(len(every), bool)
    back[order] = wide
    back |= np.concatenate(flags)
    at = np.concatenate([[0], np.cumsum([n for _, _, n, _ in raw])])
    return message([(block, bucket, n, squeeze(np.packbits(back[a : a + n]))) for (block, bucket, n, _), a in zip(raw, at)])


def rows_hash(rows: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each row of bytes."""
    wide = rows.shape[1] + (-rows.shape[1]) % 8
    padded = np.zeros((len(rows), wide), np.uint8)
    padded[:, : rows.shape[1]] = rows
    out = [np.zeros(len(rows), np.uint64), np.full(len(rows), A)]
    for column in padded.view(np.uint64).T:
        out = [scramble(h * m + column + m) for h, m in zip(out, (B, A))]
    return out


def first_of_each(signs: list[np.ndarray], *rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's class by its signs, and of each class the row of the least rank; classes go by the ranks after the first."""
    order = np.lexsort((rank[0], *signs, *rank[1:]))
    new = np.concatenate([[True], np.any([np.diff(x[order]) != 0 for x in signs], axis=0)]) if len(order) else np.zeros(0, bool)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    return own, order[new]


class Ranges:
    """Splitters of leading bytes, and the leads so frequent that their strings are dealt one by one."""

    def __init__(self, leads: np.ndarray, buckets: int):
        leads = np.sort(leads)
        cuts = leads[np.arange(1, buckets) * len(leads) // buckets] if len(leads) else leads
        self.splitters, count = np.unique(cuts, return_counts=True)
        self.hot, self.buckets = self.splitters[count > 1], buckets

    def of(self, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By lead its bucket, and whether it is a frequent one."""
        at = np.searchsorted(self.splitters, leads, side="right")
        return at, np.isin(leads, self.hot) if len(self.hot) else np.zeros(len(leads), bool)


class Shared:
    """A block's anchors with repeated keys, and the one of each context that speaks for it.

    Anchors with the same surroundings form one class; the one of the smallest
    document is sent to the bucket whose range its lead is in.  For frequent leads, every string around the
    anchor is sent by itself, to a bucket by its hash.  All passes over a block build the same classes in the same order.
    """

    def __init__(self, b: Block, bits: dict[int, np.ndarray], ranges: Ranges):
        every = self.repeated(b, bits)
        bucket, hot = ranges.of(b.leads(every))
        self.at, bucket = every[~hot], bucket[~hot]
        self.fits, signs = b.fits(self.at), [np.zeros(len(self.at), np.uint64) for _ in (0, 1)]
        for i in range(0, len(self.at), 1 << 18):
            part = self.at[i : i + (1 << 18)]
            for sign, own in zip(signs, rows_hash(np.hstack([b.contexts(part), self.fits[:, i : i + len(part)].T.view(np.uint8)]))):
                sign[i : i + len(part)] = own
        self.cls, self.speaker = first_of_each(signs, b.row[self.at], bucket)  # speakers: into at
        self.bound = np.searchsorted(bucket[self.speaker], np.arange(ranges.buckets + 1))
        self._strings(b, every[hot], ranges.buckets)

    @staticmethod
    def repeated(b: Block, bits: dict[int, np.ndarray]) -> np.ndarray:
        wanted = np.concatenate([bits.get(k, np.zeros(hi - lo, bool)) for k, (lo, hi) in enumerate(zip(b.bound[:-1], b.bound[1:]))]) if len(b.first) else np.zeros(0, bool)
        return np.flatnonzero(np.repeat(wanted, np.diff(np.append(b.first, len(b.key)))))

    def _strings(self, b: Block, hot: np.ndarray, buckets: int) -> None:
        """place, row: where strings around frequent leads start; string_cls, string_speaker, string_bound as for contexts."""
        fits, spots = b.fits(hot), np.zeros(len(b.data), bool)
        for k in range(REACH + 1):
            spots[(b.place[hot] - REACH + k)[(fits[0] <= k) & (k <= fits[1])]] = True
        self.place = np.flatnonzero(spots)
        self.row = np.searchsorted(b.start, self.place, side="right") - 1
        signs = [np.zeros(len(self.place), np.uint64), np.full(len(self.place), A)]
        if len(self.place):
            word = eights(b.data)
            for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
                signs = [scramble(h * m + word[self.place + k] + m) for h, m in zip(signs, (B, A))]
        bucket = (signs[0] % np.uint64(buckets)).astype(np.int64)
        self.string_cls, self.string_speaker = first_of_each(signs, self.row, bucket)
        self.string_bound = np.searchsorted(bucket[self.string_speaker], np.arange(buckets + 1))


def bits_of(table: pa.Table) -> dict[int, np.ndarray]:
    return {r["bucket"]: np.unpackbits(np.frombuffer(stretch(r["payload"]), np.uint8), count=r["n"]).astype(bool) for r in table.to_pylist()}


def sample_leads(docs: pa.Table) -> pa.Table:
    """Leads of the block's suffixes, at even distances in its texts and those of one surrounding once, at most LEADS."""
    b = Block(docs, 1)
    at = np.argsort(b.place)
    at = at[:: max(1, -(-len(at) // (2 * LEADS)))]
    _, speaker = first_of_each(rows_hash(b.contexts(at)), b.row[at])
    return pa.table({"lead": pa.array([x.ljust(LEAD, b"\0") for x in b.leads(at[speaker[:LEADS]]).tolist()], pa.binary())})


def send_contexts(docs: pa.Table, replies: pa.Table, buckets: int, ranges: Ranges) -> pa.Table:
    """To each bucket the distinct surroundings of the block's repeated keys in its range, each with its smallest document.

    Messages of single strings have a negative n.
    """
    block, b = docs.column("block")[0].as_py() if len(docs) else -1, Block(docs, buckets)
    s = Shared(b, bits_of(replies), ranges)
    rows = []
    for k, (lo, hi) in enumerate(zip(s.bound[:-1], s.bound[1:])):
        if hi > lo:
            own = s.at[s.speaker[lo:hi]]
            rows.append((block, k, int(hi - lo), squeeze(b.contexts(own), s.fits[:, s.speaker[lo:hi]], b.doc[b.row[own]].astype(np.int64))))
    for k, (lo, hi) in enumerate(zip(s.string_bound[:-1], s.string_bound[1:])):
        if hi > lo:
            own = s.string_speaker[lo:hi]
            text = np.stack([b.data[s.place[own] + i] for i in range(LENGTH)], axis=1)
            rows.append((block, k, int(lo - hi), squeeze(text, b.doc[s.row[own]].astype(np.int64))))
    return message(rows)


def least_of(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest doc of each row's group."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
    out = np.empty(len(group), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(group))))
    return out


def earlier(table: pa.Table) -> pa.Table:
    """Back to each block, by context a bit for each place: whether a smaller document has the string that starts there.

    A bucket holds all suffixes whose lead is in its range, so no string has a match across its boundaries.  The
    suffixes are sorted by multikey quicksort, and what precedes them too, from right to left;
    neighbours compared give the lengths they share.  Two contexts have the string of `left` bytes before and
    LENGTH - left from the anchor on in common if they are in one group of either order, so nothing rests on a hash.
    """
    raw = [(r["block"], r["bucket"], r["n"], stretch(r["payload"])) for r in table.to_pylist()]
    whole, single = [r for r in raw if r[2] > 0], [r for r in raw if r[2] < 0]
    return pa.concat_tables([earlier_contexts(whole) if whole else message([]), earlier_strings(single) if single else message([])])


def earlier_contexts(raw: list[tuple]) -> pa.Table:
    width = REACH + LENGTH
    text = np.concatenate([np.frombuffer(p, np.uint8, n * width).reshape(n, width) for _, _, n, p in raw])
    fits = np.concatenate([np.frombuffer(p, np.int8, 2 * n, n * width).reshape(2, n) for _, _, n, p in raw], axis=1)
    doc = np.concatenate([np.frombuffer(p, np.int64, n, n * (width + 2)) for _, _, n, p in raw])
    # Surroundings that several blocks sent are compared once, as those of their smallest document.
    own, speaker = first_of_each(rows_hash(np.hstack([text, fits.T.view(np.uint8)])), doc)
    inside = fits
    text, fits, least_doc = text[speaker], fits[:, speaker], doc[speaker]
    after, before = text[:, REACH:], np.ascontiguousarray(text[:, :REACH][:, ::-1])
    after_order, before_order = multikey_order(after), multikey_order(before)
    after_shared, before_shared = common_prefixes(after, after_order), common_prefixes(before, before_order)
    mask = np.zeros(len(text), np.uint32)
    for k in range(REACH + 1):
        here = np.flatnonzero((fits[0] <= k) & (k <= fits[1]))
        if not len(here):
            continue
        group = (groups(after_order, after_shared, LEAD + k) << 32) + groups(before_order, before_shared, REACH - k)
        mask[here[least_doc[here] > least_of(group[here], least_doc[here])]] |= np.uint32(1 << k)
    places = np.arange(REACH + 1)[:, None]
    full = np.where((inside[0] <= places) & (places <= inside[1]), np.uint32(1) << places.astype(np.uint32), np.uint32(0)).sum(axis=0, dtype=np.uint32)
    mask = np.where(doc > least_doc[own], full, mask[own])
    at = np.concatenate([[0], np.cumsum([n for _, _, n, _ in raw])])
    return message([(block, bucket, n, squeeze(mask[a : a + n])) for (block, bucket, n, _), a in zip(raw, at)])


def earlier_strings(raw: list[tuple]) -> pa.Table:
    """As above for single strings: a bit for each."""
    text = np.concatenate([np.frombuffer(p, np.uint8, -n * LENGTH).reshape(-n, LENGTH) for _, _, n, p in raw])
    doc = np.concatenate([np.frombuffer(p, np.int64, -n, -n * LENGTH) for _, _, n, p in raw])
    order = multikey_order(text)
    found = doc > least_of(groups(order, common_prefixes(text, order), LENGTH), doc)
    at = np.concatenate([[0], np.cumsum([-n for _, _, n, _ in raw])])
    return message([(block, bucket, n, squeeze(np.packbits(found[a : a - n]))) for (block, bucket, n, _), a in zip(raw, at)])


def covered(b: Block, s: Shared, replies: pa.Table) -> np.ndarray:
    """By byte of the block: whether it is removed."""
    mask, found = np.zeros(len(s.speaker), np.uint32), np.zeros(len(s.string_speaker), bool)
    for r in replies.to_pylist():
        if r["n"] > 0:
            lo = s.bound[r["bucket"]]
            mask[lo : lo + r["n"]] = np.frombuffer(stretch(r["payload"]), np.uint32)
        else:
            lo = s.string_bound[r["bucket"]]
            found[lo : lo - r["n"]] = np.unpackbits(np.frombuffer(stretch(r["payload"]), np.uint8), count=-r["n"]).astype(bool)
    own = mask[s.cls] if len(s.cls) else np.zeros(0, np.uint32)
    doc = b.doc[b.row[s.at]]
    later = doc > doc[s.speaker][s.cls] if len(s.cls) else np.zeros(0, bool)
    starts = np.zeros(len(b.data), bool)
    for k in range(REACH + 1):
        hit = ((own >> np.uint32(k)) & np.uint32(1)).astype(bool) | (later & (s.fits[0] <= k) & (k <= s.fits[1]))
        starts[b.place[s.at[hit]] - REACH + k] = True
    if len(s.place):
        doc = b.doc[s.row]
        starts[s.place[found[s.string_cls] | (doc > doc[s.string_speaker][s.string_cls])]] = True
    begin = np.flatnonzero(starts)
    gone = np.zeros(len(b.data), bool)
    # Strings that touch or overlap are one run.
    first = np.flatnonzero(np.diff(begin, prepend=-LENGTH - 1) > LENGTH)
    for lo, hi in zip(begin[first].tolist(), (begin[np.append(first[1:], len(begin)) - 1] + LENGTH).tolist() if len(begin) else []):
        gone[lo:hi] = True
    return gone


def strip(docs: pa.Table, replies: pa.Table, masks: pa.Table, buckets: int, ranges: Ranges, texts: bool) -> pa.Table:
    b = Block(docs, buckets)
    gone = covered(b, Shared(b, bits_of(replies), ranges), masks)
    rows: list[list] = [[], [], [], [], []]
    for lo, n in zip(b.all_start.tolist(), b.all_size.tolist()):
        own, data = gone[lo : lo + n], b.data[lo : lo + n]
        keep = data[~own].tobytes()
        for column, value in zip(rows, (n, int(own.sum()), int((np.diff(own.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(keep).hexdigest(), keep)):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    out = {"doc_id": b.ids} | {name: pa.array(x, t) for name, x, t in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), rows, kinds)}
    return pa.table(out if texts else {k: v for k, v in out.items() if k != "kept"})


def even(spark: SparkSession, n: int) -> int:
    """About n blocks, as many for one task as for another where there are more blocks than tasks."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, n) if n <= tasks else round(n / tasks) * tasks


def labels(spark: SparkSession, n: int) -> DataFrame:
    """(i, label) for i from 0 to n - 1: distinct labels that a shuffle by label deals evenly to its tasks."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = spark.range(4 * n + 64 * tasks).select(F.col("id").alias("label"), F.pmod(F.hash("id"), F.lit(tasks)).alias("task"))
    turn = F.row_number().over(Window.partitionBy("task").orderBy("label")) - 1
    return numbers.select((F.col("task") + F.lit(tasks) * turn.cast("long")).alias("i"), "label").where(F.col("i") < n)


def repeated_strings(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with `texts` the remaining bytes, kept) for each row of docs.

    A byte goes if a string of 50 bytes around it also starts in a document of
    smaller id.  A null text is empty; documents under 50 bytes lose nothing.  A
    null id counts as larger than all others, and rows of equal ids are one
    document to each other: neither removes from the other.  Texts of any length are
    read as a whole, other columns not at all.  An empty table gives an empty result.

    The suffix array is sparse: of each 50-byte string one suffix is sampled, by the bytes that it leads with, so
    equal strings sample the same one.  Documents are dealt to blocks.  First, blocks learn which of their
    suffixes' leads any other document has; the others are done with.  The rest is dealt to
    buckets by ranges of leading bytes, at splitters sampled beforehand, each distinct surrounding once a
    block; buckets sort by multikey quicksort, compare neighbours and answer which strings a smaller
    document has; blocks apply the answers.  A lead that would fill a range by itself is dealt by whole strings instead.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    blocks, buckets = even(spark, total // BLOCK), max(1, total // 14 // BUCKET)
    names = cut(labels(spark, max(blocks, buckets)))
    missing = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id")
    by = lambda df, key: df.groupBy(key)
    named = lambda df, key: df.join(F.broadcast(names.withColumnRenamed("i", key)), key)

    few = min(max(SAMPLED[0], buckets // 512), SAMPLED[1])
    sample = rows.sample(min(1.0, few * BLOCK / max(1, total)), seed=1).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(few)).alias("block"), missing, "text")
    leads = by(sample, "block").applyInArrow(sample_leads, "lead binary").collect()
    shared = share(spark, Ranges(np.array([bytes(r.lead) for r in leads], f"S{LEAD}"), buckets))

    dealt = named(rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("part"), missing, "text"), "part").select(F.col("label").alias("block"), "doc_id", "text")
    keys = by(dealt, "block").applyInArrow(lambda t: send_keys(t, buckets), MESSAGE)
    repeats = by(named(keys, "bucket"), "label").applyInArrow(repeated_keys, MESSAGE)
    both = by(dealt, "block").cogroup(by(repeats, "block"))
    contexts = both.applyInArrow(lambda d, r: send_contexts(d, r, buckets, taken(shared)), MESSAGE)
    masks = by(named(contexts, "bucket"), "label").applyInArrow(earlier, MESSAGE)
    answers = repeats.withColumn("kind", F.lit(0)).unionByName(masks.withColumn("kind", F.lit(1)))

    def apply(d: pa.Table, r: pa.Table) -> pa.Table:
        kind = r.column("kind").to_numpy() if len(r) else np.zeros(0)
        return strip(d, r.filter(pa.array(kind == 0)), r.filter(pa.array(kind == 1)), buckets, taken(shared), texts)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    out = by(dealt, "block").cogroup(by(answers, "block")).applyInArrow(apply, schema)
    return out.withColumn("doc_id", F.when(F.col("doc_id") < 2**63 - 1, F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(read(spark, sf_dir, "documents"))


SQL = None
