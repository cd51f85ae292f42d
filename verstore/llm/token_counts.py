"""Token counts with overlap resynchronisation for huge documents."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from verstore.llm.common import chunks, in_batches, read, tidy

#: Characters of a chunk and of the first overlap; texts up to CHUNK + OVERLAP are encoded in one go.
CHUNK, OVERLAP, LIMIT = 1 << 15, 256, 4096
SPACE = "▁"


def load(path: str | None = None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))


def joined_pairs(sp) -> frozenset[str]:
    """All pairs of characters that stand side by side in some piece of the vocabulary.

    A merge makes a piece, so no merge ever crosses a place between two characters that are no such pair, and the
    tokens on either side of it don't depend on the other side: the place is a stable boundary.  So are the
    places before most spaces, at line ends, and between letters of scripts that the vocabulary spells out.
    """
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return frozenset(x[i : i + 2] for x in pieces for i in range(len(x) - 1))


def stable(pairs: frozenset[str], text: str, at: int) -> bool:
    return text[at - 1 : at + 1].replace(" ", SPACE) not in pairs


def ends(sp, text: str) -> np.ndarray:
    """The characters up to each token's end; a part of a character counts as the whole."""
    begun = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])
    return begun[[p.end for p in sp.encode(text, return_type="proto").pieces]]


def count_tokens(sp, pairs: frozenset[str], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """len(sp.encode(text)), from overlapping chunks where the text is longer than chunk + overlap.

    Each chunk reaches `overlap` characters into the next.  The splice is the
    first stable boundary in the overlap at which both encodings end a token;
    if there is none the overlap doubles, at last to the end of the text.
    The next chunk starts with the overlap's beginning, which is no boundary
    itself: its tokens before the splice are thrown away.
    """
    total, begin, cut = 0, 0, -1
    while True:
        reach = overlap
        while True:
            stop = begin + chunk + reach
            own = begin + ends(sp, text[begin:stop])
            if stop >= len(text):
                return total + int((own > cut).sum())
            seam = begin + chunk
            # The first encoding is not trusted at its own end, nor the second one at its start.
            both = np.intersect1d(own[(own > max(cut, seam)) & (own < stop)], seam + ends(sp, text[seam : seam + reach + chunk]))
            place = next((x for x in both.tolist() if stable(pairs, text, x)), None)
            if place is not None:
                break
            reach *= 2
        total += int(((own > cut) & (own <= place)).sum())
        begin, cut = seam, place


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    A null text is empty and has no tokens.  Rows are counted one by one, so
    repeated ids and rows repeat; other columns are not read.  A document of
    any length takes the memory of a few chunks beyond its text, unless it has no stable boundary
    for longer than that, as one letter repeated: overlaps then widen until there is one.  An empty table gives an empty result.
    """

    def run(batches):
        sp = load(path)
        pairs = joined_pairs(sp)
        for part in chunks(batches):
            texts = pc.fill_null(part.column("text"), "")
            rows = texts.to_pylist()
            short = [t for t in rows if len(t) <= chunk + overlap]
            counts = iter([len(x) for x in sp.encode(short, num_threads=1)] if short else [])
            n = [next(counts) if len(t) <= chunk + overlap else count_tokens(sp, pairs, t, chunk, overlap) for t in rows]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", "text")
    return in_batches(rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


SQL = None
