"""SentencePiece encoding and decoding through a distinct-chunk table.

The model's pieces carry white-space markers only in front, so no piece crosses the start of a run
of spaces. Each distinct marked word is segmented, and its ids decoded, once; ids and texts are
joined back by position. Texts that hold the marker character itself take the library's own path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkTable, cut_at_space_after_other, slabs, utf8
from .common import documents

MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """One model with its table: encode to ids with begin and end, and decode those ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces cross white-space markers: the chunk table does not apply")
        self.ids = ChunkTable(self._segment)
        self.guard = self.sp.encode("x")
        self.texts: list[str] = []

    def _segment(self, chunks: list[bytes]) -> list[list[int]]:
        # Every chunk starts with the space that the library would add in front, so that goes.
        got = self.sp.encode([c[1:].decode("utf-8", "replace") for c in chunks], num_threads=1)
        if b" " in chunks:  # a lone marker at the end of a text; the library gives an empty text no marker
            got[chunks.index(b" ")] = self.sp.encode("x ")[len(self.guard):]
        if not self.ids.at:
            self.texts = []
        # Decoding drops the first marker of a text, which every chunk has.
        self.texts += [" " + t for t in self.sp.decode(got, num_threads=1)]
        return got

    def whole(self, text: str) -> tuple[np.ndarray, str]:
        ids = self.sp.encode(text, add_bos=True, add_eos=True)
        return np.asarray(ids, "<u4"), self.sp.decode(ids)

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, str]]:
        """(ids with begin and end, decoded text) of each text."""
        odd = np.asarray(pc.fill_null(pc.match_substring(texts, MARK), False))
        plain = pc.if_else(pa.array(odd), "", pc.fill_null(texts, ""))
        marked = pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise("", plain, " "))
        rows, place, before = self.ids.cut(*utf8(marked), cut_at_space_after_other)
        ids, at = self.ids.join(rows[place], before)
        shown, ends = utf8(pa.array([self.texts[r] for r in rows.tolist()], pa.large_string()).take(pa.array(place)))
        shown, ends = shown.tobytes(), ends[before]
        bos, eos = np.array([self.sp.bos_id()], "<u4"), np.array([self.sp.eos_id()], "<u4")
        for i in range(len(texts)):
            if odd[i]:
                yield self.whole(texts[i].as_py())
            else:
                yield np.concatenate([bos, ids[at[i]:at[i + 1]].astype("<u4"), eos]), shown[ends[i] + 1:ends[i + 1]].decode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _coded(model: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slabs(texts):
                n, left, right = [], [], []
                for got, back in c.batch(texts.slice(a, b - a)):
                    n.append(len(got))
                    left.append(hashlib.sha256(got.tobytes()).hexdigest() if digests else got.tobytes())
                    right.append(hashlib.sha256(back.encode()).hexdigest() if digests else back)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(left, pa.string() if digests else pa.binary()), pa.array(right, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"])

    return run


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, begin and end included) and the decoded text.

    Null text counts as empty, which gives the begin and end ids and an empty text. Repeated rows give
    repeated rows; other columns are not read; an empty table gives no rows. ``model`` must be readable
    on every executor.
    """
    return docs.select("doc_id", "text").mapInArrow(_coded(model or default_model(), False), SCHEMA)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of ``encode_decode``, taken inside the task so that ids and texts never leave it."""
    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(_coded(default_model(), True), DIGESTS)
