"""Token counts of whole texts, huge documents in parallel (operator 10).

Method: overlap resynchronisation.  A huge document is cut into chunks that overlap; every chunk is
encoded by itself, and the two encodings of an overlap are spliced at a boundary that both have, behind
the same token.  In byte-pair encoding a token sequence is the encoding of its text exactly when each
neighbouring pair of tokens is; left of the splice all pairs come from one encoding, right of it from the
other, and the pair across it stands in the right-hand one.  Where an overlap has no such boundary, the
document is encoded again with larger chunks and a wider overlap, up to one chunk for the whole of it.

Shorter documents are spliced the same way at boundaries that the vocabulary itself proves: if no piece has
a word mark behind another character, no merge crosses a space that follows a non-space.  A literal word mark is the
same as a space there, because the model writes spaces as that mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridion.session import materialize, table

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Documents of more characters than CHUNK_CHARS are encoded by chunks of that many, and OVERLAP_CHARS more.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Segments whose count a worker remembers; the memory that a worker needs is bounded by it.
REMEMBERED = 400_000

_MARK = "▁"
_SEGMENT = re.compile(" +[^ ]*")
_loaded: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """The sentencepiece model of a worker, and what its vocabulary proves."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        single = [self.model.is_byte(i) for i in range(n)]
        probe = "  Ａﬁ \t b "
        identity = self.model.normalize(probe) == _MARK + probe.replace(" ", _MARK)
        self.spaces_split = identity and not any(_MARK in p.lstrip(_MARK) for p, b in zip(pieces, single, strict=True) if not b)
        self.identity = identity
        self.width = np.array([1 if b else len(p.encode()) for p, b in zip(pieces, single, strict=True)], np.int64)
        self.unknown = self.model.unk_id()
        #: A last space by itself has no first letter for the encoder to put its mark before.
        self.last_space = {" ": len(self.model.encode("a ")) - len(self.model.encode("a"))}
        self.known = dict(self.last_space)

    def count_all(self, texts: list[str]) -> list[int]:
        """The library's number of tokens of each whole text."""
        if not self.spaces_split:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        if len(self.known) > REMEMBERED:
            self.known = dict(self.last_space)
        known = self.known
        parts = [_SEGMENT.findall(" " + t.replace(_MARK, " ")) if t else [] for t in texts]
        new = list({s for p in parts for s in p if s not in known})
        # A segment has its own word mark as its first space, which the encoder puts in front of any text.
        known.update(zip(new, map(len, self.model.encode([s[1:] for s in new], num_threads=1)), strict=True))
        return [sum(map(known.__getitem__, p)) for p in parts]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the bytes of normalised text up to the end of each."""
        ids = np.array(self.model.encode(text), np.int64)
        return ids, np.cumsum(self.width[ids]) if len(ids) else np.zeros(0, np.int64)


def _counter(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def _marked_bytes(text: str) -> int:
    return len(text.encode()) + 2 * text.count(" ")


def _count_small(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            n = counter.count_all(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk: int, overlap: int, id_type: pa.DataType):
    """Rows of one huge document: its pieces, each with the overlap that the next one begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, key, n_bytes, text in zip(*(b.column(c).to_pylist() for c in ("rid", "id", "n_bytes", "text")), strict=True):
                starts = range(0, len(text), chunk)
                for _, some in groupby(enumerate(starts), lambda x: x[0] // 64):
                    some = list(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([rid] * len(some), pa.int64()),
                            pa.array([key] * len(some), id_type),
                            pa.array([n_bytes] * len(some), pa.int64()),
                            pa.array([k for k, _ in some], pa.int32()),
                            pa.array([text[s : s + chunk + overlap] for _, s in some]),
                            pa.array([s + chunk < len(text) for _, s in some]),
                        ],
                        ["rid", "id", "n_bytes", "chunk", "piece", "followed"],
                    )

    return run


def _encode(path: str, chunk: int, overlap: int):
    """For each piece its tokens, and the boundaries inside the two overlaps.

    A boundary is one number: its distance from the overlap's end, then the token before it.  Those of an overlap
    follow each other, so the number of tokens before the first of them is enough.
    """

    def boundaries(ids: np.ndarray, ends: np.ndarray, end: int, length: int) -> tuple[list[int], int]:
        k = np.nonzero((ends > end - length) & (ends <= end))[0]
        return ((end - ends[k] << 32) + ids[k]).tolist(), int(k[0]) if len(k) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            n, head, tail = [], [], []
            for k, piece, followed in zip(*(b.column(c).to_pylist() for c in ("chunk", "piece", "followed")), strict=True):
                ids, ends = counter.encode(piece)
                n.append(len(ids))
                aligned = counter.identity and counter.unknown not in ids
                first, last = piece[:overlap], piece[chunk:]
                head.append(boundaries(ids, ends, _marked_bytes(first) + len(_MARK.encode()), _marked_bytes(first)) if k and aligned else ([], 0))
                tail.append(boundaries(ids, ends, int(ends[-1]), _marked_bytes(last)) if followed and aligned and len(ids) else ([], 0))
            edges = [pa.array([e[i] for e in side], kind) for side in (head, tail) for i, kind in ((0, pa.list_(pa.int64())), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("rid", "id", "n_bytes", "chunk")), pa.array(n, pa.int64()), *edges],
                ["rid", "id", "n_bytes", "chunk", "n", "head", "head_first", "tail", "tail_first"],
            )

    return run


def _count_huge(huge: DataFrame, path: str, chunk: int, overlap: int, id_ddl: str, id_arrow: pa.DataType) -> DataFrame:
    done = None
    while True:
        pieces = huge.mapInArrow(_cut(chunk, overlap, id_arrow), f"rid long, id {id_ddl}, n_bytes long, chunk int, piece string, followed boolean")
        encoded = materialize(
            pieces.repartition("rid", "chunk").mapInArrow(
                _encode(path, chunk, overlap), f"rid long, id {id_ddl}, n_bytes long, chunk int, n long, head array<long>, head_first long, tail array<long>, tail_first long"
            )
        )
        by_text = Window.partitionBy("rid").orderBy("chunk")
        spliced = encoded.select("*", *(F.lag(c).over(by_text).alias(f"prior_{c}") for c in ("n", "tail", "tail_first")))
        # Any boundary of both will do; the greatest number is the one nearest to the overlap's start.
        spliced = spliced.withColumn("at", F.array_max(F.array_intersect("head", "prior_tail")))
        left = F.col("prior_tail_first") + F.array_position("prior_tail", F.col("at"))
        right = F.col("head_first") + F.array_position("head", F.col("at"))
        seam = F.col("chunk") > 0
        counted = spliced.groupBy("rid").agg(
            F.first("id").alias("id"),
            F.first("n_bytes").alias("n_bytes"),
            F.sum(F.col("n") - F.when(seam, F.col("prior_n") - left + right).otherwise(0)).alias("n_tokens"),
            F.max(seam & F.col("at").isNull()).alias("open"),
        )
        closed = counted.filter(~F.col("open")).select("id", "n_bytes", "n_tokens")
        done = closed if done is None else done.unionByName(closed)
        failed = counted.filter("open").select("rid")
        if failed.isEmpty():
            return done
        huge = materialize(huge.join(failed, "rid", "left_semi"))
        chunk, overlap = 4 * chunk, 4 * overlap


def count_tokens(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> DataFrame:
    """(id, n_bytes, n_tokens): one row for each row of ``docs``.

    A null text counts as empty (no bytes, no tokens); a null id is kept; repeated rows give repeated rows; texts of any
    length are counted whole, and alike at any ``chunk_chars``; an empty table gives an empty one; other columns are not
    looked at.
    """
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("the overlap has to be shorter than a chunk")
    id_ddl = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    size = F.char_length("text")
    small = rows.filter(size <= chunk_chars).mapInArrow(_count_small(model_path), f"id {id_ddl}, n_bytes long, n_tokens long")
    # Numbers have to stay when a lost task runs again, so they are written down.
    huge = materialize(rows.filter(size > chunk_chars).withColumn("rid", F.monotonically_increasing_id()))
    from pyspark.sql.pandas.types import to_arrow_type

    out = small.unionByName(_count_huge(huge, model_path, chunk_chars, overlap_chars, id_ddl, to_arrow_type(docs.schema[id_col].dataType)))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
