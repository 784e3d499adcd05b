"""Stretches of words that repeat with a period (operator 12).

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)`` long, that no neighbouring word extends.
Every word of a run is in it four times (with period one: six times).  So a word that is rarer than that within its
segment is in no run of the segment and splits it; the parts are counted anew and split again until nothing changes.
Few words survive.  Their segments are scanned by lags: for the powers of two k, the lag of a position is its distance
to the next position with the same k words behind it.  Where a stretch of m positions has one lag q with k / 2 < q <= k,
the words from its start on have the period q for m + q + k - 1 words and no smaller one, and every run is found at
exactly one k.  That takes n log n steps for a segment of n words, however many periods it has.

All texts of a block of bounded size are split and scanned together by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.session import table

# Fixed values of the contract.
LEAST_LENGTH = 6
LEAST_REPEATS = 4
#: Bytes of text that are worked on together; a longer text is worked on by itself.
BLOCK_BYTES = 4 << 20
WORDS = r"[^\x20\x09-\x0D]+"


def _codes(values: np.ndarray) -> np.ndarray:
    return pd.factorize(values)[0].astype(np.int64)


def _segments(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, segments) of the words that are left after splitting at rare words until nothing changes."""
    at, seg = np.arange(len(words)), docs
    while len(at):
        keys = _codes(seg * (int(words.max()) + 1) + words[at])
        common = np.bincount(keys)[keys] >= LEAST_REPEATS
        here = at[common]
        new = np.ones(len(here), bool)
        new[1:] = (np.diff(here) != 1) | (np.diff(seg[common]) != 0)
        parts = np.cumsum(new) - 1
        long = np.bincount(parts, minlength=1)[parts] >= LEAST_LENGTH if len(parts) else np.zeros(0, bool)
        before, at, seg = len(at), here[long], parts[long]
        if len(at) == before:
            break
    return at, seg


def _runs(words: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, starts as indexes into ``words``; none crosses a change of ``seg``."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    names, pos, k = _codes(seg * (int(words.max()) + 1) + words) if len(words) else words, np.arange(len(words)), 1
    sizes = np.bincount(seg) if len(seg) else np.zeros(1, np.int64)
    while len(pos):
        # ``names[i]`` stands for the k words from ``pos[i]`` on, inside one segment.
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        lag = np.zeros(len(pos), np.int64)
        lag[order[:-1][same]] = (pos[order[1:]] - pos[order[:-1]])[same]
        fits = (lag > k // 2) & (lag <= k)
        begins = fits.copy()
        begins[1:] &= (lag[1:] != lag[:-1]) | (np.diff(pos) != 1) | (seg[pos[1:]] != seg[pos[:-1]])
        start = np.flatnonzero(begins)
        if len(start):
            # A stretch ends before the next one begins or before a position without its lag.
            breaks = np.flatnonzero(begins | ~fits)
            nxt = np.searchsorted(breaks, start, side="right")
            ends = np.append(breaks, len(pos))[nxt]
            period = lag[start]
            length = ends - start + period + k - 1
            good = length >= np.maximum(LEAST_LENGTH, LEAST_REPEATS * period)
            found.append((pos[start[good]], length[good], period[good]))
        # The next power of two, in segments that are long enough for a period of more than k words.
        there = pos[sizes[seg[pos]] >= LEAST_REPEATS * (k + 1)]
        there = there[there + k < len(words)]
        place = np.full(len(words) + 1, -1, np.int64)
        place[pos] = names
        both = there[(place[there + k] >= 0) & (seg[there + k] == seg[there])]
        if not len(both):
            break
        names, pos, k = _codes(place[both] * (int(names.max()) + 1) + place[both + k]), both, 2 * k
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period), by text, start and period, of the runs of each text's words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    none = np.zeros(0, np.int64)
    if not first[-1]:
        return none, none, none, none
    numbers: dict[bytes, int] = {}
    words = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int64)
    at, seg = _segments(words, np.repeat(np.arange(len(texts)), sizes))
    start, length, period = _runs(words[at], seg)
    start = at[start]
    text = np.searchsorted(first, start, side="right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - first[text])[order], length[order], period[order]


def _collapsed(words: list[bytes], starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> bytes:
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, starts + periods, 1)
    np.add.at(gone, starts + lengths, -1)
    kept = np.cumsum(gone[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def _blocks(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    block, size = [], 0
    for t in texts:
        raw = b"" if t is None else t.encode()
        if block and size + len(raw) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(raw.split())  # bytes are split at exactly the six characters that end a word
        size += len(raw)
    if block:
        yield block


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches:
        rows, done = b.column("row"), 0
        for block in _blocks(b.column("text").to_pylist()):
            text, start, length, period = runs_of(block)
            upto = np.searchsorted(text, np.arange(len(block) + 1))
            values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), values).cast(kind)
            left = []
            for k, words in enumerate(block):
                i, j = upto[k], upto[k + 1]
                left.append((b" ".join(words) if i == j else _collapsed(words, start[i:j], length[i:j], period[i:j])).decode())
            n = pa.array([len(w) for w in block], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.slice(done, len(block)), n, runs, pa.array(left, pa.string())], ["row", "n_words", "runs", "collapsed"])
            done += len(block)


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, n_words, runs, collapsed): for each row of ``docs`` the runs of its whole text and the text without them.

    ``runs`` are (start, length, period) in words from 0, by start, then period.  A word is dropped from ``collapsed`` if
    a run has it behind its first ``period`` words; what is left is joined by single spaces.  A null text has no
    words, like an empty one: no runs and an empty ``collapsed``.  Repeated rows are worked on each, an empty table
    gives an empty one, and texts of any length are read whole (one text has to fit a task).  ``row`` keeps all other
    columns in a struct, so no name can clash.  Rows stay in their partitions; nothing is shuffled.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select((F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_find, f"row {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the periodic tails that the contract plants in a tenth of the texts; all others are as they were."""
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    words = F.expr(rf"filter(split({text_col}, '[\\x20\\x09-\\x0D]+'), w -> w != '')")
    t = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.floor(F.col("_h") / 10))
    t = t.withColumn("_a", F.expr("if(_n > 0, _g % _n, null)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    tail = F.expr("transform(sequence(0, _n - 1), i -> get(_w, cast(if(i < _a, i, _a + (i - _a) % _p) as int)))")
    return t.withColumn(text_col, F.when(F.col("_n") > 0, F.array_join(tail, " ")).otherwise(F.col(text_col))).drop("_h", "_w", "_n", "_g", "_a", "_p")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(plant(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    t = out.withColumn("m", longest)
    return t.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.period")).alias("period"),
        F.expr("(1000 * m.length) div (-m.period)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
