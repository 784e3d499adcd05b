"""Lexical retrieval packing of token windows (operator 9).

Terms are token ids; their weights are those of the whole corpus, counted once.  Documents are dealt to shards by
retrieval over the whole corpus: a sample of its documents (pivots) is an index, each document goes to the pivot with
the best BM25 score for it, and what is too large for one task is divided again by pivots of its own.  So copies and
documents on one subject meet in one shard wherever they were stored.  A shard is divided the same way into indexes of
bounded size, with postings as arrays.  A window starts with a seed (what is left of the last cut document, else the
longest unused one); the index returns its unused neighbours by BM25 score, and they fill the window greedily: those
that fit whole in the order of their scores, then the best of the others is cut at the window's end and its rest
becomes the next seed.  Only the last sequence of an index can be short.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridion.session import ScratchTables, table

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
#: Bytes of text in a shard, about; a shard is what one task holds.
SHARD_BYTES = 4 << 20
#: A part of so many times that size, at most, is a shard as it is.
MOST = 4
#: Ids in one index, at most (but for a larger document).
INDEX_IDS = 400_000
K1, B = 1.2, 0.75
#: One row in SAMPLE, but SAMPLE_SHARDS shards of text at least, is looked at to choose pivots and to foresee the
#: sizes of parts; all rows are dealt.
SAMPLE, SAMPLE_SHARDS = 8, 16
#: Pivots that divide the corpus or one part of it: so many at most, and so many for each shard that it fills.
PIVOTS = 256
PIVOTS_A_SHARD = 4
#: Pivots that are sent to every task, at most.
SENT_PIVOTS = 4096
#: A part that keeps more than this share of what was divided is not divided by retrieval again: its documents are so
#: much alike that any of them are neighbours, and they are dealt evenly.
NO_PROGRESS = 0.9
#: Words whose ids a worker remembers; the memory that a worker needs is bounded by it.
REMEMBERED = 500_000
#: Texts that are encoded at a time, at most, and their bytes (one text can have more).
_BATCH_ROWS, _BATCH_BYTES = 4096, 16 << 20

#: A run of these marks behind an ASCII or Latin-1 letter or a digit, at the end of a word, is a piece of its own under
#: the vocabulary's rules: those characters stay letters or digits when they are normalised, and none ends in a mark.
_MARKS = bytes(b in b".,!?;:*$&%#|" for b in range(256))
_ASCII_LETTERS = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: The byte that leads Latin-1 letters in UTF-8, the bytes behind it that are no letters, words of letters alone.
_LATIN, _NO_LETTERS = 0xC3, [0x97, 0xB7]
_LETTERS = re.compile(rb"(?:[a-z]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _spelling() -> dict[int, int]:
    """The characters that spell the bytes behind ``_LATIN`` to the merges, of lower-case letters.

    The byte-level rule keeps bytes that are visible as Latin-1 and numbers the others from 256.
    """
    hidden = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173)]
    lower = {b: b + 32 if b < 0x9F else b for b in range(0x80, 0xC0)}
    return {b: 256 + hidden.index(c) if c in hidden else c for b, c in lower.items()}


_SPELLING = _spelling()
_loaded: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of whole texts by the vocabulary file of a worker.

    If the vocabulary's own rules are seen to cut every text at white space, a batch of texts is cut into words, each
    different word is encoded by the library once and remembered, and the texts are put together from their words;
    otherwise the library encodes whole texts.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_word = _cuts_at_space(rules)
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = end_id
        self._forget()

    def _forget(self) -> None:
        """Word by place; of each place the end of its ids in ``ids``."""
        self.known: dict[bytes, int] = {}
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, self.dtype)

    def _learn(self, words: list[bytes]) -> None:
        """A word of ASCII and Latin-1 letters is one word to the merges, so the cutting rules need not look at it."""
        merges, plain, odd, found = self.model.model.tokenize, [], [], []
        for w in words:
            (plain if w.isalpha() and w.islower() or _LETTERS.fullmatch(w) else odd).append(w)
        for w in plain:
            found.append([t.id for t in merges(w.decode() if w.isascii() else w.decode("latin-1").translate(_SPELLING))])
        found += [e.ids for e in self.model.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)]
        n = len(self.known)
        self.known.update(zip(plain + odd, range(n, n + len(words)), strict=True))
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lens)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), self.dtype, int(lens.sum()))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the end of each text in them); each text's last id is the end's."""
        if not self.by_word:
            found = [[*e.ids, self.end] for e in self.model.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for f in found for i in f], self.dtype), np.cumsum([len(f) for f in found])
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special strings are met in lower case only
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(_marks_apart(texts))
        last = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBERED:
            self._forget()
        place = list(map(self.known.get, different))
        if new := [w for w, k in zip(different, place, strict=True) if k is None]:
            self._learn(new)
            place = list(map(self.known.get, different))
        met = self._blobs(np.array(place, np.int64)).take(coded.indices)
        after = np.frombuffer(met.buffers()[1], "i4")[: len(met) + 1] // self.dtype.itemsize
        ids = np.frombuffer(met.buffers()[2], self.dtype)[: after[-1]] if len(met) else self.ids[:0]
        ends = after[last - last[0]][1:] + np.arange(1, len(texts) + 1)
        out, inside = np.full(len(ids) + len(texts), self.end, self.dtype), np.ones(len(ids) + len(texts), bool)
        inside[ends - 1] = False
        out[inside] = ids
        return out, ends

    def _blobs(self, place: np.ndarray) -> pa.Array:
        """The ids of some words, as binary values."""
        starts, lens = self.ends[place], self.ends[place + 1] - self.ends[place]
        after = np.cumsum(lens)
        at = np.repeat(starts - (after - lens), lens) + np.arange(after[-1] if len(after) else 0)
        offsets = np.concatenate([[0], after]) * self.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets.astype("i4")), pa.py_buffer(self.ids[at])])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _marks_apart(texts: pa.Array) -> pa.Array:
    """The texts with a space before each run of marks that ends a word behind a letter or digit."""
    texts = texts.cast(pa.string())
    data = texts.buffers()[2] if len(texts) else None
    if not data:
        return texts
    ends = np.frombuffer(texts.buffers()[1], "i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw, ends = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    at = np.flatnonzero(np.frombuffer(raw.tobytes().translate(_MARKS), bool))
    text = np.searchsorted(ends, at, side="right") - 1
    apart = (np.diff(at) > 1) | (np.diff(text) > 0)
    first, last = np.append(True, apart)[: len(at)], np.append(apart, True)[: len(at)]
    start, end, text = at[first], at[last] + 1, text[first]
    before, second = raw[start - 1], raw[np.maximum(start - 2, 0)]
    letter = _ASCII_LETTERS[before] | ((second == _LATIN) & (before >= 0x80) & (before < 0xC0) & ~np.isin(before, _NO_LETTERS))
    behind = raw[np.minimum(end, len(raw) - 1)]
    closed = (end == ends[text + 1]) | (behind == ord(" ")) | (behind == ord("\n"))
    start = start[letter & closed & (start > ends[text])]
    ends = ends + np.searchsorted(start, ends)
    if ends[-1] >= 1 << 31:
        raise ValueError("one text does not fit a string value of Arrow")
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends.astype("i4")), pa.py_buffer(np.insert(raw, start, ord(" ")))])


def _cuts_at_space(rules: dict) -> bool:
    steps = [s["type"] for s in (rules.get("normalizer") or {}).get("normalizers", [])]
    cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    removed = bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and r"[^\s\p{L}\p{N}]+" in cuts[0]["pattern"].get("Regex", "")
    plain = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in rules.get("added_tokens", []))
    by_bytes = len(cuts) == 2 and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    return steps == ["NFC", "Replace", "Lowercase"] and removed and by_bytes and plain and not rules.get("post_processor")


def _encoder(path: str, end_id: int) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path, end_id)
    return _loaded[path]


def _bounded(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded text."""
    size = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + _BATCH_BYTES, side="right"))
        end = min(max(end, at + 1), at + _BATCH_ROWS)
        yield b.slice(at, end - at)
        at = end


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end_id)
        for b in batches:
            for some in _bounded(b, "text"):
                ids, ends = encoder.encode(some.column("text"))
                offsets = np.concatenate([[0], ends]) * encoder.dtype.itemsize
                if offsets[-1] >= 1 << 31:
                    raise ValueError("the ids of one text do not fit a binary value of Spark")
                blobs = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype("i4")), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("size"), blobs], ["id", "size", "ids"])

    return run


#: Numbers that the statistics keep beside the terms: documents and their ids.
_DOCUMENTS, _IDS = -1, -2


def _terms(doc: np.ndarray) -> np.ndarray:
    """The different terms of a document in their order."""
    doc = np.sort(doc, kind="stable")  # a radix sort for 16 bits
    keep = np.ones(len(doc), bool)
    keep[1:] = doc[1:] != doc[:-1]
    return doc[keep]


def _counted(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different terms of a document in their order, and how often each occurs."""
    doc = np.sort(doc, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc[at], np.diff(at, append=len(doc))


def _frequencies(dtype: np.dtype, terms: int):
    """Documents that hold each term, and the totals: one row per term and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            docs += b.num_rows
            for ids in b.column("ids"):
                doc = np.frombuffer(ids.as_buffer(), dtype)
                length += len(doc)
                df[_terms(doc)] += 1
        found = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array([*found.tolist(), _DOCUMENTS, _IDS]), pa.array([*df[found].tolist(), docs, length])], ["term", "df"])

    return run


class CorpusStatistics:
    """Weights of terms and the mean length, over all documents; as large as the vocabulary."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.mean = max(1.0, mean)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def weights(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A document's terms and what each adds to its score for a seed that holds the term."""
        t, c = _counted(doc)
        return t, self.idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(doc) / self.mean))


def corpus_statistics(tokens: DataFrame, dtype: np.dtype, terms: int) -> CorpusStatistics:
    df, totals = np.zeros(terms, np.int64), {}
    for r in tokens.select("ids").mapInArrow(_frequencies(dtype, terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the vocabulary at most
        if r.term >= 0:
            df[r.term] = r.df
        else:
            totals[r.term] = r.df
    n = totals.get(_DOCUMENTS, 0)
    return CorpusStatistics(n, totals.get(_IDS, 0) / max(1, n), df)


class PivotIndex:
    """BM25 over a few documents: which of them a document retrieves first."""

    def __init__(self, pivots: list[np.ndarray], statistics: CorpusStatistics):
        found = [statistics.weights(p) for p in pivots]
        terms, row = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
        #: Row of each term in the weights; the last row is for terms that no pivot has.
        self.row = np.full(len(statistics.idf), len(terms), np.int32)
        self.row[terms] = np.arange(len(terms))
        self.weights = np.zeros((len(terms) + 1, len(pivots)), np.float32)
        self.weights[row, np.repeat(np.arange(len(pivots)), [len(t) for t, _ in found])] = np.concatenate([w for _, w in found])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Of each pivot, for a document with these terms."""
        at = self.row[terms]
        return self.weights[at[at < len(self.weights) - 1]].sum(axis=0)

    def best(self, terms: np.ndarray) -> int:
        """Ties go to the first pivot."""
        return int(np.argmax(self.scores(terms)))


def _place(tree: dict[int, tuple[int, list[bytes]]], statistics: CorpusStatistics, dtype: np.dtype, columns: list[str]):
    """The part of each row: from the root down, always to the first child plus the number of the best pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = {p: (first, PivotIndex([np.frombuffer(x, dtype) for x in pivots], statistics)) for p, (first, pivots) in tree.items()}
        for b in batches:
            parts = []
            for x in b.column("ids"):
                terms, part = _terms(np.frombuffer(x.as_buffer(), dtype)), 0
                while (down := indexes.get(part)) is not None:
                    part = down[0] + down[1].best(terms)
                parts.append(part)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(parts, pa.int64())], [*columns, "part"])

    return run


def _chain(statistics: CorpusStatistics, dtype: np.dtype):
    """Pivots of one part, numbered anew so that each is followed by the one that it retrieves first of those left."""

    def run(pivots: pa.Table) -> pa.Table:
        pivots = pivots.sort_by("number")
        docs = [np.frombuffer(p, dtype) for p in pivots.column("ids").to_pylist()]
        index = PivotIndex(docs, statistics)
        order, left = [0], np.ones(len(docs), bool)
        left[0] = False
        while left.any():
            order.append(int(np.argmax(np.where(left, index.scores(_terms(docs[order[-1]])), -1.0))))
            left[order[-1]] = False
        return pa.table([pivots.column("part"), pivots.column("number"), pivots.column("ids").take(pa.array(order))], names=["part", "number", "ids"])

    return run


def _divide_part(statistics: CorpusStatistics, dtype: np.dtype, id_type: pa.DataType):
    """Rows of one part by its own pivots."""
    schema = pa.schema([("id", id_type), ("rid", pa.int64()), ("size", pa.int64()), ("h", pa.int64()), ("ids", pa.binary()), ("part", pa.int64())])

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        pivots = pivots.sort_by("number")
        index = PivotIndex([np.frombuffer(p, dtype) for p in pivots.column("ids").to_pylist()], statistics)
        number = pivots.column("number").to_pylist()
        part = [number[index.best(_terms(np.frombuffer(x, dtype)))] for x in rows.column("ids").to_pylist()]
        return pa.table([*(rows.column(c) for c in _TOKENS), pa.array(part, pa.int64())], schema=schema)

    return run


_TOKENS = ["id", "rid", "size", "h", "ids"]


class ShardIndex:
    """BM25 over documents of one shard, by the corpus's statistics; a used document is no longer returned.

    Postings of rare terms are lists; those of terms that more than one in _DENSE documents have are rows with a
    weight for each document, so that together they are no larger than _DENSE times the lists.
    """

    _DENSE = 12

    def __init__(self, docs: list[np.ndarray], statistics: CorpusStatistics | None = None):
        n = len(docs)
        found = [_counted(d) for d in docs]
        self.lengths = np.array([len(d) for d in docs], np.float64)
        terms = np.concatenate([t for t, _ in found]).astype(np.int64)
        counts = np.concatenate([c for _, c in found]).astype(np.float64)
        doc = np.repeat(np.arange(n), [len(t) for t, _ in found])
        order = np.argsort(terms, kind="stable")
        self.terms, starts = np.unique(terms[order], return_index=True)
        df = np.diff(np.append(starts, len(terms)))
        idf = np.log1p((n - df + 0.5) / (df + 0.5)) if statistics is None else statistics.idf[self.terms]
        norm = K1 * (1 - B + B * self.lengths / (max(1.0, self.lengths.mean()) if statistics is None else statistics.mean))
        tf, doc = counts[order], doc[order]
        weights = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[doc])
        often = df * self._DENSE > n
        #: Place of each term among the rows, or else among the lists.
        self.often, self.place = often, np.where(often, np.cumsum(often), np.cumsum(~often)) - 1
        dense = np.repeat(often, df)
        self.rows = np.zeros((int(often.sum()), n))
        self.rows[np.repeat(self.place, df)[dense], doc[dense]] = weights[dense]
        self.docs, self.weights = doc[~dense], weights[~dense]
        self.starts = np.concatenate([[0], np.cumsum(df[~often])])
        self.of_doc = [np.searchsorted(self.terms, t) for t, _ in found]
        self.unused = np.ones(n, bool)

    def ranked(self, seed: int) -> np.ndarray:
        """All unused documents that share a term with the seed: best score first, ties by place in the shard."""
        k = self.of_doc[seed]
        often = self.often[k]
        k, scores = self.place[k], self.rows[self.place[k[often]]].sum(axis=0)
        k = k[~often]
        counts = self.starts[k + 1] - self.starts[k]
        at = np.repeat(self.starts[k] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        scores = scores + np.bincount(self.docs[at], self.weights[at], len(self.unused))
        scores[~self.unused] = 0
        best = np.nonzero(scores)[0]
        return best[np.argsort(-scores[best], kind="stable")]

    def neighbours(self, seed: int, most: int) -> list[int]:
        """The first of ``ranked``."""
        return self.ranked(seed)[:most].tolist()


def pack_shard(docs: list[np.ndarray], window: int, statistics: CorpusStatistics | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces as (document, start, length, sequence, offset) of documents given longest first."""
    index = ShardIndex(docs, statistics)
    pieces, sequence, following = [], 0, 0
    seed, start = None, 0
    while True:
        if seed is None:
            while following < len(docs) and not index.unused[following]:
                following += 1
            if following == len(docs):
                return pieces
            seed, start = following, 0
            index.unused[seed] = False
        left = len(docs[seed]) - start
        while left >= window:
            pieces.append((seed, start, window, sequence, 0))
            start, left, sequence = start + window, left - window, sequence + 1
        if not left:
            seed = None
            continue
        pieces.append((seed, start, left, sequence, 0))
        used = left
        cut = None
        ranked = near = index.ranked(seed)
        sizes = index.lengths[near]
        while used < window and len(near):
            fits = sizes <= window - used
            near, sizes = near[fits], sizes[fits]
            # As many as fit one after the other; the first that does not is passed over in the next turn.
            n = int(np.searchsorted(np.cumsum(sizes), window - used, side="right"))
            for other, length in zip(near[:n].tolist(), sizes[:n].astype(int).tolist(), strict=True):
                index.unused[other] = False
                pieces.append((other, 0, length, sequence, used))
                used += length
            near, sizes = near[n:], sizes[n:]
        left_out = ranked[index.unused[ranked]]  # none of them fitted when it was its turn
        if len(left_out):
            cut = int(left_out[0])
        seed, start = None, 0
        while used < window:
            if cut is None:
                while following < len(docs) and not index.unused[following]:
                    following += 1
                if following == len(docs):
                    break
                cut = following
            index.unused[cut] = False
            n = min(len(docs[cut]), window - used)
            pieces.append((cut, 0, n, sequence, used))
            used += n
            if n < len(docs[cut]):
                seed, start = cut, n
            cut = None
        sequence += 1


def divide(docs: list[np.ndarray], statistics: CorpusStatistics, most_ids: int) -> list[list[int]]:
    """Places of ``docs`` by indexes of at most ``most_ids`` ids (a larger document has one of its own).

    Documents go to the pivot that they retrieve first, again and again; neighbouring small parts are put together,
    and what retrieval does not divide is cut evenly.
    """
    lens = np.array([len(d) for d in docs], np.int64)
    terms, out = [_terms(d) for d in docs], []

    def held(some: np.ndarray) -> list[np.ndarray]:
        """Runs of at most ``most_ids`` each."""
        runs, full = [[]], 0
        for k in some.tolist():
            if runs[-1] and full + lens[k] > most_ids:
                runs, full = [*runs, []], 0
            runs[-1].append(k)
            full += int(lens[k])
        return [np.array(r) for r in runs]

    todo = [np.arange(len(docs))]
    while todo:
        some = todo.pop()
        size = int(lens[some].sum())
        if size <= most_ids or len(some) == 1:
            out.append(some)
            continue
        wanted = min(len(some), PIVOTS, PIVOTS_A_SHARD * -(-size // most_ids))
        pivots = {docs[some[k * len(some) // wanted]].tobytes(): docs[some[k * len(some) // wanted]] for k in range(wanted)}
        index = PivotIndex(list(pivots.values()), statistics)
        best = np.array([index.best(terms[k]) for k in some.tolist()])
        some = some[np.argsort(best, kind="stable")]
        best = np.sort(best)
        small = []
        for part in np.split(some, np.nonzero(np.diff(best))[0] + 1):
            n = int(lens[part].sum())
            if n > NO_PROGRESS * size:
                out += held(part)
            elif n > most_ids:
                todo.append(part)
            else:
                small.append(part)
        if small:
            out += held(np.concatenate(small))
    return [x.tolist() for x in out if len(x)]


def _pack(window: int, dtype: np.dtype, id_type: pa.DataType, statistics: CorpusStatistics, index_ids: int):
    schema = pa.schema([("id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(shard: pa.Table) -> pa.Table:
        keys, blobs = shard.column("id").to_pylist(), shard.column("ids").to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (-len(blobs[i]), keys[i] is not None, 0 if keys[i] is None else keys[i], blobs[i]))
        docs = [np.frombuffer(blobs[i], dtype) for i in order]
        number, rows = shard.column("shard")[0].as_py() << 32, []
        for some in divide(docs, statistics, index_ids):
            some.sort()  # longest first
            found = pack_shard([docs[k] for k in some], window, statistics)
            rows += [(some[d], s, n, number + q, o) for d, s, n, q, o in found]
            number += 1 + max(q for *_, q, _ in found)
        wide = [docs[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in rows]
        return pa.table(
            [
                pa.array([keys[order[d]] for d, *_ in rows], id_type),
                pa.array([s for _, s, *_ in rows], pa.int64()),
                pa.array([n for _, _, n, *_ in rows], pa.int64()),
                pa.array(wide, pa.binary()),
                pa.array([len(docs[d]) for d, *_ in rows], pa.int64()),
                pa.array([q for *_, q, _ in rows], pa.int64()),
                pa.array([o for *_, o in rows], pa.int64()),
            ],
            schema=schema,
        )

    return run


def _pivots(light: DataFrame, tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """(part, number, ids): of each part in ``wanted`` (part, most, first) at most ``most`` documents of different ids."""
    kinds = light.join(F.broadcast(wanted), "part").groupBy("part", "h", "most", "first").agg(F.min("rid").alias("rid"), F.min("size").alias("size"))
    # Some more than wanted by the hash's size alone, so that no window holds a whole part.
    found = kinds.groupBy("part").agg(F.count("*").alias("kinds"), F.percentile_approx("size", 0.5).alias("usual"))
    drawn = kinds.join(F.broadcast(found), "part").where(F.pmod(F.xxhash64("h"), F.lit(1 << 31)) * F.col("kinds") <= F.lit(8 << 31) * F.col("most"))
    # A long pivot shares terms with every document, so those of the part's usual size are taken.
    at = F.row_number().over(Window.partitionBy("part").orderBy(F.abs(F.col("size") - F.col("usual")), F.xxhash64("h"), "h"))
    drawn = drawn.withColumn("at", at).where("at <= most").select("part", "rid", (F.col("first") + F.col("at") - 1).alias("number"))
    return tokens.select("rid", "ids").join(F.broadcast(drawn), "rid").select("part", "number", "ids")


def deal(tokens: DataFrame, tables: ScratchTables, statistics: CorpusStatistics, dtype: np.dtype, shard_bytes: int, total: int, most_sent: int = SENT_PIVOTS) -> DataFrame:
    """(id, ids, shard) of each row of ``tokens``: shards of neighbours.

    A part of more than ``MOST * shard_bytes`` is divided; smaller ones are shards, and those that come from one part
    are put together up to ``shard_bytes``.  Rows without anything to tell them apart are dealt evenly, by their
    numbers.  As long as all pivots are ``most_sent`` at most, they are chosen in a sample of the rows and sent to all
    rows, which stay where they are; below that, whole parts are shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = tokens.sparkSession, tokens.schema["id"].dataType
    if total <= shard_bytes:
        return tokens.select("id", "ids", F.lit(0).cast("long").alias("shard"))
    ddl = f"id {kind.simpleString()}, rid long, size long, h long, ids binary, part long"
    tree, sizes, following, first_shard = {}, {0: total}, 1, 0
    share = min(1.0, max(1 / SAMPLE, SAMPLE_SHARDS * shard_bytes / total))
    sample = tables.put(tokens.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 31)) < int(share * (1 << 31))))
    light = rows = sample.withColumn("part", F.lit(0).cast("long"))
    shards, settled, sent = [], [], True

    def numbered(rows: DataFrame) -> DataFrame:
        numbers = spark.createDataFrame(shards, "part long, shard long, n long")
        return rows.join(F.broadcast(numbers), "part").select("id", "ids", (F.col("shard") + F.pmod(F.xxhash64("rid"), F.col("n"))).alias("shard"))

    while sizes:
        wanted, parent = [], {}
        for p in sorted(sizes):
            salts = math.ceil(sizes[p] / shard_bytes)
            most = min(PIVOTS, PIVOTS_A_SHARD * salts)
            wanted.append((p, most, following, salts))
            parent |= dict.fromkeys(range(following, following + most), p)
            following += most
        known = spark.createDataFrame(wanted, "part long, most int, first long, salts long")
        pivots = _pivots(light, rows, known.select("part", "most", "first")).groupBy("part").applyInArrow(_chain(statistics, dtype), "part long, number long, ids binary")
        if sent and following <= max(most_sent, PIVOTS):
            first = {p: f for p, _, f, _ in wanted}
            for r in pivots.orderBy("number").collect():
                tree.setdefault(r.part, (first[r.part], []))[1].append(bytes(r.ids))
            for p, _, _, n in wanted:
                if p not in tree:  # too few rows to have one in the sample
                    shards.append((p, first_shard, n))
                    first_shard += n
            light = tables.put(sample.mapInArrow(_place(tree, statistics, dtype, ["rid", "size", "h"]), "rid long, size long, h long, part long"))
        else:
            if sent:  # the parts that are settled so far are taken from here, the others go on
                sent, rows = False, tokens.mapInArrow(_place(tree, statistics, dtype, _TOKENS), ddl)
                settled += [numbered(rows)] if shards else []
                shards = []
            # A part of any size is spread over tasks of one shard's bytes each; its pivots go to each of them.
            salts = F.broadcast(known.select("part", "salts"))
            salted = rows.join(salts, "part").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts"))).select(*_TOKENS, "part", "salt")
            copies = pivots.join(salts, "part").select("part", "number", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
            light = rows = tables.put(salted.groupBy("part", "salt").cogroup(copies.groupBy("part", "salt")).applyInArrow(_divide_part(statistics, dtype, to_arrow_type(kind)), ddl))
        part_bytes = F.sum("size") / (share if sent else 1.0)
        children = {r.part: r.size for r in light.groupBy("part").agg(part_bytes.alias("size")).collect()}  # a few for each shard
        again, held = {}, {}
        for p, of in parent.items():
            size = children.get(p, 0.0)
            if size > MOST * shard_bytes and size <= NO_PROGRESS * sizes[of]:
                again[p] = size
            elif size > MOST * shard_bytes:
                n = math.ceil(size / shard_bytes)
                shards.append((p, first_shard, n))
                first_shard += n
            else:
                shard, full = held.get(of, (None, 0))
                if shard is None or full + size > shard_bytes:
                    shard, full, first_shard = first_shard, 0, first_shard + 1
                held[of] = shard, full + size
                shards.append((p, shard, 1))
        sizes = again
        if not sent and shards:
            settled.append(numbered(rows))
            shards = []
    if sent:
        settled.append(numbered(tokens.mapInArrow(_place(tree, statistics, dtype, _TOKENS), ddl)))
    return functools.reduce(DataFrame.unionAll, settled)


def pack(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, index_ids: int = INDEX_IDS, most_sent: int = SENT_PIVOTS) -> DataFrame:
    """One row per piece: id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset.

    Every id of every row of ``docs`` lies in exactly one piece.  A null text counts as empty and packs as its end
    id alone; rows with a null id are packed under that null; repeated rows are packed as often as they occur; an
    empty table gives an empty one; other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from tokenizers import Tokenizer

    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), (F.octet_length(text).cast("long") + 64).alias("size"))
    ddl, terms = kind.simpleString(), Tokenizer.from_file(vocabulary_path).get_vocab_size()
    dtype = np.dtype("<u2" if terms <= 1 << 16 else "<u4")
    terms = max(terms, end_id + 1)
    tables = ScratchTables(spark)
    encoded = rows.mapInArrow(_tokenise(vocabulary_path, end_id), f"id {ddl}, size long, ids binary")
    tokens = tables.put(encoded.select("id", F.monotonically_increasing_id().alias("rid"), "size", F.xxhash64("ids").alias("h"), "ids"))
    total = tokens.agg(F.sum("size")).head()[0] or 0
    statistics = corpus_statistics(tokens, dtype, terms)
    dealt = deal(tokens, tables, statistics, dtype, shard_bytes, total, most_sent)
    packed = dealt.groupBy("shard").applyInArrow(
        _pack(window, dtype, to_arrow_type(kind), statistics, index_ids), f"id {ddl}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return packed.withColumnRenamed("id", id_col)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))
