"""Brown class n-grams (operator 1).

Words are assigned to classes; a word's probability after another is that of its class after the other's class, times
that of the word within its class, both smoothed.  All words met in training are clustered by exchange.  Those that
are a fixed share of all tokens or more (there can be only MOST_WORDS) go first: in each round half of them move to
the class under which their neighbours on both sides are most probable, with all others in classes of their looks
(digits, marks, last letters).  Then all the others move likewise, in rounds of their own.  A round after which the
training tokens are less likely is taken back.  Classes of looks stay for words that were not met in training: words
met once tell how often such a word follows each class, and how many there may be.

The vocabulary is never in one place.  Texts are encoded once, by batches of bounded text, each with a dictionary of
its own; the dictionaries' words are counted by a shuffle of words, and each batch gets the counts of its own words
back.  In a round of the rarer words each batch sends the classes that it saw beside them to buckets of words, which
add them up and send the chosen classes back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from meridion.session import ScratchTables, materialize, table

HELD_OUT_OF, HELD_OUT = 7, 2
#: Words that are at least one in MOST_WORDS tokens are clustered first, one by one in the driver's table of classes.
MOST_WORDS = 1 << 15
CLASSES = 96
LOOKS = 64
ROUNDS = 8
#: Rounds of all other words.
RARE_ROUNDS = 1
#: Words of batches that one task adds up.
BUCKET_WORDS = 1_000_000
#: Bytes of text that share a dictionary.
BATCH_BYTES = 8 << 20
#: No word holds white space.
END = "\n"
#: Tokens whose neighbours are counted at a time.
_SLAB = 1 << 22


_DIGIT = re.compile(rb"[0-9]")


def _looks(word: bytes) -> int:
    """The class of a word by its looks."""
    letters = word.rstrip(b".,;:!?\"')")
    if not letters.isalpha():  # not ASCII letters alone
        if _DIGIT.search(word):
            return 0
        if not letters.decode(errors="ignore").isalpha():
            return 1
    mark = 0 if len(letters) == len(word) else 1
    tail = letters[-2:]
    return 2 + ((tail[0] * 31 + tail[-1]) % ((LOOKS - 2) // 2)) * 2 + mark


def _planes(a: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, which compress well when most are small."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _encode(id_type: pa.DataType):
    names = ["batch", "ids", "held", "lens", "tokens", "words", "counts", "looks"]
    end = END.encode()

    def emit(batch: int, rows: list[tuple]) -> pa.RecordBatch:
        parts = [t.encode().lower().split() for _, _, t in rows]
        words = [w for p in parts for w in (*p, end)]
        lens = np.array([len(p) + 1 for p in parts], np.int64)
        first = {w: i for i, w in enumerate(dict.fromkeys(words))}
        tokens = np.fromiter(map(first.__getitem__, words), np.int64, len(words))
        own = np.bincount(tokens, minlength=len(first))
        order = np.argsort(-own, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens = place[tokens]
        known = list(first)
        known = [known[i] for i in order]
        trained = np.repeat(~np.array([h for _, h, _ in rows], bool), lens)
        counts = np.bincount(tokens[trained], minlength=len(known))
        values = [
            pa.array([batch], pa.int64()), pa.array([[i for i, _, _ in rows]], pa.list_(id_type)), pa.array([[h for _, h, _ in rows]], pa.list_(pa.bool_())), pa.array([lens.tolist()], pa.list_(pa.int64())),
            pa.array([_planes(tokens)], pa.binary()), pa.array([[w.decode() for w in known]], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([[0 if w == end else _looks(w) for w in known]], pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(values, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "held", "text")), strict=True):
                rows.append(row)
                size += len(row[2]) + 16
                if size >= BATCH_BYTES:
                    yield emit(number, rows)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield emit(number, rows)

    return run


def _number(total: int, types: int, words: int, id_type: pa.DataType):
    """Words as symbols: a frequent word's number, or ``words`` plus the class of looks; sums of counts by document.

    ``keys`` name the other words met in training (zero: none), ``once`` those met once.
    """
    names = ["batch", "ids", "held", "lens", "known", "base", "counted", "tokens", "symbols", "keys", "once"]

    def run(docs: pa.Table, entries: pa.Table) -> pa.Table:
        values = [[] for _ in names]
        if docs.num_rows:
            at = entries.column("at").to_numpy()
            count, symbol = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            count[at], symbol[at] = entries.column("c").to_numpy(), entries.column("number").to_numpy()
            key = np.zeros(len(at), np.int64)
            key[at] = entries.column("key").to_numpy()
            key[(count == 0) | (symbol >= 0)] = 0
            looks = np.array(docs.column("looks")[0].as_py(), np.int64)
            symbol = np.where(symbol < 0, words + looks, symbol).astype("<u2")
            tokens = _from_planes(docs.column("tokens")[0].as_py())
            lens = np.array(docs.column("lens")[0].as_py(), np.int64)
            starts = np.cumsum(lens) - lens
            seen = count[tokens]
            logs = np.log10(seen + 1.0)
            counted = np.add.reduceat(logs, starts)
            base = counted - lens * np.log10(total + 1.0 * (types + 1))
            known = np.add.reduceat((seen > 0).astype(np.int64), starts)
            for v, x in zip(values, (docs.column("batch")[0].as_py(), docs.column("ids")[0].as_py(), docs.column("held")[0].as_py(), lens.tolist(), known.tolist(), base.tolist(), counted.tolist(), docs.column("tokens")[0].as_py(), symbol.tobytes(), key.tobytes(), np.packbits((count == 1) & (key != 0)).tobytes()), strict=True):
                v.append(x)
        longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
        kinds = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), longs, longs, doubles, doubles, *[pa.binary()] * 4]
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    return run


def _documents(b: pa.RecordBatch):
    """Per row: tokens by the batch's words, the token before each (a document's first follows its end), lengths, symbols of the words."""
    for i in range(b.num_rows):
        t = _from_planes(b.column("tokens")[i].as_py()).astype(np.int64)
        lens = np.array(b.column("lens")[i].as_py(), np.int64)
        yield i, t, t[_places_before(lens)], lens, np.frombuffer(b.column("symbols")[i].as_py(), "<u2").astype(np.int64)


def _trained(b: pa.RecordBatch, i: int, lens: np.ndarray) -> np.ndarray:
    return np.repeat(~np.array(b.column("held")[i].as_py(), bool), lens)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array((codes >> 16).astype("i4")), pa.array((codes & 0xFFFF).astype("i4")), pa.array(n.astype("i8"))], ["a", "b", "n"])

    parts, size = [], 0
    for b in batches:
        for i, t, before, lens, symbols in _documents(b):
            parts.append(((symbols[before] << 16) + symbols[t])[_trained(b, i, lens)].astype("u4"))
            size += len(parts[-1])
            if size >= _SLAB:
                yield emit(parts)
                parts, size = [], 0
    if size:
        yield emit(parts)


def _matrix(classes: np.ndarray, n: int):
    """Counts of class pairs: one table of n x n per task, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((n, n), np.int64)
        for b in batches:
            for s, to, count in zip(*(b.column(c).to_pylist() for c in ("symbol", "after", "after_n")), strict=True):
                np.add.at(m[classes[s]], classes[np.array(to or [], np.int64)], np.array(count or [], np.int64))
        i, j = np.nonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype("i4")), pa.array(j.astype("i4")), pa.array(m[i, j])], ["i", "j", "n"])

    return run


def _exchange(classes: np.ndarray, m: np.ndarray, movable: int, turn: int):
    """For the words whose turn it is, the class under which their neighbours are most probable (ties: the first)."""
    n = len(m)
    forward = np.log((m + 0.1) / (m.sum(axis=1, keepdims=True) + 0.1 * n))[:movable]  # class b before j
    backward = np.log((m + 0.1) / (m.sum(axis=1, keepdims=True) + 0.1 * n))[:, :movable]  # i before class b
    share = np.log(m.sum(axis=0)[:movable] + 1.0)

    def counts(ids: list, n_of: list) -> np.ndarray:
        return np.bincount(classes[np.array(ids or [], np.int64)], np.array(n_of or [], np.float64), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, to, to_n, fro, fro_n in zip(*(b.column(c).to_pylist() for c in ("symbol", "after", "after_n", "before", "before_n")), strict=True):
                if (s * 2654435761 >> 7) % 2 == turn % 2:
                    l = counts(fro, fro_n)  # noqa: E741
                    out.append((s, int(np.argmax(forward @ counts(to, to_n) + l @ backward - l.sum() * share))))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.int32())], ["symbol", "class"])

    return run


def _classes(b: pa.RecordBatch, i: int, symbols: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Classes of a batch's words: as assigned in a round of the rarer words, else by their symbols."""
    got = of[symbols]
    if "assigned" in b.schema.names:
        mine = np.frombuffer(b.column("assigned")[i].as_py(), np.uint8)
        got = np.where(mine == _NONE, got, mine)
    return got


#: No class assigned.
_NONE = 255


def _beside(of: np.ndarray, n: int, n_words: int, buckets: int):
    """Per batch and bucket of words: the words' keys and looks, and how often each class was before and after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, before, lens, symbols in _documents(b):
                key = np.frombuffer(b.column("keys")[i].as_py(), "<i8")
                cls = _classes(b, i, symbols, of)
                bucket = key % buckets
                mine = np.lexsort((key, bucket))
                mine = mine[key[mine] != 0]
                rank = np.full(len(key), -1)
                rank[mine] = np.arange(len(mine))
                after = np.empty_like(t)
                after[_places_before(lens)] = t
                r, trained = rank[t], _trained(b, i, lens)
                take = trained & (r >= 0)
                code = np.concatenate([r[take] * (2 * n) + cls[before[take]], r[take] * (2 * n) + n + cls[after[take]]])
                code, count = np.unique(code, return_counts=True)
                sizes = np.bincount(code // (2 * n), minlength=len(mine))
                ends, cuts = np.cumsum(sizes), np.flatnonzero(np.diff(bucket[mine], prepend=-1, append=-1))
                looks = (symbols[mine] - n_words).astype("u1")
                rows = []
                for x, y in zip(cuts, cuts[1:]):
                    lo, hi = ends[x] - sizes[x], ends[y - 1]
                    rows.append((int(bucket[mine[x]]), key[mine[x:y]].tobytes(), looks[x:y].tobytes(), sizes[x:y].astype("<u4").tobytes(), (code[lo:hi] % (2 * n)).astype("<u2").tobytes(), count[lo:hi].astype("<u4").tobytes()))
                name = b.column("batch")[i].as_py()
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["batch", "bucket", "keys", "looks", "sizes", "codes", "counts"])

    return run


def _places_before(lens: np.ndarray) -> np.ndarray:
    """Place of the token before each, in documents laid end to end; a document's first follows its last."""
    ends = np.cumsum(lens)
    at = np.arange(-1, ends[-1] - 1)
    at[ends - lens] = ends - 1
    return at


def _choose(m: np.ndarray, movable: int):
    """Per bucket: each word's class of the highest gain, among the exchanged ones and that of its looks; by batch, in the order it sent.

    The bucket's first row also has the tokens and kinds of words in each class.
    """
    n = len(m)
    p = np.log((m + 0.1) / (m.sum(axis=1, keepdims=True) + 0.1 * n))
    # What a neighbour adds under each class: classes before the word, then classes after it.
    gain = np.concatenate([p - np.log(m.sum(axis=0) + 1.0), p.T]).astype("f4")

    def run(t: pa.Table) -> pa.Table:
        get = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(name)])
        keys, looks, sizes = get("keys", "<i8"), get("looks", "u1").astype(np.int64), get("sizes", "<u4").astype(np.int64)
        codes, counts = get("codes", "<u2").astype(np.int64), get("counts", "<u4")
        words, first, word = np.unique(keys, return_index=True, return_inverse=True)
        entry = np.repeat(word, sizes)
        order = np.argsort(entry, kind="stable")
        entry, codes, counts = entry[order], codes[order], counts[order]
        starts = np.searchsorted(entry, np.arange(len(words) + 1))
        look = looks[first] + movable
        chosen = np.empty(len(words), np.uint8)
        x = 0
        while x < len(words):  # about 65,536 entries at a time
            y = max(x + 1, int(np.searchsorted(starts, starts[x] + 65_536, "right")) - 1)
            part = slice(starts[x], starts[y])
            each = gain[codes[part]] * counts[part, None].astype("f4")
            total = np.add.reduceat(each, starts[x:y] - starts[x])
            own = total[np.arange(y - x), look[x:y]]
            best = total[:, :movable].argmax(axis=1)
            chosen[x:y] = np.where(own >= total[np.arange(y - x), best], look[x:y], best)
            x = y
        before = codes < n
        tokens = np.bincount(chosen[entry[before]], counts[before], n).astype(np.int64)
        kinds = np.bincount(chosen, minlength=n)
        cuts = np.cumsum([0] + [len(k.as_py()) // 8 for k in t.column("keys")])
        back = chosen[word]
        rows = [back[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
        one = lambda a: pa.array([a.tolist()] + [None] * (len(rows) - 1), pa.list_(pa.int64()))
        return pa.table({"batch": t.column("batch"), "bucket": t.column("bucket"), "classes": pa.array(rows, pa.binary()), "tokens": one(tokens), "kinds": one(kinds)})

    return run


def _take_classes(buckets: int, schema: pa.Schema):
    """A batch with the classes that buckets chose for its words."""

    def run(docs: pa.Table, chosen: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        key = np.frombuffer(docs.column("keys")[0].as_py(), "<i8")
        mine = np.lexsort((key, key % buckets))
        mine = mine[key[mine] != 0]
        classes = np.full(len(key), _NONE, np.uint8)
        if len(mine):
            got = sorted(zip(chosen.column("bucket").to_pylist(), chosen.column("classes").to_pylist()))
            classes[mine] = np.frombuffer(b"".join(c for _, c in got), np.uint8)
        docs = docs.drop_columns(["assigned"]) if "assigned" in docs.column_names else docs
        return docs.append_column("assigned", pa.array([classes.tobytes()], pa.binary())).cast(schema)

    return run


def _class_pairs(of: np.ndarray, n: int, n_words: int):
    """Counts of class pairs as rows (i, j, n); j from ``n``: looks of words met once, after each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(n * (n + LOOKS), np.int64)
        for b in batches:
            for i, t, before, lens, symbols in _documents(b):
                cls, trained = _classes(b, i, symbols, of), _trained(b, i, lens)
                t, before = t[trained], before[trained]
                m += np.bincount(cls[before] * (n + LOOKS) + cls[t], minlength=len(m))
                once = np.unpackbits(np.frombuffer(b.column("once")[i].as_py(), np.uint8), count=len(symbols)).astype(bool)[t]
                m += np.bincount(cls[before[once]] * (n + LOOKS) + n + symbols[t[once]] - n_words, minlength=len(m))
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array((at // (n + LOOKS)).astype("i4")), pa.array((at % (n + LOOKS)).astype("i4")), pa.array(m[at])], ["i", "j", "n"])

    return run


def _score(classes: np.ndarray, transition: np.ndarray, within: np.ndarray, total: int, id_type: pa.DataType):
    flat, n = transition.ravel(), len(transition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, before, lens, symbols in _documents(b):
                cls = _classes(b, i, symbols, classes)
                c = cls[t]
                starts = np.cumsum(lens) - lens
                score = np.add.reduceat(flat[cls[before] * n + c] - within[c], starts) + np.array(b.column("counted")[i].as_py())
                get = lambda k: b.column(k)[i].as_py()  # noqa: B023, E731
                values = [pa.array(get("ids"), id_type), pa.array(get("held")), pa.array(lens), pa.array(get("known"), pa.int64()), pa.array(np.full(len(lens), total)), pa.array(get("base"), pa.float64()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(values, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def likelihood(m: np.ndarray) -> float:
    """What the classes add to the log-likelihood of the training tokens, from the counts of class pairs."""
    share = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return share(m) - share(m.sum(axis=1)) - share(m.sum(axis=0))


def smoothed(m: np.ndarray, of: np.ndarray, names: list[tuple], rest: dict[int, tuple[int, int]], classes: int, unknown: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of class after class, log10 of what a class's counts, one more each, are divided by).

    ``m``: counts of class pairs; ``of``: class by symbol; ``names``: (word, number, count) of the frequent words;
    ``rest``: tokens and words of the others by class, numbered from the first class of looks (exchanged ones are below
    zero); ``unknown``: words met once, by class before and looks, if these are not in their class of looks any more.
    A class of looks then has places for as many unknown words, and one.
    """
    n, n_words = len(m), len(names)
    tokens, kinds = np.zeros(n), np.zeros(n)
    np.add.at(tokens, of[:n_words], [c for *_, c in names])
    np.add.at(kinds, of[:n_words], 1)
    for look, (c, v) in rest.items():
        tokens[classes + look] += c
        kinds[classes + look] += v
    unseen = np.concatenate([np.zeros(classes), np.ones(LOOKS)])  # a class of looks has a place for an unknown word
    usual = tokens.copy()
    if unknown is not None:
        m = m.copy()
        m[:, classes:] += unknown
        unseen[classes:] += unknown.sum(axis=0)
        usual[classes:] += unknown.sum(axis=0)
    # Only classes that can hold a word get a share.
    usual = np.where(kinds + unseen > 0, usual + 1.0, 0.0)
    usual /= usual.sum()
    transition = np.log10(np.maximum((m + n * usual) / (m.sum(axis=1, keepdims=True) + n), 1e-300))
    within = np.log10(np.maximum(tokens + kinds + unseen, 1.0))
    return transition, within


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, rounds: int = ROUNDS, most_words: int = MOST_WORDS, rare_rounds: int = RARE_ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, learning from those not ``held_out``.

    A null text counts as empty and is its end alone; rows with a null id are scored like others; repeated rows count,
    and are scored, as often as they occur; with nothing to learn from every token is unknown; an empty table gives an
    empty one; other columns are not looked at.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    ddl, id_type = kind.simpleString(), to_arrow_type(kind)
    tables = ScratchTables(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    encoded = tables.put(rows.mapInArrow(_encode(id_type), f"batch long, ids array<{ddl}>, held array<boolean>, lens array<long>, tokens binary, words array<string>, counts array<long>, looks array<int>"))

    # Words with their counts over all batches: tasks add up their own first, so a common word is one row of each task.
    each = encoded.select("batch", F.posexplode(F.arrays_zip("words", "counts", "looks")).alias("at", "w")).select("batch", "at", "w.words", "w.counts", "w.looks")
    types = tables.put(each.groupBy("words").agg(F.sum("counts").alias("c"), F.max("looks").alias("looks")))
    learned = types.where("c > 0")
    total, n_types = learned.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    often = learned.where(F.col("c") * most_words >= F.lit(total)).select("words", "c")  # most_words at most
    names = [(r.words, n, r.c) for n, r in enumerate(often.orderBy(F.desc("c"), "words").collect())]
    n_words = len(names)
    numbered = F.broadcast(spark.createDataFrame(names, "words string, number int, c long"))
    # Batches get the counts of frequent words without a shuffle, those of the others by one.
    met = each.select("batch", "at", "words")
    rare = met.join(numbered.select("words"), "words", "left_anti").join(types.select("words", "c"), "words")
    met = met.join(numbered, "words").unionByName(rare.withColumn("number", F.lit(-1)))
    met = met.select(F.col("batch").alias("batch"), "at", "c", "number", F.xxhash64("words").alias("key"))
    others = learned.join(numbered.select("words"), "words", "left_anti")
    rest = {r.looks: (r.n, r.v) for r in others.groupBy("looks").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}

    longs = "array<long>"
    symbols = tables.put(
        encoded.select("batch", "ids", "held", "lens", "tokens", "looks").groupBy("batch").cogroup(met.groupBy("batch"))
        .applyInArrow(_number(total, n_types, n_words, id_type), f"batch long, ids array<{ddl}>, held array<boolean>, lens {longs}, known {longs}, base array<double>, counted array<double>, tokens binary, symbols binary, keys binary, once binary")
    )
    entries = encoded.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).head().n
    tables.drop(0)
    tables.drop(1)

    pairs = symbols.select("held", "lens", "tokens", "symbols").mapInArrow(_bigrams, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs)
    # A symbol has no more neighbours than there are symbols.
    after = pairs.groupBy(F.col("a").alias("symbol")).agg(F.collect_list("b").alias("after"), F.collect_list("n").alias("after_n"))
    before = pairs.groupBy(F.col("b").alias("symbol")).agg(F.collect_list("a").alias("before"), F.collect_list("n").alias("before_n"))
    near = materialize(after.join(before, "symbol", "full"))

    n = classes + LOOKS
    of = np.concatenate([np.arange(n_words) % classes, classes + np.arange(LOOKS)]).astype(np.int64)

    def matrix() -> np.ndarray:
        m = np.zeros((n, n))
        for r in near.select("symbol", "after", "after_n").mapInArrow(_matrix(of, n), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # n * n at most
            m[r.i, r.j] = r.n
        return m

    words = near.where(F.col("symbol") < n_words)
    best, failed = None, 0
    for turn in range((rounds if n_words > 1 else 0) + 1):
        m = matrix()
        found = likelihood(m)
        if best is None or found >= best[0]:
            best, failed = (found, of.copy(), m), 0
        else:  # words that move together can spoil each other's gain: back, and on with the other half
            failed += 1
            of, m = best[1].copy(), best[2]
        if turn == rounds or failed == 2 or n_words < 2:
            break
        for r in words.mapInArrow(_exchange(of, m, classes, turn), "symbol int, class int").collect():  # most_words at most
            of[r.symbol] = r["class"]

    found, of, m = best
    unknown, buckets = None, entries // BUCKET_WORDS + 1
    for _ in range(rare_rounds if n_types > n_words else 0):
        sent = symbols.drop("ids", "known", "base", "counted").mapInArrow(_beside(of, n, n_words, buckets), "batch long, bucket long, keys binary, looks binary, sizes binary, codes binary, counts binary")
        chosen = tables.put(sent.groupBy("bucket").applyInArrow(_choose(m, classes), "batch long, bucket long, classes binary, tokens array<long>, kinds array<long>"))
        target = symbols.drop("assigned").withColumn("assigned", F.lit(None).cast("binary")).schema
        moved = tables.put(symbols.groupBy("batch").cogroup(chosen.select("batch", "bucket", "classes").groupBy("batch")).applyInArrow(_take_classes(buckets, to_arrow_schema(target)), target))
        both = np.zeros((n, n + LOOKS))
        for r in moved.drop("ids", "known", "base", "counted").mapInArrow(_class_pairs(of, n, n_words), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # n * (n + LOOKS) at most
            both[r.i, r.j] = r.n
        if likelihood(both[:, :n]) < found:
            break
        found, m, unknown, symbols = likelihood(both[:, :n]), both[:, :n], both[:, n:], moved
        sums = chosen.where("tokens is not null").select(F.posexplode(F.arrays_zip("tokens", "kinds")).alias("class", "s")).groupBy("class").agg(F.sum("s.tokens").alias("n"), F.sum("s.kinds").alias("v"))
        rest = {r["class"] - classes: (r.n, r.v) for r in sums.collect()}  # a row for each class
    transition, within = smoothed(m, of, names, rest, classes, unknown)
    out = symbols.mapInArrow(_score(of, transition, within, total, id_type), f"id {ddl}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op1_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(text_id) % HELD_OUT_OF == HELD_OUT)
