"""An encoder learned from the corpus: words that stand in like contexts get like vectors.

Words are counted with the words up to `reach` places after them in the same sentence. The positive pointwise mutual
information of the pairs is a sparse symmetric matrix; randomised subspace iteration finds its leading eigenvectors. Words go by
numbers, the places of their hashes in order; no two words of the corpus share a hash. Counts are added up in the tasks before they are
shuffled, once, and lie in blocks of rows against blocks of columns. A step reads them and the blocks of vectors as written: a task keeps the rows of
a block and goes through all blocks of vectors. Hashes, frequencies and sums of the vocabulary, three numbers a word, come to the driver and go to the tasks, as do
inner products of the block's columns, a matrix of DIMS + SPARE, which give what makes the columns orthonormal. Every word starts
with signs hashed from itself, so results don't depend on partitions beyond rounding.

A text's vector is the mean of its words' vectors, each weighted by how rare the word is, at unit length. Two texts without a
shared word are near if their words keep like company.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences
from .lineage import cut, stored

#: Dimensions kept, further ones that are iterated with them, and steps.
DIMS, SPARE, STEPS = 64, 16, 6
#: Places that a word's company reaches; texts that a word must be in; weight of a word of share p: RARE / (RARE + p).
REACH, LEAST, RARE = 4, 5, 1e-3
#: Words of a block of vectors, words of the texts that a task holds, and rows that it goes through at once.
CHUNK, GROUP, AT_ONCE = 1 << 14, 1 << 20, 1 << 12
#: Pairs that a task holds before it passes on their counts, and passed-on counts that it adds up at once, about.
PAIRS, COUNTS = 1 << 22, 1 << 23


@dataclass
class Codes:
    """Numbers of the vocabulary's words. told: (hashes in order, weights)."""

    seed: int
    size: int
    told: Broadcast

    def hashed(self, words: Column) -> Column:
        return F.transform(words, lambda w: F.xxhash64(w, F.lit(self.seed)))


def _numbers(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """-1 for words that aren't known."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


@dataclass
class Contexts:
    """words(word, weight, v): one row for each word of the vocabulary. The blocks (c, block) hold the same by numbers, `width` numbers a block."""

    words: DataFrame
    values: list[float]
    codes: Codes | None = None
    blocks: DataFrame | None = None
    width: int = 1

    def vectors(self, texts: DataFrame, key: str = "id", text: str = "s") -> DataFrame:
        """(key, v) of texts(key, text), unit vectors; texts without a known word have none. Keys tell the texts apart."""
        kind = texts.schema[key].dataType.simpleString()
        return self.made(texts, lambda keys, v: pa.table([keys, _lists(v)], [key, "v"]), f"`{key}` {kind}, v array<double>", key, text)

    def made(self, texts: DataFrame, finish: Callable[[pa.Array, np.ndarray], pa.Table], schema: str, key: str = "id", text: str = "s") -> DataFrame:
        """finish(keys, vectors) of the texts that have vectors, where these are made: a task keeps a block of texts, as numbers, and goes through the blocks of words."""
        spark, kind = texts.sparkSession, texts.schema[key].dataType.simpleString()
        if self.blocks is None:
            return spark.createDataFrame([], schema)
        told, most, width, dims = self.codes.told, GROUP, self.width, len(self.values)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, words, held, k = [], [], 0, 0
            row = lambda: pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([k], pa.int32()), pa.array([_sealed([pa.concat_arrays(keys), pa.concat_arrays(words)], ["key", "ws"])], pa.binary())], ["at", "k", "block"])
            for batch in batches:
                size = pc.list_value_length(batch.column(1)).to_numpy()
                number = _numbers(batch.column(1).flatten().to_numpy(), told.value[0])
                owner = np.repeat(np.arange(len(size)), size)[number >= 0]
                ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(size)))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(number[number >= 0].astype(np.int32)))
                # a text counts as eight words at least: what is added up is held for each
                cost = np.cumsum(np.maximum(np.diff(ends), 8))
                f = 0
                while f < len(size):
                    before = cost[f - 1] if f else 0
                    to = max(int(np.searchsorted(cost, before + most - held, "right")), f + (not held))
                    if to > f:
                        keys.append(batch.column(0).slice(f, to - f))
                        words.append(lists.slice(f, to - f))
                        held += int(cost[to - 1] - before)
                    if to < len(size):
                        yield row()
                        keys, words, held, k = [], [], 0, k + 1
                    f = to
            if keys:
                yield row()

        groups = cut(texts.select(F.col(key).alias("key"), self.codes.hashed(words_of(F.col(text))).alias("ws")).mapInArrow(gather, "at int, k int, block binary"))
        counts = dict(groups.groupBy("at").count().collect())
        if not counts:
            return spark.createDataFrame([], schema)
        first = np.cumsum([0, *[counts.get(k, 0) for k in range(max(counts) + 1)]]).tolist()
        place = F.array(*map(F.lit, first[:-1]))[F.col("at")] + F.col("k")
        x = groups.select(place.cast("int").alias("__r"), F.col("block").alias("__x")).repartitionById(first[-1], F.col("__r"))
        y = self.blocks.select(F.col("c").alias("__c"), F.col("block").alias("__y")).coalesce(1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, chunk, keys, sums = None, None, None, None
            for batch in batches:
                for r, c, x, y in zip(batch["__r"], batch["__c"], batch["__x"], batch["__y"]):
                    if r.as_py() != at:
                        if at is not None:
                            yield from _finished(keys, sums, finish)
                        at, table = r.as_py(), _opened(x)
                        keys, ws = table["key"].combine_chunks(), table["ws"].combine_chunks()
                        row, number = np.repeat(np.arange(len(ws)), pc.list_value_length(ws).to_numpy()), ws.flatten().to_numpy()
                        order = np.argsort(number // width, kind="stable")
                        row, number, sums = row[order], number[order], np.zeros((len(ws), dims))
                        part = number // width
                    if c.as_py() != chunk:
                        chunk = c.as_py()
                        by = _dense(y, chunk * width, width, dims, told.value[1])
                    on = slice(*np.searchsorted(part, [chunk, chunk + 1]))
                    _added(row[on], number[on] - chunk * width, None, by, len(sums), sums)
            if at is not None:
                yield from _finished(keys, sums, finish)

        return y.hint("shuffle_replicate_nl").crossJoin(x).select("__r", "__c", "__x", "__y").mapInArrow(run, schema)


def _finished(keys: pa.Array, sums: np.ndarray, finish: Callable[[pa.Array, np.ndarray], pa.Table]) -> Iterator[pa.RecordBatch]:
    for f in range(0, len(sums), AT_ONCE):
        v = sums[f : f + AT_ONCE]
        length = np.sqrt((v * v).sum(axis=1))
        on = np.flatnonzero(length > 0)
        if on.size:
            yield from finish(keys.slice(f, AT_ONCE).take(pa.array(on)), v[on] / length[on, None]).combine_chunks().to_batches()


def _sealed(columns: list, names: list[str], tight: bool = True) -> bytes:
    table, sink = pa.table([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd" if tight else None)) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(block: pa.BinaryScalar) -> pa.Table:
    with pa.ipc.open_stream(block.as_buffer()) as stream:
        return stream.read_all()


def _dense(block: pa.BinaryScalar, first: int, width: int, columns: int, scale: np.ndarray | None = None) -> np.ndarray:
    """The block of vectors (number, v) as a matrix from number `first` on; numbers without a vector have zeros."""
    table, out = _opened(block), np.zeros((width, columns))
    number = table["number"].to_numpy()
    v = _columns(table["v"].combine_chunks())
    out[number - first] = v if scale is None else v * scale[number, None]
    return out


def _lists(v: np.ndarray) -> pa.Array:
    v = np.ascontiguousarray(v)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def _columns(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(row: np.ndarray, at: np.ndarray, x: np.ndarray | None, by: np.ndarray, n: int, out: np.ndarray | None = None) -> np.ndarray:
    """n rows: at `row` (ascending) the sum of x times the rows `at` of `by`, added to `out`. Rows of equally many terms go together."""
    out = np.zeros((n, by.shape[1])) if out is None else out
    if not row.size:
        return out
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, row.size])
    order = np.argsort(size, kind="stable")
    size, first = size[order], first[order]
    edges = np.flatnonzero(np.r_[True, size[1:] != size[:-1], True])
    for i, j in zip(edges[:-1], edges[1:]):
        k = int(size[i])
        for f in range(0, k, AT_ONCE):  # terms of a row that go at once
            places = np.arange(f, min(k, f + AT_ONCE))
            step = max(1, AT_ONCE // places.size)
            one = np.ones((1, places.size))
            for g in range(i, j, step):
                t = first[g : min(j, g + step), None] + places
                terms = by[at[t]]
                out[row[t[:, 0]]] += np.matmul(one if x is None else x[t][:, None, :], terms)[:, 0]
    return out


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def vocabulary(told: DataFrame, least: int) -> tuple[DataFrame, int, int]:
    """(known(word, n, h), how many, seed of the hashes h) of told(told), the words of each text's sentences: words in at least `least` texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            told = words.flatten().dictionary_encode()
            many, code = len(told.dictionary), told.indices.to_numpy().astype(np.int64)
            if many:
                text = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
                code_of_text = np.sort(text * many + code)
                texts = np.bincount(code_of_text[np.r_[True, code_of_text[1:] != code_of_text[:-1]]] % many, minlength=many)
                yield pa.RecordBatch.from_arrays([told.dictionary, pa.array(texts), pa.array(np.bincount(code, minlength=many))], ["word", "texts", "n"])

    every = told.select(F.flatten("told").alias("ws")).mapInArrow(count, "word string, texts long, n long")
    every = cut(every.groupBy("word").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n")))
    seed = 0
    while len(set(every.agg(F.count(F.lit(1)), F.count_distinct(F.xxhash64("word", F.lit(seed)))).first())) > 1:  # two words share a hash
        seed += 1
    known = cut(every.where(F.col("texts") >= least).select("word", "n", F.xxhash64("word", F.lit(seed)).alias("h")))
    return known, known.count(), seed


def start(word: Column, columns: int) -> Column:
    """Signs hashed from the word."""
    return F.array(*[F.when(F.xxhash64(word, F.lit(k)) < 0, -1.0).otherwise(1.0) for k in range(columns)])


def _counts(told: DataFrame, codes: Codes, width: int, parts: int, reach: int, words: int) -> tuple[DataFrame, np.ndarray]:
    """(entries(g, c, blocks), sums): how often words stand near each other, both ways round, as blocks of rows by blocks of columns, a partition a block of rows;
    sums of the rows. told(told): the words of each text's sentences, about `words` in all."""
    known, size = codes.told, codes.size
    subs = max(1, min(width, 2 * reach * words // (parts * COUNTS)))
    rows = -(-width // subs)

    def passed(codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        code = np.sort(np.concatenate(codes))
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        code, n = code[first], np.diff(np.r_[first, code.size])
        a, b = np.divmod(code, size)
        a, b, n = np.r_[a, b], np.r_[b, a], np.r_[n, n]  # a word with itself is seen from both of its places
        part = a // width * subs + a % width // rows
        order = np.argsort(part, kind="stable")
        a, b, n, part = (v[order] for v in (a, b, n, part))
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for f, t in zip(edges[:-1], edges[1:]):
            block = _sealed([a[f:t].astype(np.int32), b[f:t].astype(np.int32), n[f:t].astype(np.int32)], ["a", "b", "n"], False)
            yield pa.RecordBatch.from_arrays([pa.array([part[f] // subs], pa.int32()), pa.array([part[f] % subs], pa.int32()), pa.array([block], pa.binary())], ["g", "sub", "block"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            number = _numbers(batch.column(0).flatten().to_numpy(), known.value[0])
            sizes = batch.column(1).flatten().to_numpy()
            sentence = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)
            for f in range(0, number.size, PAIRS // reach):  # the words from f on, with those after them
                last = min(number.size, f + PAIRS // reach)
                for k in range(1, reach + 1):
                    b = number[f + k : last + k]
                    a = number[f : f + b.size]
                    on = (a >= 0) & (b >= 0) & (sentence[f : f + b.size] == sentence[f + k : last + k])
                    a, b = a[on], b[on]
                    held.append(np.minimum(a, b) * size + np.maximum(a, b))
                    many += a.size
                if many > PAIRS:
                    yield from passed(held)
                    held, many = [], 0
        if many:
            yield from passed(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, at, group, out, sums = [], None, None, {}, []

        def close() -> None:
            a, b, n = (np.concatenate([t[c].to_numpy() for t in got]).astype(np.int64) for c in ("a", "b", "n"))
            a, c, b = a - group * width, *np.divmod(b, width)
            code = (c * width + a) * width + b
            order = np.argsort(code, kind="stable")
            code = code[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            code, n = code[first], np.add.reduceat(n[order], first)
            c, a, b = code // (width * width), code // width % width, code % width
            total = np.bincount(a, weights=n, minlength=width)
            on = np.flatnonzero(total)
            sums.append((on + group * width, total[on]))
            edges = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True])
            for f, t in zip(edges[:-1], edges[1:]):
                out.setdefault(int(c[f]), []).append(_sealed([a[f:t].astype(np.int32), b[f:t].astype(np.int32), n[f:t]], ["a", "b", "n"]))
            got.clear()

        for batch in batches:
            for g, sub, block in zip(batch["g"], batch["sub"], batch["block"]):
                if sub.as_py() != at and got:
                    close()
                group, at = g.as_py(), sub.as_py()
                got.append(_opened(block))
        if got:
            close()
        if group is not None:
            out.setdefault(group, [])  # a block of rows meets its own vectors in any case
            out[-1] = [_sealed([np.concatenate([s[0] for s in sums]), np.concatenate([s[1] for s in sums])], ["number", "sum"])]
        for c, blocks in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([c], pa.int32()), pa.array([blocks], pa.list_(pa.binary()))], ["g", "c", "blocks"])

    pairs = told.select(codes.hashed(F.flatten("told")).alias("ws"), F.transform("told", F.size).alias("sizes")).mapInArrow(near, "g int, sub int, block binary")
    entries = cut(pairs.repartitionById(parts, F.col("g")).sortWithinPartitions("sub").mapInArrow(add, "g int, c int, blocks array<binary>"))
    sums = np.zeros(size)
    for (blocks,) in entries.where("c < 0").select("blocks").collect():
        table = _opened(pa.scalar(bytes(blocks[0]), pa.binary()))
        sums[table["number"].to_numpy()] = table["sum"].to_numpy()
    return entries, sums


def _block(number: np.ndarray, v: np.ndarray, g: int, gram: np.ndarray) -> pa.RecordBatch:
    sealed = _sealed([number.astype(np.int64), _lists(v)], ["number", "v"], False)
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([sealed], pa.binary()), pa.array([gram.ravel()], pa.list_(pa.float64()))], ["c", "block", "gram"])


BLOCK = "c int, block binary, gram array<double>"


def _started(known: DataFrame, codes: Codes, width: int, parts: int, columns: int) -> DataFrame:
    """The first block of vectors, (c, block, inner products of its columns)."""
    told = codes.told

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = _numbers(batch.column(0).to_numpy(), told.value[0])
            yield pa.RecordBatch.from_arrays([pa.array((n // width).astype(np.int32)), pa.array(n), batch.column(1)], ["c", "number", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got)
            v = _columns(table["v"].combine_chunks()).astype(float)
            order = np.argsort(table["number"].to_numpy())  # sums don't depend on the order of arrival
            yield _block(table["number"].to_numpy()[order], v[order], table["c"][0].as_py(), v.T @ v)

    signs = known.select("h", start(F.col("word"), columns).cast("array<tinyint>").alias("v"))
    return cut(signs.mapInArrow(number, "c int, number long, v array<tinyint>").repartitionById(parts, F.col("c")).mapInArrow(pack, BLOCK))


def _times(entries: DataFrame, sums: Broadcast, block: DataFrame, turn: np.ndarray, width: int, within: bool = False) -> DataFrame:
    """The matrix times the block of vectors, itself times `turn`; rows without an entry are left out. within: the last column has the inner
    products with the block's own columns, else those of the result's."""
    y = block.select(F.col("c").alias("__c"), F.col("block").alias("__y")).coalesce(1)
    x = entries.where("c >= 0").withColumnRenamed("c", "__d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, columns = None, None, turn.shape[1]
        s, out, seen, own = sums.value, np.zeros((width, columns)), np.zeros(width, bool), np.zeros((width, columns))
        whole = s.sum()
        for batch in batches:
            for g, c, blocks, vectors in zip(batch["g"], batch["__c"], batch["blocks"], batch["__y"]):
                group, c = g.as_py(), c.as_py()
                if c != at:
                    at, v = c, _dense(vectors, c * width, width, len(turn)) @ turn
                own = v if c == group else own
                for b in blocks.values:
                    e = _opened(b)
                    row, col = e["a"].to_numpy(), e["b"].to_numpy()
                    ratio = e["n"].to_numpy() * whole / (s[row + group * width] * s[col + c * width])
                    on = ratio > 1
                    row = row[on]
                    seen[row] = True
                    _added(row, col[on], np.log(ratio[on]), v, width, out)
        if seen.any():
            on = np.flatnonzero(seen)
            yield _block(on + group * width, out[on], group, (own if within else out).T @ out)

    pairs = y.hint("shuffle_replicate_nl").crossJoin(x).where("__c = __d").select("g", "__c", "blocks", "__y")
    return pairs.mapInArrow(run, BLOCK)


def _products(block: DataFrame, columns: int) -> np.ndarray:
    """Inner products of all blocks, added up."""
    out = np.zeros(columns * columns)
    for k, x in block.select(F.posexplode("gram").alias("k", "x")).groupBy("k").agg(F.sum("x")).collect():
        out[k] = x
    out = out.reshape(columns, columns)
    return (out + out.T) / 2


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """What to multiply a block by, given its inner products, so that its columns are orthonormal; directions without length go."""
    e, u = np.linalg.eigh(gram)
    keep = e > e.max(initial=0) * 1e-12
    return (u[:, keep] / np.sqrt(e[keep]))[:, ::-1]


def learn(texts: DataFrame, dims: int = DIMS, steps: int = STEPS, reach: int = REACH, least: int = LEAST, text: str = "text") -> Contexts:
    """Word vectors from the texts: eigenvectors of largest absolute eigenvalue, scaled by its root. Null texts count as empty; a corpus without
    a word in `least` texts gives a vocabulary without rows."""
    spark = texts.sparkSession
    told = stored(texts.select(F.transform(sentences(F.coalesce(F.col(text), F.lit(""))), words_of).alias("told")))
    known, size, seed = vocabulary(told, least)
    nothing = Contexts(known.select("word", F.lit(0.0).alias("weight"), F.array().cast("array<double>").alias("v")).limit(0), [])
    if not size:
        return nothing
    got = known.select("h", "n").toArrow()
    order = np.argsort(got["h"].to_numpy())
    hashes, n = got["h"].to_numpy()[order], got["n"].to_numpy()[order]
    weights = RARE / (RARE + n / float(n.sum()))
    codes = Codes(seed, size, spark.sparkContext.broadcast((hashes, weights)))
    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-size // CHUNK), min(cores, -(-size // 512)))
    parts = -(-parts // cores) * cores if parts > cores else parts  # tasks end together
    width = -(-size // parts)
    entries, sums = _counts(told, codes, width, parts, reach, int(n.sum()))
    sums = spark.sparkContext.broadcast(sums)
    columns = dims + SPARE
    block = _started(known, codes, width, parts, columns)
    for _ in range(steps):
        turn = _orthonormal(_products(block, columns))
        columns = turn.shape[1]
        block = cut(_times(entries, sums, block, turn, width))
        if block.isEmpty():
            return nothing
    turn = _orthonormal(_products(block, columns))
    # the matrix within the block, and its own eigenvectors
    e, u = np.linalg.eigh(_products(_times(entries, sums, block, turn, width, within=True), turn.shape[1]))
    best = np.argsort(-np.abs(e), kind="stable")[:dims]
    by = turn @ (u[:, best] * np.sqrt(np.abs(e[best])))
    told_codes = codes.told

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, b in zip(batch["c"], batch["block"]):
                table = _opened(b)
                sealed = _sealed([table["number"].combine_chunks(), _lists(_columns(table["v"].combine_chunks()) @ by)], ["number", "v"], False)
                yield pa.RecordBatch.from_arrays([pa.array([c.as_py()], pa.int32()), pa.array([sealed], pa.binary())], ["c", "block"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch["block"]:
                table = _opened(b)
                number = table["number"].to_numpy()
                hashes, weights = told_codes.value
                yield pa.RecordBatch.from_arrays([pa.array(hashes[number]), pa.array(weights[number]), table["v"].combine_chunks()], ["h", "weight", "v"])

    blocks = cut(block.select("c", "block").mapInArrow(turned, "c int, block binary"))
    words = known.join(blocks.select("block").mapInArrow(rows, "h long, weight double, v array<double>"), "h").select("word", "weight", "v")
    return Contexts(words, e[best].tolist(), codes, blocks, width)
