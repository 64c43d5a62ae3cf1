"""Substring dedup by recompression: words covered by a window of WINDOW words that starts elsewhere too.

Rounds of recompression turn a text's word names into ever longer symbols. A round names maximal runs of a symbol, then the pairs of a
left and a right symbol, the sides being dealt anew in each round by a hash. A name is a hash of what it stands for: the same
in every task without a dictionary. Whether two neighbours are merged depends on these two symbols only, so equal substrings
get equal symbols but for one at either end in each round. What is left of a window after as many
rounds as leave something is its core; the longest symbol of the core, the first of equal ones, is the window's
anchor. Equal windows have equal anchors at the same place within them.

1. Equal texts are one text with a number of copies; a text with more than one is all repeats, if it has a window.
2. Every text gives its anchors, each with the stretch of windows it stands for; anchors found once are dropped. These are few rows
   a text, far fewer than windows.
3. Shared anchors are verified, stretch by stretch: all windows of a stretch are repeats if its digest (128 bits over its words in order) is
   found more than once.
4. Where an anchor has stretches that differ, single windows decide: those of one stretch of each kind are digested, and
   windows found more than once are repeats. That is left for the ends of passages and the surroundings of edits.
5. The words of repeated windows are removed, on the input all at once.

Only names, digests, positions and (four times) texts are shuffled, never pairs; counts are combined map-side and joined back, so
a passage that all documents share is split by the skew join. Intermediate tables are written to the checkpoint folder and
deleted at the end.

Null texts count as empty: no words, nothing removed. Repeated rows, rows that share an id and rows with a null id
each get their row; equal texts repeat each other whatever their ids. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import CLEANUP
from .common import cut, ensure_checkpoint_dir, positional
from .simhash import xxh64_slices

WINDOW = 35
#: Bytes of text that are worked on at once, and rows of a batch of digests.
BLOCK_BYTES, BATCH = 2 << 20, 1 << 16
#: Seeds of the two names of a word.
SEEDS = (20240611, 7130214)
#: Odd multipliers of the names, and the bases of the two digests with their inverses modulo 2^64.
MIX = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
BASES = [0x2545F4914F6CDD1D, 0x5851F42D4C957F2D]
ROUND, RUN, PAIR = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[1]
    x = (x ^ (x >> np.uint64(29))) * MIX[2]
    return x ^ (x >> np.uint64(32))


def _named(a: np.ndarray, b: np.ndarray, kind: np.uint64) -> np.ndarray:
    """Name of an ordered pair."""
    return _mixed(_mixed(a * MIX[0] + kind) + b)


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text, and their number; two names of each word)."""
    words = [t.split() for t in texts]  # bytes are split at the six ASCII white-space characters
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    known = flat.dictionary
    _, ends, data = known.buffers()
    ends = np.frombuffer(ends, np.int32)[known.offset : known.offset + len(known) + 1].astype(np.int64) if len(known) else np.zeros(1, np.int64)
    data = np.concatenate([np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    at = flat.indices.to_numpy()
    names = [xxh64_slices(data, ends[:-1], np.diff(ends), seed)[at] for seed in SEEDS]
    return np.concatenate([[0], np.cumsum([len(w) for w in words])]), *names


def anchors(symbol: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of a window, name of its anchor, first word of the anchor) of all windows, in order. Text k has the words first[k] to first[k + 1]."""
    n = symbol.size
    starts = np.flatnonzero(np.arange(n) + window <= np.repeat(first[1:], np.diff(first)))
    name, place = np.zeros(starts.size, np.uint64), np.zeros(starts.size, np.int64)
    edge = np.zeros(n + 1, bool)  # by word: a text begins
    edge[first] = True
    begin = np.arange(n + 1)  # first word of each symbol, and the end
    live = np.arange(starts.size)
    low, high = starts.copy(), starts + window  # the core, as symbols
    k = 0
    with np.errstate(over="ignore"):
        while live.size:
            left, right = symbol[:-1], symbol[1:]
            side = (_mixed(symbol + np.uint64(k) * ROUND) >> np.uint64(63)).astype(bool)
            new = edge[begin[:-1]]
            equal = np.concatenate([[False], left == right]) & ~new
            run = np.flatnonzero(~equal)  # runs
            many = np.diff(np.append(run, symbol.size))
            runs = np.where(many > 1, _named(symbol[run], many.astype(np.uint64), RUN), symbol[run])
            second = np.zeros(run.size, bool)  # runs that end a pair
            second[1:] = ~side[run[:-1]] & side[run[1:]] & ~new[run[1:]]
            heads = np.flatnonzero(~second)
            paired = np.append(second[1:], False)[heads]
            merged = runs[heads]
            merged[paired] = _named(runs[heads[paired]], runs[heads[paired] + 1], PAIR)
            of = np.zeros(symbol.size, np.int64)  # symbol -> merged symbol
            of[run[heads]] = 1
            of = np.cumsum(of) - 1
            # What lies between the first and the last boundary inside a core is decided by the window alone.
            up, down = of[low] + 1, of[high - 1]
            done = up >= down
            if done.any():
                at = np.flatnonzero(done)
                a, b, w = low[at], high[at], live[at]
                group = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                long = np.append((np.diff(begin) << 32) | (np.arange(symbol.size)[::-1]), 0)
                best = np.maximum.reduceat(long, np.stack([a[group], b[group]], axis=1).ravel())[::2]
                best = symbol.size - 1 - (best & 0xFFFFFFFF)
                best = np.repeat(best, np.diff(np.append(group, at.size)))
                name[w], place[w] = symbol[best], begin[best]
                go = ~done
                live, up, down = live[go], up[go], down[go]
            low, high = up, down
            begin = np.append(begin[run[heads]], n)
            symbol = merged
            k += 1
    return starts, name, place


def digests(names: tuple[np.ndarray, np.ndarray], starts: np.ndarray, size: np.ndarray | int = WINDOW) -> list[np.ndarray]:
    """Two 64-bit digests of each span of words, over the names of its words in order."""
    out = []
    with np.errstate(over="ignore"):
        for h, base in zip(names, BASES):
            powers = np.full(h.size, base, np.uint64).cumprod(dtype=np.uint64)
            inverse = np.full(h.size, pow(base, -1, 1 << 64), np.uint64).cumprod(dtype=np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)])
            out.append(_mixed((sums[starts + size] - sums[starts]) * inverse[starts]).view(np.int64))
    return out


def _text_blocks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts) of consecutive rows, about BLOCK_BYTES each."""
    column = batch.column(at).cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    k, before = 0, 0
    while k < len(column):
        to = max(k + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
        yield k, to, column.slice(k, to - k).to_pylist()
        k, before = to, int(ends[to - 1])


def _lists(column: pa.Array, k: int, to: int) -> tuple[np.ndarray, pa.Array]:
    """(row, value) of the list entries of rows k to to, row counted from k."""
    part = column.slice(k, to - k)
    size = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(to - k), size), part.flatten()


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for k, to, texts in _text_blocks(batch, 1):
                first, names, _ = word_names(texts)
                starts, name, place = anchors(names, first, window)
                if not starts.size:
                    continue
                text = np.searchsorted(first, starts, "right") - 1
                new = (name[1:] != name[:-1]) | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(np.concatenate([[True], new]))
                many = np.diff(np.append(at, starts.size))
                stretch = (starts[at] - first[text[at]]) << 32 | many
                yield pa.RecordBatch.from_arrays([pa.array(name[at].view(np.int64)), pa.array(ids[k:to][text[at]]), pa.array(stretch)], ["name", "id", "stretch"])

    return run


def _stretch_rows(window: int):
    """Digests of the given stretches. batches: id, text, list of (name, first window << 32 | windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for k, to, texts in _text_blocks(batch, 1):
                first, *names = word_names(texts)
                row, marks = _lists(batch.column(2), k, to)
                name, stretch = marks.flatten()
                at = stretch.to_numpy()
                a, b = digests(tuple(names), first[row] + (at >> 32), (at & 0xFFFFFFFF) + window - 1)
                yield pa.RecordBatch.from_arrays([name, pa.array(a), pa.array(b), pa.array(ids[k:to][row]), stretch], ["name", "a", "b", "id", "stretch"])

    return run


def _window_rows(window: int):
    """Digests of all windows of the given stretches. batches: id, text, stretches. Each row is a stretch of one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for k, to, texts in _text_blocks(batch, 1):
                first, *names = word_names(texts)
                row, stretch = _lists(batch.column(2), k, to)
                stretch = stretch.to_numpy()
                many = stretch & 0xFFFFFFFF
                row = np.repeat(row, many)
                at = np.repeat(stretch >> 32, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                a, b = digests(tuple(names), first[row] + at, window)
                for s in range(0, at.size, BATCH):
                    part = slice(s, s + BATCH)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (a[part], b[part], ids[k:to][row[part]], at[part] << 32 | 1))], ["a", "b", "id", "stretch"])

    return run


def _removed_rows(window: int, keep_text: bool):
    """batches: k, l, text, copies, stretches of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = batch.column(3).to_numpy()
            for k, to, texts in _text_blocks(batch, 2):
                row, stretch = _lists(batch.column(4), k, to)
                at, many = stretch.to_numpy() >> 32, stretch.to_numpy() & 0xFFFFFFFF
                words = [t.split() for t in texts]
                first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
                change = np.zeros(first[-1] + 1, np.int64)
                np.add.at(change, first[row] + at, 1)
                np.add.at(change, first[row] + at + many + window - 1, -1)
                stays = np.cumsum(change)[:-1] == 0
                out = []
                for i, w in enumerate(words):
                    on = stays[first[i] : first[i + 1]]
                    if len(w) >= window and copies[k + i] > 1:
                        on = np.zeros(len(w), bool)
                    out.append(b" ".join(w if on.all() else [w[j] for j in np.flatnonzero(on)]))
                    removed = len(w) - int(on.sum())
                    words[i] = (len(w), removed, hashlib.sha256(out[-1]).hexdigest())
                n, gone, sha = zip(*words)
                columns = [batch.column(0).slice(k, to - k), batch.column(1).slice(k, to - k), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
                fields = ["k", "l", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array(out, pa.binary()).cast(pa.string()))
                    fields.append("kept")
                yield pa.RecordBatch.from_arrays(columns, fields)

    return run


@contextmanager
def _folder(spark):
    """store(df): `df` written to the checkpoint folder and read again; drop() of what it gave. All goes at the end."""
    ensure_checkpoint_dir(spark)
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/repeats-{uuid.uuid4().hex}")
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())

    def store(df: DataFrame, name: str) -> DataFrame:
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")  # shuffle files of what led to the table go with it
        try:
            df.select("*").write.option("compression", "zstd").parquet(f"{base.toString()}/{name}")
        finally:
            spark.conf.set(CLEANUP, before)
        return spark.read.schema(df.schema).parquet(f"{base.toString()}/{name}")

    def drop(name: str) -> None:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(base, name), True)

    try:
        yield store, drop
    finally:
        files.delete(base, True)


def _shared(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key is found more than once. Counts are combined map-side; the join back is split where a key is hot."""
    often = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    return rows.join(often.hint("shuffle_merge"), list(keys))


def _key(text) -> list:
    return [F.xxhash64(text).alias("k"), F.xxhash64(F.lit("repeats"), text).alias("l")]


def removed(df: DataFrame, text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """(k, l, n_words, n_removed, kept_sha256, and `kept` where keep_text) of each distinct text; k and l are its hashes (`_key`)."""
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(text.alias("text")).select("text", *_key(F.col("text")))
    with _folder(spark) as (store, drop):
        texts = rows.groupBy("k", "l").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        texts = store(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
        found = texts.select("id", "text").mapInArrow(_anchor_rows(window), "name long, id long, stretch long")
        found = store(found, "anchors")
        marks = cut(_shared(found, "name").groupBy("id").agg(F.collect_list(F.struct("name", "stretch")).alias("marks")))
        drop("anchors")
        marked = texts.select("id", "text").join(marks, "id").select("id", "text", "marks")
        found = store(marked.mapInArrow(_stretch_rows(window), "name long, a long, b long, id long, stretch long"), "stretches")
        kinds = store(found.groupBy("name", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "stretch")).alias("one")), "kinds")
        same = found.join(kinds.where("n > 1").select("name", "a", "b").hint("shuffle_merge"), ["name", "a", "b"]).select("id", "stretch")
        same = store(same, "same")
        drop("stretches")
        unlike = cut(_shared(kinds, "name").select("one.*").groupBy("id").agg(F.collect_list("stretch").alias("stretches")))
        drop("kinds")
        marked = texts.select("id", "text").join(unlike, "id").select("id", "text", "stretches")
        windows = store(marked.mapInArrow(_window_rows(window), "a long, b long, id long, stretch long"), "windows")
        repeated = _shared(windows, "a", "b").select("id", "stretch").unionByName(same)
        repeated = cut(repeated.groupBy("id").agg(F.collect_list("stretch").alias("stretches")))
        drop("windows"), drop("same")
        out = texts.join(repeated, "id", "left").select("k", "l", "text", "copies", "stretches")
        fields = "k long, l long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
        return cut(out.mapInArrow(_removed_rows(window, keep_text), fields))


def remove_repeats(df: DataFrame, text_col: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """`df` with n_words, n_removed, kept_sha256 and, if keep_text, `kept`: the words that stay, joined by one space. Columns of `df` with
    these names give way to them."""
    found = removed(df, text_col, window, keep_text)
    news = found.columns[2:]
    rows, name = positional(df)
    text = F.coalesce(F.col(name[text_col]).cast("string"), F.lit(""))
    stay = [c for c in df.columns if c not in news]
    rows = rows.select(*[name[c] for c in stay], *_key(text))
    return rows.join(found, ["k", "l"]).select(*[name[c] for c in stay], *news).toDF(*stay, *news)
