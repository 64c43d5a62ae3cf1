"""Source divergence audit by sorted runs.

Terms are runs of letters A-Z, a-z and of characters beyond ASCII, with A-Z lower-cased. Every task sorts the terms of its documents
by (lang, source, term, document) and reads off runs: the documents of a run are its document frequency there, its
length the count. Only such partial runs are shuffled: no key has more of them than there are tasks and sources,
however frequent its term. They are repartitioned by (lang, term), sorted by (lang, term, source) and
scanned once more, which adds up partial runs and drops the terms of too few documents. What is held of a scan
is one term's runs, one for each source of the language.

Each language keeps the V terms in at least LEAST of its documents. A kept term that occurs `count` times in a source's documents of the
language has the share p = 1 + floor(10^9 * (count + 2) / (N + 2 V)) there, N being the source's sum of counts; in the language
as a whole likewise. Two shares diverge by floor((p - q)^2 / (p + q)). All arithmetic is whole-number.

Pairs of sources sum that over all kept terms. Most terms are absent from most sources, so a pair's sum starts from V times
the divergence of two absent terms; each source's runs, grouped by count, correct it for the other's being absent, and
runs of one term correct it where both have it. Neither takes terms times sources in rows that are shuffled: partial pairs are added up first.

Null texts, languages and sources count as ''. Each row is a document of its own, also where rows repeat or share an id. A
language without kept terms has pairs of value 0 and no terms. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, cut

#: Documents that a term must be in; terms reported of a group.
LEAST, TOP = 10, 10
UNIT = 1_000_000_000
#: Bytes of text that are sorted at once; partial runs and distinct terms that a task holds before it passes them on; rows of a batch.
BLOCK_BYTES, HELD_RUNS, HELD_TERMS, BATCH = 4 << 20, 1 << 21, 1 << 19, 1 << 16
#: Every byte that is no part of a term becomes a space, A-Z their lower case.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
RUNS = "lang string, term string, source string, documents long, n long"


def _fold_runs(keys: np.ndarray, documents: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each key, sorted, with the sums of the others."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(documents[order], heads), np.add.reduceat(n[order], heads)


def _block_runs(texts: list[bytes], group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, group of a run, term of a run, documents, count) of some documents."""
    words = [t.translate(FOLD).split() for t in texts]
    size = np.array([len(w) for w in words])
    flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
    doc, many = np.repeat(np.arange(len(texts)), size), max(1, len(flat.dictionary))
    # sorted by group, term and document
    key = np.sort((group[doc] * many + flat.indices.to_numpy().astype(np.int64)) * len(texts) + doc)
    run = key // len(texts)
    heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))[: key.size]
    news = np.concatenate([[1], key[1:] != key[:-1]]).astype(np.int64)[: key.size]
    documents = np.add.reduceat(news, heads) if key.size else news
    return flat.dictionary.to_pylist(), run[heads] // many, run[heads] % many, documents, np.diff(np.append(heads, key.size))


def partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, documents, n) of a task's documents. batches: lang, source, text."""
    groups: dict[tuple, int] = {}
    terms: dict[bytes, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        names = pa.array(list(terms), pa.binary()).cast(pa.string())
        keys, documents, n = held[0]
        for k in range(0, keys.size, BATCH):
            part = slice(k, k + BATCH)
            of, at = pa.array(keys[part] >> 32), pa.array(keys[part] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([langs.take(of), names.take(at), sources.take(of), pa.array(documents[part]), pa.array(n[part])], ["lang", "term", "source", "documents", "n"])

    for batch in batches:
        group = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
        column = batch.column(2).cast(pa.large_binary())
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
        k, before = 0, 0
        while k < len(column):
            to = max(k + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
            local, of = np.unique(group[k:to], return_inverse=True)
            words, g, t, documents, n = _block_runs(column.slice(k, to - k).to_pylist(), of)
            ids = np.array([terms.setdefault(w, len(terms)) for w in words], np.int64)
            if n.size:
                held.append((local[g] << 32 | ids[t], documents, n))
                rows += n.size
            if rows > HELD_RUNS or len(terms) > HELD_TERMS:
                held[:] = [_fold_runs(*map(np.concatenate, zip(*held)))]
                rows = held[0][0].size
                if rows > HELD_RUNS // 2 or len(terms) > HELD_TERMS:
                    yield from passed_on()
                    groups_seen, rows = list(groups), 0
                    held.clear(), terms.clear(), groups.clear()
                    group = np.array([groups.setdefault(groups_seen[i], len(groups)) for i in group], np.int64)
            k, before = to, int(ends[to - 1])
    if held:
        held[:] = [_fold_runs(*map(np.concatenate, zip(*held)))]
        yield from passed_on()


def _heads(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a sorted table's rows differ from the one before in one of the columns."""
    new = np.zeros(len(table), bool)
    new[0] = True
    for c in columns:
        x = table[c].chunk(0)
        new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def kept_runs(least: int):
    """Scan of partial runs in the order (lang, term, source): the runs of terms in at least `least` documents, with the language's count;
    `first` is 1 for one run of each term."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            at = _heads(table, ["lang", "term", "source"])
            sums = [np.add.reduceat(table[c].to_numpy(), at) for c in ("documents", "n")]
            table = pa.table([*[table[c].take(pa.array(at)) for c in ("lang", "term", "source")], *map(pa.array, sums)], ["lang", "term", "source", "documents", "n"]).combine_chunks()
            last = int(_heads(table, ["lang", "term"])[-1])  # the next batch may go on with this term
            held = table.slice(last).combine_chunks().to_batches()[0]
            if last:
                yield from kept(table.slice(0, last).combine_chunks())
        if held is not None:
            yield from kept(pa.Table.from_batches([held]).combine_chunks())

    def kept(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at = _heads(table, ["lang", "term"])
        size = np.diff(np.append(at, len(table)))
        on = np.repeat(np.add.reduceat(table["documents"].to_numpy(), at) >= least, size)
        first = np.zeros(len(table), np.int64)
        first[at] = 1
        both = table.drop_columns(["documents"]).append_column("n_lang", pa.array(np.repeat(np.add.reduceat(table["n"].to_numpy(), at), size)))
        yield from both.append_column("first", pa.array(first)).filter(pa.array(on)).combine_chunks().to_batches()

    return scan


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count: exact, also where a billion times the count is no long."""
    scaled = (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", scaled, (total + 2 * terms).cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    p, q = p.cast("long"), q.cast("long")
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' for each other source of the language, part 'term' for the `top` terms
    that the source has more of than its language."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = df.select(*said)
    runs = docs.mapInArrow(partial_runs, RUNS).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    runs = cut(runs.mapInArrow(kept_runs(least), "lang string, term string, source string, n long, n_lang long, first long"))

    langs = runs.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("total_lang"))
    sizes = runs.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["terms", "total", "total_lang"])
    # what a term has that the group is without; null where the language keeps none
    groups = groups.withColumn("none", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))))
    groups = cut(groups)
    rows = runs.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    q = share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    above = rows.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    # Pairs a < b: all terms as if absent from both ...
    # (A language's rows are dealt to SALTS tasks; its groups meet them in each.)
    salt = F.pmod(F.xxhash64("lang", "source", "p"), F.lit(SALTS)).alias("salt")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    left = groups.withColumn("p", F.lit(0)).select("lang", F.col("source").alias("a"), F.col("none").alias("none_a"), "terms", salt)
    right = groups.select("lang", F.col("source").alias("b"), F.col("none").alias("none_b"), every)
    base = left.join(right, ["lang", "salt"]).where("a < b").select("lang", "a", "b", F.coalesce(F.col("terms") * apart(F.col("none_a"), F.col("none_b")), F.lit(0)).alias("value"))
    # ... then what either has, against the other's being without it ...
    alike = rows.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("m")).select("*", salt)
    other = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("none_other"), every)
    one = alike.join(other, ["lang", "salt"]).where("source <> other")
    more = F.col("m") * (apart(F.col("p"), F.col("none_other")) - apart(F.col("none"), F.col("none_other")))
    one = one.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), more.alias("value"))
    # ... and what both have.
    has = rows.select("lang", "term", "source", "p", "none")
    x = has.select("lang", "term", *[F.col(c).alias(f"{c}_a") for c in ("source", "p", "none")])
    y = has.select("lang", "term", *[F.col(c).alias(f"{c}_b") for c in ("source", "p", "none")])
    c = F.col
    both = x.join(y, ["lang", "term"]).where("source_a < source_b")
    more = apart(c("p_a"), c("p_b")) - apart(c("p_a"), c("none_b")) - apart(c("none_a"), c("p_b")) + apart(c("none_a"), c("none_b"))
    both = both.select("lang", c("source_a").alias("a"), c("source_b").alias("b"), more.alias("value"))
    add = [part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for part in (one, both)]
    pairs = cut(base.unionByName(add[0]).unionByName(add[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    sides = [pairs.select("lang", F.col(s).alias("source"), F.lit("pair").alias("part"), F.col(o).alias("item"), "value") for s, o in ("ab", "ba")]

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [t.withColumn("rank", F.row_number().over(order)) for t in (above, sides[0].unionByName(sides[1]))]
    return ranked[0].where(F.col("rank") <= top).unionByName(ranked[1])
