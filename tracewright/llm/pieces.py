"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch (runs of spaces with what follows them: no piece holds a space
after another character) are concatenated and indexed by a suffix array. Every piece of the
vocabulary is binary-searched for its range of occurrences; the ranges give the edges of a
lattice, which are sorted by position and relaxed from left to right. For a merge-ranked (BPE)
vocabulary the relaxation is exact: the encoding of a prefix ends in the one edge whose piece may
stand beside the last piece of the encoding that it extends, that is, whose seam no merge of
better rank would have crossed before the pieces on either side were complete. Longer edges are
tried first. Characters outside of the vocabulary fall back to their bytes.

Texts are encoded whole; null and empty texts give no pieces. Segments and their pieces are kept
between the batches of a worker, up to a bound after which they start anew.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Characters of distinct segments that are indexed at once, of texts that are encoded at once, and segments kept.
INDEX_CHARS, BATCH_CHARS, KEPT = 1 << 19, 1 << 21, 300_000
#: log2 of the entries of the table of seams seen.
SEAM_BITS = 21


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        shift += 7
        if x < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        else:
            if tag & 7 == 2:
                n, i = _varint(b, i)
            else:
                n = {1: 8, 5: 4}[tag & 7]
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Vocabulary:
    """Tables of a BPE model file, made once on the driver; their size depends on the model alone."""

    def __init__(self, model: bytes):
        pieces, trainer = [], {}
        for number, value in _fields(model):
            if number == 1:
                got = dict(_fields(value))
                score = struct.unpack("<f", got[2])[0] if 2 in got else 0.0
                pieces.append((got.get(1, b"").decode(), score, got.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("a BPE model is needed")
        self.size = len(pieces)
        self.text = [p[0] for p in pieces]
        self.kind = np.array([p[2] for p in pieces])
        ids = {p[0]: i for i, p in enumerate(pieces) if p[2] in (1, 4)}
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kind == 6):
            self.byte_id[int(pieces[i][0][3:5], 16)] = i
        # What decoding writes for each id.
        raw = [b"" if k in (2, 3) else bytes([int(t[3:5], 16)]) if k == 6 else t.replace(SPACE, " ").encode() for t, _, k in pieces]
        self.out_len = np.array([len(r) for r in raw])
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(raw), np.uint8)
        # Characters that are in pieces without being one get a number beyond the vocabulary.
        loose = sorted({c for t in ids for c in t} - ids.keys())
        known = ids | {c: self.size + i for i, c in enumerate(loose)}
        self.total = self.size + len(loose)
        order = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in ids.values()}, reverse=True))}
        rank = {t: order[pieces[i][1]] for t, i in ids.items()}
        self.worst = len(order)
        self.ranks = rank
        pairs = {}
        for t in ids:
            for k in range(1, len(t)):
                a, b = known.get(t[:k]), known.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * self.total + b] = rank[t]
        keys = np.array(sorted(pairs), np.int64)
        self.pair_key, self.pair_rank = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        # Merge trees: the last merge of each piece, then the chains of last and first parts.
        split = {}
        usable = []
        for t in sorted(ids, key=len):
            if len(t) == 1:
                usable.append(t)
                continue
            parts, tree = self.merge(t)
            if len(parts) == 1:
                usable.append(t)
                split[t] = tree[t]
        self.usable = usable
        chains_r, chains_l = {}, {}
        for t in sorted(known, key=len):
            chains_r[t] = [t] if t not in split else [*chains_r[split[t][1]], t]
            chains_l[t] = [t] if t not in split else [*chains_l[split[t][0]], t]
        deep = max(map(len, [*chains_r.values(), *chains_l.values()]))
        self.right = np.full((self.total, deep), -1, np.int32)
        self.left = np.full((self.total, deep), -1, np.int32)
        self.right_rank = np.full((self.total, deep + 1), self.worst, np.int32)
        self.left_rank = np.full((self.total, deep + 1), self.worst, np.int32)
        for t, i in known.items():
            for chain, ids_, ranks_ in ((chains_r[t], self.right, self.right_rank), (chains_l[t], self.left, self.left_rank)):
                for k, part in enumerate(chain):
                    ids_[i, k] = known[part]
                    if k:
                        ranks_[i, k] = rank[part]
        self.ids = ids
        self.single = {t: i for t, i in known.items() if len(t) == 1}
        self.longest = max(map(len, usable))

    def merge(self, word: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """Merges best rank first, leftmost first; the parts, and what each merge joined."""
        part = list(word)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        tree: dict[str, tuple[str, str]] = {}
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part) and (r := self.ranks.get(part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[after[i]]))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            tree[a + b] = (a, b)
            part[i], part[j] = a + b, ""
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p], tree


class Encoder:
    """Encodes batches of texts; keeps the pieces of segments it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        n = 1 << SEAM_BITS
        self.seam_key, self.seam_ok = np.full(n, -1, np.int64), np.zeros(n, bool)
        points = np.array([ord(c) for c in v.single], np.int64)
        self.char_id = np.full(0x110000, -1, np.int32)
        self.char_id[points] = list(v.single.values())
        long = [t for t in v.usable if len(t) > 1]
        self.long_len = np.array([len(t) for t in long], np.int64)
        self.long_id = np.array([v.ids[t] for t in long], np.int32)
        self.long_points = np.zeros((len(long), v.longest), np.int64)
        for i, t in enumerate(long):
            self.long_points[i, : len(t)] = [ord(c) for c in t]
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def seams(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May piece b follow piece a? -1, a character without a piece, may stand anywhere."""
        ok = np.ones(a.size, bool)
        on = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[on].astype(np.int64) * self.v.total + b[on]
        slot = ((key * 0x9E3779B1) >> 7) & ((1 << SEAM_BITS) - 1)
        hit = self.seam_key[slot] == key
        ok[on[hit]] = self.seam_ok[slot[hit]]
        miss = np.flatnonzero(~hit)
        if miss.size:
            fresh, back = np.unique(key[miss], return_inverse=True)
            got = self._seam(fresh // self.v.total, fresh % self.v.total)
            ok[on[miss]] = got[back]
            slot = ((fresh * 0x9E3779B1) >> 7) & ((1 << SEAM_BITS) - 1)
            self.seam_key[slot] = fresh
            self.seam_ok[slot] = got[np.searchsorted(fresh, self.seam_key[slot])]
        return ok

    def _seam(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        v = self.v
        ok = np.ones(a.size, bool)
        on = np.arange(a.size)
        i, j = np.zeros(a.size, np.int64), np.zeros(a.size, np.int64)
        while on.size:
            key = v.right[a[on], i].astype(np.int64) * v.total + v.left[b[on], j]
            k = np.minimum(np.searchsorted(v.pair_key, key), v.pair_key.size - 1)
            across = np.where(v.pair_key[k] == key, v.pair_rank[k], v.worst)
            up_a, up_b = v.right_rank[a[on], i + 1], v.left_rank[b[on], j + 1]
            # The leftmost of equal ranks goes first: a's own merge, then the one across, then b's.
            bad = (across < up_a) & (across <= up_b) & (across < v.worst)
            ok[on[bad]] = False
            first = up_a <= up_b
            i, j = np.where(first, i + 1, i), np.where(first, j, j + 1)
            go = ~bad & ((up_a < v.worst) | (up_b < v.worst))
            on, i, j = on[go], i[go], j[go]
        return ok

    def _lattice(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges (start, length, piece) of all vocabulary pieces in the text (code points, 0 between segments)."""
        seen = np.zeros(0x110000, bool)
        seen[text] = True
        seen[0] = False
        code_of = np.cumsum(seen)
        code_of[~seen] = 0
        bits = max(1, int(code_of.max() + 1).bit_length())
        width = max(1, 62 // bits)
        n = text.size
        codes = np.zeros(n + 4 * max(width, self.v.longest), np.int64)
        codes[:n] = code_of[text]
        m = codes.size - width
        key = np.zeros(m, np.int64)
        for k in range(width):
            key = (key << bits) | codes[k : k + m]
        # The suffix array, as deep as the longest piece: doubled from the packed keys.
        order = np.argsort(key[:n], kind="stable")
        depth = width
        rank = np.zeros(m, np.int64)
        by = key[:n]
        while depth < self.v.longest:
            new = np.ones(n, np.int64)
            new[1:] = by[order][1:] != by[order][:-1]
            rank[:] = 0
            rank[order] = np.cumsum(new)
            by = rank[:n] * (n + 1) + np.where(np.arange(n) + depth < n, rank[np.minimum(np.arange(n) + depth, n)], 0)
            order = np.argsort(by, kind="stable")
            depth *= 2
        # Binary search of every piece whose characters occur.
        there = (seen[self.long_points] | (self.long_points == 0)).all(axis=1)
        points, length, piece = self.long_points[there], self.long_len[there], self.long_id[there]
        words = -(-self.v.longest // width)
        pad = np.zeros((points.shape[0], words * width), np.int64)
        pad[:, : points.shape[1]] = code_of[points]
        beyond = np.arange(pad.shape[1]) >= length[:, None]

        def packed(p: np.ndarray) -> list[np.ndarray]:
            out = []
            for w in range(words):
                k = np.zeros(p.shape[0], np.int64)
                for c in range(width):
                    k = (k << bits) | p[:, w * width + c]
                out.append(k)
            return out

        def bound(want: list[np.ndarray]) -> np.ndarray:
            """The number of suffixes below `want`."""
            lo, hi = np.zeros(piece.size, np.int64), np.full(piece.size, n, np.int64)
            while True:
                on = np.flatnonzero(lo < hi)
                if not on.size:
                    return lo
                mid = (lo[on] + hi[on]) // 2
                at = order[mid]
                less, same = np.zeros(on.size, bool), np.ones(on.size, bool)
                for w in range(words):
                    k = key[np.minimum(at + w * width, m - 1)]
                    less |= same & (k < want[w][on])
                    same &= k == want[w][on]
                lo[on] = np.where(less, mid + 1, lo[on])
                hi[on] = np.where(less, hi[on], mid)

        first = bound(packed(pad))
        last = bound(packed(np.where(beyond, (1 << bits) - 1, pad)))
        size = last - first
        where = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        chars = np.flatnonzero(text)
        start = np.concatenate([order[where], chars])
        span = np.concatenate([np.repeat(length, size), np.ones(chars.size, np.int64)])
        ids = np.concatenate([np.repeat(piece, size), self.char_id[text[chars]]])
        return start, span, ids

    def _relax(self, text: np.ndarray) -> np.ndarray:
        """Piece that starts at each position of the text; -1: a character without one, -2: none starts."""
        start, span, ids = self._lattice(text)
        n = text.size
        # The lattice falls apart where no edge crosses.
        long = span > 1
        cover = np.bincount(start[long] + 1, minlength=n + 2) - np.bincount(start[long] + span[long], minlength=n + 2)
        free = np.cumsum(cover)[: n + 1] == 0
        free[0] = True
        base = np.maximum.accumulate(np.where(free, np.arange(n + 1), 0))
        end = start + span
        left = base[start]
        near = end - left
        order = np.argsort((near * (n + 1) + end) * 64 - span, kind="stable")
        start, end, ids, left = start[order], end[order], ids[order], left[order]
        steps = np.concatenate([[0], np.cumsum(np.bincount(near))])
        tail = np.full(n + 1, -2, np.int32)
        back = np.full(n + 1, -1, np.int64)
        for p in range(1, steps.size - 1):
            lo, hi = steps[p], steps[p + 1]
            if lo == hi:
                continue
            e = end[lo:hi]
            heads = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            stop = np.concatenate([heads[1:], [hi - lo]]) + lo
            at = heads + lo
            while at.size:
                s = start[at]
                ok = s == left[at]
                rest = np.flatnonzero(~ok)
                ok[rest] = self.seams(tail[s[rest]], ids[at[rest]])
                done = at[ok]
                tail[end[done]], back[end[done]] = ids[done], start[done]
                go = ~ok & (at + 1 < stop)
                at, stop = at[go] + 1, stop[go]
        out = np.full(n + 1, -2, np.int32)
        at = np.flatnonzero(free[1:] & (text != 0)) + 1
        while at.size:
            frm = back[at]
            out[frm] = tail[at]
            at = frm[~free[frm]]
        return out[:n]

    def learn(self, segments: list[str]) -> None:
        """Encode new distinct segments, in the order of their numbers."""
        k = 0
        while k < len(segments):
            size, to = 0, k
            while to < len(segments) and (to == k or size < INDEX_CHARS):
                size += len(segments[to]) + 1
                to += 1
            text = "\0".join(s.replace("\0", "\U0010ffff") for s in segments[k:to]) + "\0"
            points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
            piece = self._relax(points)
            at = np.flatnonzero(piece > -2)
            ids, ones = piece[at], np.ones(at.size, np.int64)
            loose = np.flatnonzero((ids == -1) | (ids >= self.v.size))
            spelled = [chr(points[at[i]]).replace("\U0010ffff", "\0").encode() for i in loose]
            ones[loose] = [len(s) for s in spelled]
            flat = np.repeat(ids, ones)
            if spelled:
                spot = np.cumsum(ones) - ones
                into = np.concatenate([np.arange(spot[i], spot[i] + len(s)) for i, s in zip(loose, spelled)])
                flat[into] = self.v.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
            owner = np.repeat(np.cumsum(points == 0)[at], ones)
            count = np.bincount(owner, minlength=to - k)
            self.at = np.concatenate([self.at, self.flat.size + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, flat])
            k = to

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        if len(self.number) > KEPT:
            self.reset()
        number, new, words, sizes = self.number, [], [], []
        for t in texts:
            found = SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else []
            sizes.append(len(found))
            for w in found:
                if w not in number:
                    number[w] = len(number)
                    new.append(w)
            words += [number[w] for w in found]
        if new:
            self.learn(new)
        w = np.array(words, np.int64)
        count = self.count[w]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.at[w] - ends[:-1], count) + np.arange(ends[-1])]
        upto = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return ids, np.diff(upto)


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids: pieces and fallback bytes joined, spaces restored, the added first one removed."""
    size = v.out_len[ids]
    at = np.repeat(v.out_at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out = v.out[at].tobytes().decode("utf-8", "replace")
    return out[1:] if out[:1] == " " else out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(key: int, vocabulary: Vocabulary) -> Encoder:
    """One encoder for each worker process."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _blocks(column: pa.Array) -> Iterator[tuple[slice, list[str]]]:
    """Consecutive rows with about BATCH_CHARS of text."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    k, before = 0, 0
    while k < len(column):
        to = max(k + 1, int(np.searchsorted(ends, before + BATCH_CHARS, "right")))
        yield slice(k, to), column.slice(k, to - k).to_pylist()
        k, before = to, int(ends[to - 1])


def encode_table(df: DataFrame, text_col: str = "text", model: str | None = None, out: str = "ids") -> DataFrame:
    """`df` with its text column replaced by `out`, the piece ids of the whole text, and `decoded_ok`.

    decoded_ok says whether decoding gives the text back. The marker of spaces itself, U+2581,
    reads back as a space. Columns named like a result give way to it.
    """
    spark = df.sparkSession
    with open(model or default_model(), "rb") as f:
        data = f.read()
    vocabulary = spark.sparkContext.broadcast(Vocabulary(data))
    key = hash(data)
    rest = [c for c in df.columns if c not in (text_col, out, "decoded_ok")]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    fields = [source.schema[c] for c in rest]
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType(), False)), T.StructField("decoded_ok", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, vocabulary.value)
        for batch in batches:
            for part, mine in _blocks(batch.column(len(rest))):
                ids, counts = encoder.encode(mine)
                ends = np.concatenate([[0], np.cumsum(counts)])
                same = [decode(encoder.v, ids[ends[i] : ends[i + 1]]) == t for i, t in enumerate(mine)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(i).slice(part.start, part.stop - part.start) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(same, pa.bool_())], [*rest, out, "decoded_ok"])

    return source.mapInArrow(run, schema)
