"""Identity geometry: a small projection trained with supervised contrast, its gate, and an int8 copy.

Training runs on the driver over a bounded sample (MOST_ROWS); projection runs in Arrow batches over all rows.
"""

from __future__ import annotations

import io
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, unit
from . import calibration
from .lineage import cut
from .retrieval import pairwise

MOST_ROWS = 20_000


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """GELU (tanh form) and its derivative."""
    c = np.sqrt(2 / np.pi)
    t = np.tanh(c * (x + 0.044715 * x**3))
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t**2) * c * (1 + 3 * 0.044715 * x**2)


@dataclass
class IdentityEncoder:
    """L1: normalise(bridge(x) + two-layer MLP(x)); the MLP's last layer starts at zero."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, dim: int, hidden: int = 512, out: int = 256, seed: int = 0) -> "IdentityEncoder":
        rng = np.random.default_rng(seed)
        return cls({
            "bridge": rng.uniform(-1, 1, (dim, out)) / np.sqrt(dim),
            "w1": rng.uniform(-1, 1, (dim, hidden)) / np.sqrt(dim), "b1": np.zeros(hidden),
            "w2": np.zeros((hidden, out)), "b2": np.zeros(out),
        })

    def forward(self, x: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Unit vectors, and what `backward` needs. keep: dropout mask of the hidden layer, scaled."""
        w = self.weights
        pre = x @ w["w1"] + w["b1"]
        act, slope = gelu(pre)
        if keep is not None:
            act, slope = act * keep, slope * keep
        y = x @ w["bridge"] + act @ w["w2"] + w["b2"]
        size = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        return y / size, (x, act, slope, y / size, size)

    def backward(self, memo: tuple, dz: np.ndarray) -> dict[str, np.ndarray]:
        x, act, slope, z, size = memo
        dy = (dz - z * (dz * z).sum(axis=1, keepdims=True)) / size
        da = dy @ self.weights["w2"].T * slope
        return {"bridge": x.T @ dy, "w2": act.T @ dy, "b2": dy.sum(axis=0), "w1": x.T @ da, "b1": da.sum(axis=0)}

    def dump(self) -> bytes:
        """K5."""
        out = io.BytesIO()
        np.savez(out, **self.weights)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes | None) -> "IdentityEncoder | None":
        """K5: None where nothing has been saved: vectors stay as they are."""
        return None if data is None else cls(dict(np.load(io.BytesIO(data))))


def supcon(z: np.ndarray, groups: np.ndarray, temperature: float = 0.1) -> tuple[float, np.ndarray]:
    """L2: supervised contrastive loss of unit rows and its gradient; rows without a partner are skipped."""
    n = len(z)
    sim = z @ z.T / temperature
    np.fill_diagonal(sim, -np.inf)
    sim -= sim.max(axis=1, keepdims=True)
    e = np.exp(sim)
    p = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-12)
    same = (groups[:, None] == groups) & ~np.eye(n, dtype=bool)
    count = same.sum(axis=1)
    on = count > 0
    if not on.any():
        return 0.0, np.zeros_like(z)
    logp = np.where(same, sim - np.log(np.maximum(e.sum(axis=1, keepdims=True), 1e-12)), 0.0)
    loss = -(logp.sum(axis=1)[on] / count[on]).mean()
    g = np.where(on[:, None], p - same / np.maximum(count, 1)[:, None], 0.0) / on.sum() / temperature
    return float(loss), (g + g.T) @ z


def supcon_loss(rows: DataFrame, temperature: float = 0.1) -> DataFrame:
    """L2 over a whole table: (loss), one row, from rows(id, v, gid) with unit vectors.

    Denominators come from blocks of similarities, the sums over partners from the sum of each group's vectors.
    """

    def reduce(ids: np.ndarray, sims: np.ndarray, cols: np.ndarray) -> pd.DataFrame:
        # Unit vectors: no similarity is greater than 1.
        s = np.where(ids[:, None] == cols, -np.inf, (sims - 1) / temperature)
        return pd.DataFrame({"id": ids, "t": np.exp(s).sum(axis=1)})

    parts = pairwise(rows.select("id", "v"), None, reduce, "id long, t double")
    below = parts.groupBy("id").agg((F.log(F.sum("t")) + F.lit(1 / temperature)).alias("below"))
    at = rows.select("gid", F.posexplode("v").alias("pos", "x")).groupBy("gid", "pos").agg(F.sum("x").alias("x"))
    sums = at.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("total"))
    sums = sums.join(rows.groupBy("gid").agg((F.count(F.lit(1)) - 1).alias("partners")), "gid").where("partners > 0")
    near = (dot(F.col("v"), F.col("total")) - dot(F.col("v"), F.col("v"))) / F.lit(temperature) / F.col("partners")
    each = rows.join(sums, "gid").join(below, "id").select((F.col("below") - near).alias("loss"))
    return each.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


def whole_auc(rows: DataFrame, net: "IdentityEncoder | Int8Encoder | None") -> float:
    """G13 over all pairs of a table's rows(id, v, gid), projected; without a net over the unit vectors."""
    z = project(rows, net) if net is not None else rows.select("id", unit(F.col("v")).alias("v"))
    labelled = cut(z.join(rows.select("id", F.col("gid").alias("label")), "id"))
    return calibration.label_auc(labelled).first()["auc"]


def auc(z: np.ndarray, groups: np.ndarray) -> float:
    """G13 over all pairs of the rows."""
    i, j = np.triu_indices(len(z), 1)
    sims, same = (z @ z.T)[i, j], groups[i] == groups[j]
    p, q = int(same.sum()), int((~same).sum())
    if not p or not q:
        return float("nan")
    rank = np.empty(sims.size)
    rank[np.argsort(sims, kind="stable")] = np.arange(1, sims.size + 1)
    return float((rank[same].sum() - p * (p + 1) / 2) / (p * q))


@dataclass
class TrainReport:
    """A14."""

    baseline_auc: float
    learned_auc: float
    epochs: int
    final_loss: float
    n_train: int
    n_test: int
    n_groups: int

    @property
    def improved(self) -> bool:
        return self.learned_auc > self.baseline_auc

    def row(self) -> dict:
        return self.__dict__ | {"improved": self.improved}


def sample(rows: DataFrame, most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, groups, test) of at most `most` rows(id, v, gid, test), by hash of the id."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("v", "gid", "test").collect()
    return np.array([r[0] for r in got], float), np.array([r[1] for r in got]), np.array([r[2] for r in got], bool)


def train(x: np.ndarray, groups: np.ndarray, test: np.ndarray, epochs: int = 60, lr: float = 1e-3, batch: int = 256, decay: float = 1e-4, out: int = 256, hidden: int = 512, dropout: float = 0.1, seed: int = 0) -> tuple[IdentityEncoder, TrainReport]:
    """L4: AdamW on the training part; the report says whether the held-out AUC beats that of the raw vectors."""
    rng = np.random.default_rng(seed)
    net = IdentityEncoder.new(x.shape[1], hidden, out, seed)
    a, g = x[~test], groups[~test]
    m = {k: np.zeros_like(w) for k, w in net.weights.items()}
    v = {k: np.zeros_like(w) for k, w in net.weights.items()}
    step, loss = 0, float("nan")
    for _ in range(epochs):
        losses = []
        order = rng.permutation(len(a))
        for s in range(0, len(a), batch):
            at = order[s : s + batch]
            keep = (rng.random((at.size, hidden)) >= dropout) / (1 - dropout)
            z, memo = net.forward(a[at], keep)
            value, dz = supcon(z, g[at])
            losses.append(value)
            step += 1
            for k, grad in net.backward(memo, dz).items():
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                net.weights[k] -= lr * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * net.weights[k])
        loss = float(np.mean(losses)) if losses else loss
    raw = x[test] / (np.linalg.norm(x[test], axis=1, keepdims=True) + 1e-9)
    learned = auc(net.forward(x[test])[0], groups[test])
    return net, TrainReport(auc(raw, groups[test]), learned, epochs, loss, int((~test).sum()), int(test.sum()), len(set(groups.tolist())))


def project(vectors: DataFrame, net: "IdentityEncoder | Int8Encoder | None") -> DataFrame:
    """(id, v) projected in Arrow batches; without a net the vectors stay."""
    if net is None:
        return vectors.select("id", "v")
    shared = vectors.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(1)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            z, _ = shared.value.forward(x)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["id", "v"])

    return vectors.select("id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, v array<double>")


@dataclass
class Int8Encoder:
    """Linear layers as int8 with one scale each; inputs are quantised as they come."""

    q: dict[str, tuple[np.ndarray, float]]
    bias: dict[str, np.ndarray]

    @classmethod
    def of(cls, net: IdentityEncoder) -> "Int8Encoder":
        q = {}
        for k in ("bridge", "w1", "w2"):
            w = net.weights[k]
            scale = float(np.abs(w).max()) / 127 or 1.0
            q[k] = (np.round(w / scale).astype(np.int8), scale)
        return cls(q, {k: net.weights[k] for k in ("b1", "b2")})

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        w, scale = self.q[name]
        own = float(np.abs(x).max()) / 127 or 1.0
        return np.round(x / own).astype(np.int8).astype(np.int32) @ w.astype(np.int32) * (own * scale)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, None]:
        act, _ = gelu(self._linear(x, "w1") + self.bias["b1"])
        y = self._linear(x, "bridge") + self._linear(act, "w2") + self.bias["b2"]
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12), None


def quant_report(net: IdentityEncoder, small: Int8Encoder, x: np.ndarray, groups: np.ndarray) -> dict:
    """Sizes, times and AUCs; fidelity holds within .02."""

    def timed(n) -> float:
        t = time.perf_counter()
        for _ in range(5):
            n.forward(x)
        return (time.perf_counter() - t) / 5 * 1000

    size32 = sum(w.astype(np.float32).nbytes for w in net.weights.values())
    size8 = sum(w.nbytes + 8 for w, _ in small.q.values()) + sum(b.astype(np.float32).nbytes for b in small.bias.values())
    full, quick = auc(net.forward(x)[0], groups), auc(small.forward(x)[0], groups)
    ms32, ms8 = timed(net), timed(small)
    return {
        "fp32_bytes": size32, "int8_bytes": size8, "size_ratio": size32 / max(1, size8), "fp32_ms": ms32, "int8_ms": ms8, "speedup": ms32 / max(ms8, 1e-9),
        "fp32_auc": full, "int8_auc": quick, "fidelity_held": quick >= full - 0.02,
    }


def report_json(report: dict) -> str:
    """rounded for people."""
    return json.dumps({k: round(v, 4) if isinstance(v, float) else v for k, v in report.items()})
