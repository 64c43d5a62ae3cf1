"""Generate, critique, repair: the driver loop over an engine interface, and consolidation of what it makes.

The only engine here is a deterministic stub; a hosted one implements `Engine.complete`. Decisions are
taken fail-closed: what a judge leaves out counts as failed.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import pass_summary, salience
from ..functions.text import infer_title, text_key, trim_u
from ..operators.verdicts import read_object
from . import prompts
from .engines import CallingEngine, HandOffEngine


class Engine(Protocol):
    def complete(self, system: str, prompt: str) -> str: ...


@dataclass(frozen=True)
class LoopConfig:
    """A17."""

    max_iter: int = 4
    k: int = 3
    abstain_floor: float = 0.45
    sure_bar: float = 0.78
    sensitive_threshold: float = 0.55
    engine: str = "stub"


def env_value(name: str, default, kind=str):
    """an unset, empty or unreadable variable gives the default."""
    raw = os.environ.get(name, "").strip()
    try:
        return kind(raw) if raw else default
    except ValueError:
        return default


def load_config(prefix: str = "TRACEWRIGHT_") -> LoopConfig:
    """O10."""
    base = LoopConfig()
    return LoopConfig(**{k: env_value(prefix + k.upper(), v, type(v)) for k, v in base.__dict__.items()})


class StubEngine:
    """Template drafts and a rule-based judge: a draft fails an item while it holds the item's key in brackets."""

    def complete(self, system: str, prompt: str) -> str:
        if system == "generate":
            return f"Draft about {prompt.splitlines()[0]} [em_dash] [list]"
        keys, draft = prompts.parts(prompt)
        if system == "critique":
            items = [{"key": k, "pass": f"[{k}]" not in draft, "note": ""} for k in keys.split(",")]
            bad = [i["key"] for i in items if not i["pass"]]
            return json.dumps({"items": items, "smells": not bad, "weakest": bad[0] if bad else ""})
        return draft.replace(f"[{keys}]", "").strip()


def build_engine(config: LoopConfig, send: Callable[[str, str], str] | None = None, folder: str | None = None) -> Engine:
    """The stub, an engine that calls `send` with back-off, or a hand-off by files in `folder`."""
    if config.engine == "stub":
        return StubEngine()
    if config.engine == "call" and send is not None:
        return CallingEngine(send)
    if config.engine == "handoff" and folder is not None:
        return HandOffEngine(folder)
    raise ValueError(f"no engine named {config.engine!r}")


def critique(engine: Engine, draft: str, rubric: list[dict], examples: str = "") -> dict:
    """Judged items in rubric order; an unreadable answer is asked for once more as JSON, then everything fails."""
    raw = engine.complete("critique", prompts.judging(draft, rubric, examples))
    got = read_object(raw)
    if got is None:
        got = read_object(engine.complete("critique", prompts.reading_again(raw or "", rubric)))
    said = json.loads(got) if got else {}
    listed = said.get("items") if isinstance(said.get("items"), list) else []
    by_key = {i["key"]: i for i in listed if isinstance(i, dict) and isinstance(i.get("key"), str)}
    items = []
    for r in rubric:
        own = by_key.get(r["key"], {"note": "not judged (fail-closed)"})
        items.append({"key": r["key"], "pass": own.get("pass") is True, "weight": r["weight"], "note": str(own.get("note") or "").strip()})
    clean = all(i["pass"] for i in items)
    smells = said.get("smells")
    return {"items": items, "smells": smells if isinstance(smells, bool) else clean, "weakest": str(said.get("weakest") or ""), "clean": clean}


@dataclass
class Run:
    """O1 result."""

    cue: str
    rounds: list[dict] = field(default_factory=list)
    final: str = ""
    accepted: bool = False
    best_fail: float = float("inf")


def run_loop(cue: str, engine: Engine, rubric: list[dict], config: LoopConfig = LoopConfig(), context: str = "", draft: str | None = None, examples: str = "") -> Run:
    """Up to max_iter rounds; the draft with the least weighted fail stays, the earliest of equals; clean ends it."""
    out = Run(cue)
    text = engine.complete("generate", prompts.writing(cue, rubric, examples, context)) if draft is None else draft
    for n in range(1, config.max_iter + 1):
        verdict = critique(engine, text, rubric, examples)
        fail = sum(i["weight"] for i in verdict["items"] if not i["pass"])
        out.rounds.append({"round": n, "draft": text, "weighted_fail": fail, "n_fail": sum(not i["pass"] for i in verdict["items"]), "smells": verdict["smells"], "weakest": verdict["weakest"], "items": verdict["items"]})
        if fail < out.best_fail:
            out.best_fail, out.final = fail, text
        if verdict["clean"]:
            break
        if n < config.max_iter:
            text = engine.complete("repair", prompts.repairing(text, [i for i in verdict["items"] if not i["pass"]], rubric, examples))
    out.accepted = out.best_fail == 0
    return out


ROUNDS = "run_id long, round int, draft string, weighted_fail double, n_fail int, score double, smells boolean, weakest string, items array<struct<key:string,pass:boolean,note:string>>"


def rounds_of(cues: DataFrame, engine: Engine, rubric: list[dict], config: LoopConfig = LoopConfig()) -> DataFrame:
    """O1 for a table of cues(run_id, cue): every round of every run, with its judged items (ROUNDS). A cue is done in one task; null cues count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, cue in zip(batch["run_id"], batch["cue"]):
                for x in run_loop(cue or "", engine, rubric, config).rounds:
                    passed = sum(i["pass"] for i in x["items"]) / max(1, len(x["items"]))
                    rows.append((own, x["round"], x["draft"], float(x["weighted_fail"]), x["n_fail"], passed, x["smells"], x["weakest"], [{k: i[k] for k in ("key", "pass", "note")} for i in x["items"]]))
            yield pd.DataFrame(rows, columns=["run_id", "round", "draft", "weighted_fail", "n_fail", "score", "smells", "weakest", "items"])

    return cues.select(F.col("run_id").cast("long").alias("run_id"), "cue").mapInPandas(run, ROUNDS)


def rounds_frame(spark: SparkSession, runs: list[Run]) -> DataFrame:
    rows = [(k, r.cue, x["round"], x["draft"], float(x["weighted_fail"]), x["n_fail"], x["smells"], x["weakest"]) for k, r in enumerate(runs) for x in r.rounds]
    return spark.createDataFrame(rows, "run_id int, cue string, round int, draft string, weighted_fail double, n_fail int, smells boolean, weakest string")


def context_block(hits: DataFrame, by: str = "cue_id") -> DataFrame:
    """Hits that may be quoted, as one text block for each cue in rank order; null flags are not quoted."""
    safe = hits.where(~F.coalesce("sensitive", F.lit(True)))
    why = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n[why: "), F.col("note"), F.lit("]"))).otherwise("")
    block = F.concat(F.lit("--- sample ---"), why, F.lit("\n"), F.col("body"))
    return safe.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda r: r["b"]), "\n\n").alias("context"))


def reflected(episodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """records from episodes(text, cue, passed, items, smells, weakest, human_approved), with the columns to keep."""
    ok = F.coalesce("human_approved", F.lit(False))
    scored = F.coalesce("items", F.lit(0)) > 0
    summary = pass_summary(F.col("passed"), F.col("items"))
    note = (
        F.when(ok, "approved by a person; consolidated into semantic gold")
        .when(scored, trim_u(F.concat(F.lit("auto-consolidated, law "), summary, F.lit(". weakest: "), F.coalesce("weakest", F.lit("")))))
        .otherwise("auto-consolidated (no law verdict attached)")
    )
    return episodes.select(
        *keep, infer_title(F.col("text")).alias("title"), trim_u(F.col("text")).alias("body"),
        salience(F.col("text"), F.col("passed"), F.col("items"), F.col("smells"), F.col("human_approved")).alias("salience"), note.alias("note"),
        F.substring(trim_u(F.col("cue")), 1, 400).alias("cue"), summary.alias("law_pass"), ok.alias("human_approved"),
    )


def destination(least: float = 8.0) -> Column:
    """Gold needs a person; candidates need salience; everything else is only logged."""
    return F.when(F.coalesce("human_approved", F.lit(False)), "gold").when(F.coalesce("salience", F.lit(0.0)) >= least, "candidate").otherwise("logged")


def consolidated(records: DataFrame, held: DataFrame | None = None, least: float = 8.0) -> DataFrame:
    """Records with `store` and `fresh`: false for bodies that the store holds or that came before in the batch.

    held: (store, body) of what is stored. Bodies are compared stripped, by hash; one of each counts, by (id).
    """
    rows = records.withColumn("store", destination(least)).withColumn("body_key", text_key(trim_u(F.col("body"))))
    first = rows.groupBy("store", "body_key").agg(F.min("id").alias("first_id"))
    if held is not None:
        there = held.select("store", text_key(trim_u(F.col("body"))).alias("body_key")).distinct()
        first = first.join(there, ["store", "body_key"], "left_anti")
    out = rows.join(first, ["store", "body_key"], "left")
    return out.withColumn("fresh", (F.col("store") != "logged") & F.coalesce(F.col("first_id") == F.col("id"), F.lit(False))).drop("first_id", "body_key")


__all__ = ["Engine", "LoopConfig", "StubEngine", "build_engine", "consolidated", "context_block", "critique", "load_config", "reflected", "run_loop"]
