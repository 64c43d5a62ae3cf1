"""O1, O2: the whole run for a table of cues: recall, route, generate with critique and repair, assess, screen, record.

All steps are DataFrame operators over all cues at once; the engine is called in `mapInPandas`, each cue in one task, and
what it wrote is cut from its lineage before anything reads it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import assess, confidence_line, route, trace_sensitive
from ..operators.boundary import ANCHORS, Encoder, screen_or_hold
from ..operators.encode import hash_encoder
from ..operators.index import Index
from ..operators.lineage import cut
from .loop import Engine, LoopConfig, context_block, run_loop

WRITTEN = "cue_id long, final_raw string, weighted_fail double, n_fail int, smells boolean, weakest_item string, iterations int, clean boolean"
#: Salience counts more where traces are recalled as context.
CONTEXT_SALIENCE = 0.15


def recall_context(cues: DataFrame, pool: Callable[[], Index] | Index | None, k: int = 3, log: Callable[[str], None] = print) -> DataFrame | None:
    """O2: traces near each cue from the pool of all channels; a pool that can't be built or recalled from gives none, and the run goes on."""
    if pool is None:
        return None
    try:
        return cut((pool if isinstance(pool, Index) else pool()).recall(cues, k, CONTEXT_SALIENCE))
    except Exception as e:  # context is optional
        log(f"no context: {e}")
        return None


def _summary(hits: DataFrame, prefix: str) -> DataFrame:
    """One row a cue: titles in rank order, greatest weight and score, the first one's channel, and the text that may be quoted."""
    for name, kind in (("title", "string"), ("note", "string"), ("channel", "string"), ("sensitive", "boolean")):
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind))
    hits = hits.withColumn("sensitive", trace_sensitive(F.col("sensitive"), F.col("channel"), F.col("body")))
    titles = F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda t: t["title"])
    one = hits.groupBy("cue_id").agg(
        titles.alias(f"{prefix}_used"), F.max("w").alias(f"{prefix}_weight"), F.max("score").alias(f"{prefix}_score"), F.min_by("channel", "pos").alias(f"{prefix}_channel")
    )
    return one.join(context_block(hits).withColumnRenamed("context", f"{prefix}_block"), "cue_id", "left")


def _write(rows: DataFrame, engine: Engine, rubric: list[dict], config: LoopConfig) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                got = run_loop(r.cue, engine, rubric, replace(config, max_iter=int(r.max_iter)), r.context or "", examples=r.examples or "")
                best = next((x for x in got.rounds if x["weighted_fail"] == got.best_fail), None)
                n_fail = best["n_fail"] if best else len(rubric)
                out.append((r.cue_id, got.final, float(got.best_fail), n_fail, bool(best and best["smells"]), best["weakest"] if best else "", len(got.rounds), n_fail == 0))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WRITTEN.split(", ")])

    return rows.select("cue_id", "cue", "max_iter", F.col("gold_block").alias("examples"), F.col("context_block").alias("context")).mapInPandas(run, WRITTEN)


def answer(
    cues: DataFrame, gold: Index, engine: Engine, rubric: list[dict], config: LoopConfig = LoopConfig(), pool: Callable[[], Index] | Index | None = None,
    anchors: Sequence[str] | DataFrame | None = ANCHORS, encoder: Encoder = hash_encoder,
) -> DataFrame:
    """cues(cue_id, cue), with unique ids, to one row each: what was recalled, the released text and the raw one, fails, path, confidence and
    whether the screen held it. A held text is released masked and isn't accepted; texts are screened by structure and by their likeness, under
    the encoder, to the anchors (texts, or their vectors), and all are held where the screen fails. Null cues count as empty; an engine's error
    fails the run. Engines are called once a cue, again where an executor was lost.
    """
    cues = cut(cues.select(F.col("cue_id").cast("long").alias("cue_id"), F.coalesce("cue", F.lit("")).alias("cue")))
    rows = cues.join(_summary(gold.recall(cues, config.k), "gold"), "cue_id", "left")
    near = recall_context(cues, pool, config.k)
    if near is not None:
        rows = rows.join(_summary(near, "context"), "cue_id", "left")
    else:
        for name, kind in (("used", "array<string>"), ("weight", "double"), ("score", "double"), ("channel", "string"), ("block", "string")):
            rows = rows.withColumn(f"context_{name}", F.lit(None).cast(kind))
    way = route(F.coalesce("context_channel", F.lit("")), F.col("gold_weight"), F.col("context_score"), config.max_iter, config.k)
    rows = rows.withColumn("r", way).select("*", "r.path", "r.max_iter", F.col("r.abstain_floor").alias("floor"), F.col("r.sure_bar").alias("bar"))
    rows = cut(rows.drop("r"))
    rows = rows.join(cut(_write(rows, engine, rubric, config)), "cue_id")
    total = float(sum(i["weight"] for i in rubric))
    law = F.lit(1.0) - F.col("weighted_fail") / F.lit(total) if total else F.lit(0.0)
    sure = assess(law, F.col("n_fail") > 0, F.col("smells"), F.col("gold_weight"), F.col("context_score"), F.col("iterations"), F.col("max_iter"), F.col("floor"), F.col("bar"))
    held = screen_or_hold(rows.select(F.col("cue_id").alias("id"), F.col("final_raw").alias("text")), anchors, encoder=encoder).select(F.col("id").alias("cue_id"), "safe", "redacted")
    rows = rows.withColumn("a", sure).join(held, "cue_id")
    return rows.select(
        "cue_id", "cue", F.coalesce("gold_used", F.array().cast("array<string>")).alias("gold_used"), F.coalesce("context_used", F.array().cast("array<string>")).alias("context_used"),
        "path", F.when(F.col("safe"), F.col("final_raw")).otherwise(F.col("redacted")).alias("final"), "final_raw", "n_fail", "weighted_fail", "iterations",
        (F.col("clean") & F.col("safe")).alias("accepted"), F.col("a.score").alias("score"), F.col("a.verdict").alias("verdict"), F.col("a.weakest").alias("weakest"),
        (F.col("a.verdict") == "abstain").alias("abstained"), (~F.col("safe")).alias("boundary_held"),
        confidence_line(F.col("a.verdict"), F.col("a.score"), F.col("a.weakest")).alias("line"),
    )


def run_records(answers: DataFrame, config: LoopConfig, model: str = "") -> DataFrame:
    """K2: answers as records of the run log, with time, model and configuration. `registry.append_log` appends them."""
    settings = F.create_map(*[F.lit(str(x)) for pair in asdict(config).items() for x in pair])
    return answers.select(F.current_timestamp().alias("ts"), F.lit(model).alias("model"), settings.alias("config"), *answers.columns)


def archive_records(rounds: DataFrame, source: str = "", model: str = "") -> DataFrame:
    """K3: one record for each enforced draft of rounds(run_id, round, draft, weighted_fail, n_fail, smells, weakest), with its date,
    by which the archive is partitioned: `registry.append_log(records, path, ["date"])`. The id is drawn when the records are
    written, anew by every append: `uuid()` would take its seed when the plan is made."""
    each = F.struct("round", "draft", "weighted_fail", "n_fail", "smells", "weakest")
    got = rounds.groupBy("run_id").agg(F.array_sort(F.collect_list(each)).alias("iterations"), F.min_by("draft", "round").alias("initial_draft"), F.min_by(F.struct("draft", "n_fail"), F.struct("weighted_fail", "round")).alias("b"))
    now = F.current_timestamp()
    drawn = F.reflect(F.lit("java.util.UUID"), F.lit("randomUUID"))
    return got.select(
        F.concat(F.date_format(now, "yyyyMMdd'T'HHmmss'Z-'"), F.replace(drawn, F.lit("-"), F.lit(""))).alias("id"), F.to_date(now).cast("string").alias("date"),
        now.alias("created_at"), F.lit(model).alias("model"), F.lit(source).alias("law_source"), (F.col("b.n_fail") == 0).alias("clean"), F.size("iterations").alias("rounds"),
        "run_id", "initial_draft", F.col("b.draft").alias("final_draft"), "iterations",
    )
