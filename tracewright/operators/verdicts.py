"""Verdicts: reading a judge's JSON, holding it against the rubric fail-closed, weighing, choosing drafts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import as_bool


def first_object(text: str) -> str | None:
    """the first balanced JSON object in a text; braces inside strings don't count."""
    at = text.find("{")
    if at < 0:
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(text, at)
        return text[at:end]
    except ValueError:
        return None


def read_object(raw: str | None) -> str | None:
    """the object as JSON text: the whole text, what a fence holds, or the first balanced object."""
    import re

    raw = raw or ""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", raw, re.S)
    for text in (raw, fenced[1] if fenced else raw, first_object(raw) or ""):
        try:
            got = json.loads(text.strip())
        except ValueError:
            continue
        if isinstance(got, dict):
            return json.dumps(got, ensure_ascii=False)
    return None


def _entire(text: Column) -> Column:
    """The object that a text is, as a VARIANT; null if there is anything beside it. (An array around the text shows what follows its first value.)"""
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    one = F.when(F.size(values) == 1, F.element_at(values, 1))
    return F.when(F.schema_of_variant(one).startswith("OBJECT"), one)


def object_of(raw: Column) -> Column:
    """F9 as a VARIANT, without a Python worker: the object that the whole text is, or a fence holds, or that begins at the first brace. What is no JSON
    in the strict sense (NaN, names that repeat in one object) is not readable."""
    text = F.coalesce(raw, F.lit(""))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    at = F.locate("{", text)
    first = F.try_parse_json(F.when(at > 0, F.substr(text, at)))
    return F.coalesce(_entire(text), F.when(fenced != "", _entire(fenced)), F.when(F.schema_of_variant(first).startswith("OBJECT"), first))


def parsed(raw: DataFrame, holistic: str = "smells", weakest: str = "weakest") -> DataFrame:
    """(draft_id, readable, items array<struct<key, pass, note>>, smells, weakest) from (draft_id, raw)."""
    rows = raw.withColumn("o", object_of(F.col("raw")))
    said = lambda v, path: F.try_variant_get(v, path, "string")
    listed = F.transform(F.try_variant_get("o", "$.items", "array<variant>"), lambda i: F.struct(*[said(i, f"$.{c}").alias(c) for c in ("key", "pass", "note")]))
    return rows.select(
        "draft_id", F.col("o").isNotNull().alias("readable"), F.coalesce(listed, F.array().cast("array<struct<key:string,pass:string,note:string>>")).alias("items"),
        said(F.col("o"), f"$.{holistic}").alias("smells"), F.coalesce(F.trim(said(F.col("o"), f"$.{weakest}")), F.lit("")).alias("weakest"),
    )


def weak_parse(raw: Column) -> Column:
    """the object from the first to the last brace, fences removed, as a VARIANT; null if that is no JSON object."""
    return _entire(F.regexp_extract(F.regexp_replace(F.coalesce(raw, F.lit("")), r"```(?:json)?", ""), r"(?s)(\{.*\})", 1))


def coerced(verdicts: DataFrame, rubric: DataFrame) -> DataFrame:
    """One row for each draft and rubric item: (draft_id, key, ord, weight, pass, parsed, note).

    What the judge left out or can't be read fails; of repeated keys the last counts; unknown keys go.
    """
    said = verdicts.select("draft_id", F.posexplode("items").alias("n", "i")).select("draft_id", F.col("i.key").alias("key"), "n", "i")
    last = said.groupBy("draft_id", "key").agg(F.max_by("i", "n").alias("i"))
    every = verdicts.select("draft_id").crossJoin(F.broadcast(rubric.select("ord", "key", "weight")))
    rows = every.join(last, ["draft_id", "key"], "left")
    ok = as_bool(F.col("i.pass"))
    note = F.when(F.col("i").isNull(), "not judged (fail-closed)").when(ok.isNull(), "unreadable (fail-closed)").otherwise(F.trim(F.coalesce("i.note", F.lit(""))))
    return rows.select("draft_id", "key", "ord", "weight", F.coalesce(ok, F.lit(False)).alias("pass"), ok.isNotNull().alias("parsed"), note.alias("note"))


def judged(verdicts: DataFrame, rubric: DataFrame) -> DataFrame:
    """(draft_id, items, passed, n_fail, weighted_fail, pass_rate, clean, smells, weakest)."""
    rows = coerced(verdicts, rubric)
    got = rows.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if("pass").alias("passed"), F.count_if(~F.col("pass")).alias("n_fail"),
        F.sum(F.when(~F.col("pass"), F.col("weight")).otherwise(0.0)).alias("weighted_fail"),
        F.sum(F.when(F.col("pass"), F.col("weight")).otherwise(0.0)).alias("got"), F.sum("weight").alias("total"),
    )
    out = got.join(verdicts.select("draft_id", as_bool(F.col("smells")).alias("said"), "weakest"), "draft_id")
    rate = F.when(F.col("total") > 0, F.col("got") / F.col("total")).otherwise(0.0)
    clean = F.col("n_fail") == 0
    return out.select("draft_id", "items", "passed", "n_fail", "weighted_fail", rate.alias("pass_rate"), clean.alias("clean"), F.coalesce("said", clean).alias("smells"), "weakest")


def weighted_rate(items: DataFrame, weights: DataFrame) -> DataFrame:
    """G5, G6, J6 over items(draft_id, key, pass); keys without a weight weigh 1, no items give 0."""
    rows = items.join(weights.select("key", "weight"), "key", "left").withColumn("w", F.coalesce("weight", F.lit(1.0))).withColumn("ok", F.coalesce("pass", F.lit(False)))
    hit = F.sum(F.when(F.col("ok"), F.col("w")).otherwise(0.0))
    return rows.groupBy("draft_id").agg((hit / F.sum("w")).alias("pass_rate"), F.count_if(~F.col("ok")).alias("n_fail"), (F.sum("w") - hit).alias("weighted_fail"))


def best_draft(rounds: DataFrame) -> DataFrame:
    """For each run the draft with the least weighted fail (then the higher score), earliest first."""
    return rounds.groupBy("run_id").agg(F.min_by(F.struct("round", "draft", "weighted_fail"), F.struct("weighted_fail", -F.col("score"), "round")).alias("best")).select("run_id", "best.*")
