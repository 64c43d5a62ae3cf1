"""The rubric: a small document, parsed into items with stable keys; or a table of rubrics, each parsed where it is."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitize
from .schemas import RUBRIC


class RubricError(RuntimeError):
    """The rubric can't be derived; nothing stands in for it."""


@dataclass(frozen=True)
class Rubric:
    """Items (ord, key, title, desc, kind, weight), gate questions and the text itself."""

    items: tuple[tuple[int, str, str, str, str, float], ...]
    gate: tuple[str, ...]
    text: str

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.items), RUBRIC)


def _flat(text: str) -> str:
    return " ".join(text.split())


def _bold_items(block: str, bullet: str) -> list[tuple[str, str]]:
    """(title, rest) of each line that starts with the bullet and a bold title, up to the next such line."""
    heads = list(re.finditer(rf"^{bullet}\s+\*\*(.+?)\*\*", block, re.M))
    stops = [h.start() for h in heads[1:]] + [len(block)]
    return [(_flat(h[1]), _flat(block[h.end() : stop])) for h, stop in zip(heads, stops)]


def parse(text: str, header: str = r"^## .*RUBRIC.*$", keys: dict[str, tuple[str, ...]] | None = None, weights: dict[str, float] | None = None) -> Rubric:
    """Items of block A are of kind backbone, those of B mechanical; C holds gate questions.

    keys: stable keys by kind, in order; items beyond them get one from their title. weights: other than 1.
    Raises RubricError without header, A, B, or items in A.
    """
    start = re.search(header, text, re.M)
    if not start:
        raise RubricError("no rubric header")
    section = text[start.end() :].split("\n---", 1)[0]
    marks = list(re.finditer(r"^###\s+([A-D])\..*$", section, re.M))
    stops = [m.start() for m in marks[1:]] + [len(section)]
    blocks = {m[1]: section[m.end() : stop] for m, stop in zip(marks, stops)}
    for letter in "AB":
        if letter not in blocks:
            raise RubricError(f"block {letter} is missing")
    items = []
    for letter, kind, bullet in (("A", "backbone", r"\d+\."), ("B", "mechanical", "-")):
        found = _bold_items(blocks[letter], bullet)
        if letter == "A" and not found:
            raise RubricError("block A has no items")
        stable = (keys or {}).get(kind, ())
        for k, (title, rest) in enumerate(found):
            key = stable[k] if k < len(stable) else re.sub(r"[^a-z0-9]+", "_", title.lower()).strip("_") or f"item_{k}"
            items.append((len(items), key, title, rest or title, kind, (weights or {}).get(key, 1.0)))
    gate = tuple(_flat(q) for q in re.findall(r"^\d+\.\s+(.+?)\s*$", blocks.get("C", ""), re.M))
    return Rubric(tuple(items), gate, (start[0] + section).strip())


def items_of(texts: DataFrame, by: str = "rubric_id", **how) -> DataFrame:
    """S19 for a table of rubrics (by, text): (by, ord, key, title, desc, kind, weight). A rubric that can't be derived fails the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(own, *item) for own, text in zip(batch[by], batch["text"]) for item in parse(text or "", **how).items]
            yield pd.DataFrame(rows, columns=[by, *(c.split()[0] for c in RUBRIC.split(", "))])

    kinds = f"`{by}` {texts.schema[by].dataType.simpleString()}, {RUBRIC}"
    return texts.select(by, F.col("text").cast("string").alias("text")).mapInPandas(run, kinds)


def backbone(items: DataFrame) -> DataFrame:
    return items.where("kind = 'backbone'")


def mechanical(items: DataFrame) -> DataFrame:
    return items.where("kind = 'mechanical'")


def total_weight(items: DataFrame, *by: str) -> DataFrame:
    """Of all items, or of each rubric."""
    return items.groupBy(*by).agg(F.sum("weight").alias("total_weight"))


def prompt_text(items: DataFrame, *by: str, heading: str = "THE RUBRIC (keep every item):") -> DataFrame:
    """F8: a rubric as one text for a prompt, rebuilt from its items so that it keeps its own rules: (by, text)."""
    title = F.regexp_replace(sanitize(F.col("title")), r"[. ]+\z", "")
    line = F.concat(F.lit("- "), title, F.lit(". "), sanitize(F.col("desc")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda i: i["line"])
    return items.groupBy(*by).agg(F.array_join(F.concat(F.array(F.lit(heading)), lines), "\n").alias("text"))


def described(keys: DataFrame, items: DataFrame, *by: str) -> DataFrame:
    """keys(key, ...) with `desc`, the first item's of that key (in the rubric that `by` names), or the key itself."""
    first = items.groupBy(*by, "key").agg(F.min_by("desc", "ord").alias("desc"))
    return keys.join(first, [*by, "key"], "left").withColumn("desc", F.coalesce("desc", "key"))
