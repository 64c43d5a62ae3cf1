"""The seven channels as rules over files: which paths, which parser, which name as source.

A rule is applied to a DataFrame (path, content), so that one listing of a tree serves all channels.
Files that are copies or build output never count.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import project_of
from . import markdown
from .registry import WEIGHTS, Channel

NO_FILES = "path string, content string"


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*\z", "")


@dataclass(frozen=True)
class Rule:
    """pattern: of the whole path; source: from the path to what follows the channel's name in `source`; least: characters of a section."""

    name: str
    pattern: str
    source: Callable[[Column], Column] = stem_of
    least: int = 40
    glob: str = "*.md"

    def traces(self, files: DataFrame) -> DataFrame:
        mine = files.where(F.col("path").rlike(self.pattern) & ~F.col("path").rlike(markdown.EXCLUDED))
        if self.name == "decision":
            return markdown.decision_memory(markdown.load_decisions(mine))
        if self.name == "writing":
            return markdown.entries(mine, "episodic").drop("path", "n")
        rows = markdown.sections(mine, self.name, self.least)
        return rows.withColumn("source", F.concat(F.lit(f"{self.name}:"), self.source(F.col("path")))).drop("path", "n")


#: File names and folders of the channels, and the least section of each.
RULES = (
    Rule("writing", r"(?:^|/)raw/[^/]+\.md\z"),
    Rule("decision", r"(?:^|/)DECISIONS\.md\z", glob="DECISIONS.md"),
    Rule("report", r"(?:^|/)reports/[^/]+\.(?i:md|txt)\z", glob="*"),
    Rule("projectdoc", r"(?:^|/)CLAUDE\.md\z", project_of, glob="CLAUDE.md"),
    Rule("idea", r"(?:^|/)IDEA_PARKING\.md\z", lambda path: F.lit("parking"), 20, "IDEA_PARKING.md"),
    Rule("desktop", r"(?:^|/)(?:video-fikirleri/.+|content-creator-agent/gece-(?:yazilar|linkedin|reels))\.md\z", least=30),
    Rule("notes", r"\.md\z"),
)
#: Channels that load only where they are named.
PARKED = ("notes",)


def channels(root: str, notes_variable: str = "TRACEWRIGHT_NOTES_DIR", files: DataFrame | None = None) -> list[Channel]:
    """The registry over the files below `root`, or over files(path, content). Notes lie in the folder that an environment variable
    names; where it is unset, the channel is empty."""

    def loader(rule: Rule) -> Callable[[SparkSession], DataFrame]:
        def load(spark: SparkSession) -> DataFrame:
            if files is not None:
                return rule.traces(files)
            base = os.environ.get(notes_variable, "") if rule.name == "notes" else root
            if not base:
                return rule.traces(spark.createDataFrame([], NO_FILES))
            return rule.traces(markdown.read_files(spark, base, rule.glob, recursive=True))

        return load

    return [Channel(r.name, loader(r), WEIGHTS[r.name], r.name not in PARKED) for r in RULES]
