"""What the engine is asked: prompts for writing, judging and repairing, and result records for people.

A prompt's first line names what it is about; its last section, after DRAFT, is the text as it stands.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAFT = "\nDRAFT:\n"


def law(rubric: list[dict]) -> str:
    """One line an item: what it is, or its key where it is not described."""
    return "\n".join(f"- {r['key']} [{r.get('kind') or 'rule'}]: {r.get('desc') or r['key']}" for r in rubric)


def _sections(*parts: tuple[str, str]) -> str:
    return "".join(f"\n\n{name}:\n{text}" for name, text in parts if text)


def writing(cue: str, rubric: list[dict], examples: str = "", context: str = "") -> str:
    """Asks for a first draft: the cue, the rules, approved texts for the voice and what is known for the facts."""
    return cue + _sections(("RULES", law(rubric)), ("WRITE LIKE THESE", examples), ("KNOWN, TO BUILD ON", context)) + "\n\nGive the text only."


def judging(draft: str, rubric: list[dict], examples: str = "") -> str:
    """Asks for a verdict on each item, fail-closed: against the rules and against approved texts, as clean but faceless texts fail too."""
    shape = '{"items": [{"key": "...", "pass": true, "note": "evidence, if it fails"}], "smells": true, "weakest": "..."}'
    return ",".join(r["key"] for r in rubric) + _sections(("ITEMS", law(rubric)), ("APPROVED TEXTS", examples), ("ANSWER WITH JSON ONLY", shape)) + "\n" + DRAFT + draft


def reading_again(raw: str, rubric: list[dict]) -> str:
    """Asks for an unreadable verdict once more, as JSON."""
    return ",".join(r["key"] for r in rubric) + "\n\nTurn this into one valid JSON object of the same shape and give nothing else." + "\n" + DRAFT + raw


def repairing(draft: str, failed: list[dict], rubric: list[dict], examples: str = "") -> str:
    """Asks to mend what failed and to leave the rest as it is. failed: items with key and note, the first one first."""
    known = {r["key"]: r.get("desc") or r["key"] for r in rubric}
    fixes = "\n".join(f"- {i['key']}: {i.get('note') or known.get(i['key'], i['key'])}" for i in failed)
    return failed[0]["key"] + _sections(("MEND ONLY THESE", fixes), ("RULES", law(rubric)), ("APPROVED TEXTS", examples)) + "\n" + DRAFT + draft


def parts(prompt: str) -> tuple[str, str]:
    """(first line, draft) of a prompt."""
    head, _, draft = prompt.partition(DRAFT)
    return head.split("\n", 1)[0], draft


def rounded(value, digits: int = 4):
    """floats rounded for people, in any nesting."""
    if isinstance(value, float):
        return round(value, digits)
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    return [rounded(v, digits) for v in value] if isinstance(value, list | tuple) else value


def record_json(record: dict, digits: int = 4) -> str:
    """A result as one line of JSON."""
    return json.dumps(rounded(record, digits), ensure_ascii=False)


def result_json(columns: dict[str, Column], floats: tuple[str, ...] = (), digits: int = 4) -> Column:
    """O12 over a table: the named columns as one line of JSON, those in `floats` rounded; nulls stay in it."""
    return F.to_json(F.struct(*[(F.bround(c, digits) if n in floats else c).alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})
