"""Small literal tables for operators that the test tables don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FENCE = "```"

MARKDOWN = [
    ("a/fence.md", f"### A\nbody\n{FENCE}\n### x\n---\n{FENCE}\ntail"),
    ("a/rule.md", "### A\none\n---\ntwo\n### B\nthree"),
    ("a/note.md", "### A\n> n1\n\n> n2\nbody\n> quote"),
    ("a/section.md", "## S\n# T\n### A\nb"),
    ("a/scaffold.md", "### A. Law\nb\n### _(none yet)_\nb"),
    ("a/surface.md", "### reel on LinkedIn (01.02.2026)\nb"),
    ("a/empty.md", "### A\n\n### B\nb"),
    ("a/none.md", ""),
]
DOCS = [
    ("r/2026-01-05-plan.md", "# Plan\nintro that is long enough to be kept as a trace of its own\n## Why\n" + "w" * 40 + "\n## Short\n" + "s" * 39),
    ("r/plain.md", "no heading at all, but surely more than forty characters of text"),
    ("r/late.md", "\n\n\n\n\n# Late title\nthis body has a title on line six, so the stem names it"),
    ("r/fenced.md", f"# F\n{FENCE}\n## not a heading, only code inside of a fence\n{FENCE}\n"),
]
DECISIONS = [
    ("p/alpha/D.md", "- 2026-01-02 cache: reads are slow. KARAR: add one / NEDEN: a/b ratio is bad / GERI ALMA: ucuz\n- plain bullet\n- only why: it depends NEDEN: because"),
    ("p/beta/D.md", "# Top\n## 2026-02-03 · build · use tabs\nNeden: they are\n  shorter\nYÖNTEM: by vote\nEtki: none\n\n## 19 Tem · x · pick\n- Karar: first\n- Karar: second\nKanıt: log"),
    ("p/gamma/D.md", "- 2026-01-02 cache: reads are slow. KARAR: add one / NEDEN: other / GERI ALMA: high"),
    ("p/delta/D.md", f"## open\n{FENCE}\nKarar: inside\n{FENCE}\n- a b KARAR: kept in section\n# closed\n- t: c GERİ ALMA: lost"),
]
RUBRIC_TEXT = """# Notes
## THE RUBRIC
### A. Backbone
1. **Open plainly.** No hook
   of any kind.
2. **One thesis.** Carry it.
### B. Mechanics
- **No em dash.** Not one.
- **No list.**
### C. Gate
1. Would I say it?
2. Is it true?

---
tail
"""
RUBRIC = [(0, "thesis", 1.0), (1, "em_dash", 3.0), (2, "list", 2.0), (3, "voice", 1.5)]
JUDGE = [
    (1, '{"items": [{"key": "thesis", "pass": true}, {"key": "em_dash", "pass": "evet"}, {"key": "list", "pass": 1}, {"key": "voice", "pass": "pass"}], "smells": true}'),
    (2, "```json\n" + '{"items": [{"key": "thesis", "pass": "false"}, {"key": "em_dash", "pass": "maybe"}], "smells": "no"}' + "\n```"),
    (3, 'Sure: {"items": [{"key": "list", "pass": true, "note": "a } in a string"}, {"key": "list", "pass": false}, {"key": "other", "pass": true}]} thanks'),
    (4, '{"items": [{"key": "thesis", "pass": true'),
    (5, '{"items": []}'),
]
BOUNDARY = [
    (-1, "A clean sentence. Another one!"),
    (-2, "We paid $50k for it. Nothing else."),
    (-3, "My mother had surgery last year.\nShe is fine."),
    (-4, "my dad asked about my salary? Yes."),
    (-5, "About kanser and nothing more"),
    (-6, "The server uses 2 TLS layers"),
    (-7, "Toplam 1.200 tl oldu. my sister is in hospital."),
    (-8, "private channel"),
    (-9, ""),
]
SANITIZE = [(-1, "a — b—c: d.. e . . f"), (-2, "  plain  "), (-3, "x:y: z")]

GOLD = [
    (1, "Boats", "harbor boats sail at dawn", "writing"),
    (2, "Bread", "fresh bread from stone ovens", "writing"),
    (3, "Price", "price was $50k last winter", "writing"),
]
POOL = [
    (1, "Ship log", "harbor boats sail at dawn", "decision", 1.0),
    (2, "Oven notes", "fresh bread from stone ovens", "writing", 1.0),
    (3, "Shop idea", "price was $50k last winter", "idea", 1.0),
]
CUES = [(1, "harbor boats sail at dawn"), (2, "fresh bread from stone ovens"), (3, "price was $50k last winter")]
FILES = [
    ("w/raw/log.md", "## Days\n### morning — Substack (01.02.2026)\n> a note\nthe harbor wakes before anyone else does"),
    ("w/alpha/DECISIONS.md", "- 2026-01-02 cache: reads are slow here. KARAR: add one / NEDEN: the ratio is bad / GERI ALMA: ucuz"),
    ("w/reports/2026-01-05-audit.MD", "# Audit\n## Findings\nnothing broke in the second week, and the logs say why"),
    ("w/reports/plain.txt", "a report without headings, which is still long enough to be kept"),
    ("w/reports/deep/no.md", "reports of deeper folders are not listed, however long they may be"),
    ("w/reports/data.csv", "tables are not reports, however long their first line may be, or the second"),
    ("w/beta/CLAUDE.md", "# Beta\n## State\nthe project map of beta, with more than forty characters"),
    ("w/node_modules/x/CLAUDE.md", "# Copy\n## State\nthe project map of a copy, with more than forty characters"),
    ("w/IDEA_PARKING.md", "# Ideas\n## Kiosk\na kiosk for old maps of the coast\n## No\ntoo short"),
    ("w/video-fikirleri/a/b.md", "loneliness as a wall, and who builds it"),
    ("w/other/c.md", "a file that only the parked channel of notes would take in, if named"),
]
_TABLES = {
    "gold": (GOLD, "id long, title string, body string, channel string"),
    "pool": (POOL, "id long, title string, body string, channel string, channel_weight double"),
    "cues": (CUES, "cue_id long, cue string"),
    "files": (FILES, "path string, content string"),
    "markdown": (MARKDOWN, "path string, content string"),
    "docs": (DOCS, "path string, content string"),
    "decisions": (DECISIONS, "path string, content string"),
    "rubric": (RUBRIC, "ord int, key string, weight double"),
    "judge": (JUDGE, "draft_id long, raw string"),
    "boundary": (BOUNDARY, "doc_id long, text string"),
    "sanitize": (SANITIZE, "doc_id long, text string"),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = _TABLES[name]
    return spark.createDataFrame(rows, schema)


def sql_values(name: str) -> str:
    """The table as a SQL VALUES list."""

    def quoted(x) -> str:
        return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(quoted(x) for x in row) + ")" for row in _TABLES[name][0])
