"""Markdown and decision parsers: the small literal files with their expected rows, and scans over one file on many tasks against windows by file."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import duck, same
from tracewright.functions.text import SPACES, strip, trim_u
from tracewright.operators import verdicts
from tracewright.plans import catalog, fixtures
from tracewright.sources import markdown

#: What the literal files give, row by row.
EXPECTED = {
    "markdown_entries": """SELECT * FROM (VALUES ('a/fence.md', 'A', 'body' || chr(10) || '```' || chr(10) || '### x' || chr(10) || '---' || chr(10) || '```' || chr(10) || 'tail', '', '', '', ''),
('a/rule.md', 'A', 'one', '', '', '', ''), ('a/rule.md', 'B', 'three', '', '', '', ''), ('a/note.md', 'A', 'body' || chr(10) || '> quote', '', 'n1 n2', '', ''), ('a/section.md', 'A', 'b', 'S', '', '', ''),
('a/surface.md', 'reel on LinkedIn (01.02.2026)', 'b', '', '', 'LinkedIn', '01.02.2026'), ('a/empty.md', 'B', 'b', '', '', '', '')) v(path, title, body, section, note, channel, date)""",
    "markdown_sections": """SELECT path, title, n::BIGINT AS n, section, date FROM (VALUES ('r/2026-01-05-plan.md', 'Plan', 58, 'Plan', '2026-01-05'), ('r/2026-01-05-plan.md', 'Plan — Why', 40, 'Plan', '2026-01-05'),
('r/fenced.md', 'F', 53, 'F', ''), ('r/late.md', 'late', 55, 'late', ''), ('r/plain.md', 'plain', 64, 'plain', '')) v(path, title, n, section, date)""",
    "decision_fields": """SELECT * FROM (VALUES ('19 Tem · x · pick', 'first second', '', '', '', 'log', '19 Tem', 'beta'), ('2026-02-03 · build · use tabs', 'use tabs', 'they are shorter YÖNTEM: by vote', 'none', '', '', '2026-02-03', 'beta'),
('cache', 'add one', 'a/b ratio is bad', 'ucuz', 'reads are slow.', '', '2026-01-02', 'alpha'), ('only why', 'only why', 'because', '', 'it depends', '', '', 'alpha'),
('open', 'inside ``` - a b KARAR: kept in section', '', '', '', '', '', 'delta'), ('t', 't', '', '', 'c', '', '', 'delta')) v(title, choice, reason, cost, context, outcome, date, project)""",
    "decision_stats": """SELECT project, n::BIGINT AS n, f::BIGINT AS "full", c::BIGINT AS costed, p::BIGINT AS placed FROM (VALUES ('alpha', 2, 2, 1, 2), ('beta', 2, 1, 1, 0), ('delta', 2, 0, 0, 1)) v(project, n, f, c, p)""",
    "verdict_summary": """SELECT * FROM (VALUES (1::BIGINT, 4::BIGINT, 4::BIGINT, 0::BIGINT, 0.0::DOUBLE, 1.0::DOUBLE, true), (2, 4, 0, 4, 7.5, 0.0, false), (3, 4, 0, 4, 7.5, 0.0, false), (4, 4, 0, 4, 7.5, 0.0, false), (5, 4, 0, 4, 7.5, 0.0, false)) v(draft_id, items, passed, n_fail, weighted_fail, pass_rate, smells)""",
    "verdict_coerce": """SELECT d.id::BIGINT AS draft_id, k.key, (d.id = 1) AS pass, coalesce(d.id = 1 OR d.id = 2 AND k.key = 'thesis' OR d.id = 3 AND k.key = 'list', false) AS parsed
FROM (VALUES (1), (2), (3), (4), (5)) d(id) CROSS JOIN (VALUES ('thesis'), ('em_dash'), ('list'), ('voice')) k(key)""",
}
LONG = "long"


def given(spark, name):
    decisions = lambda: markdown.load_decisions(fixtures.frame(spark, "decisions"))
    if name == "markdown_entries":
        return markdown.entries(fixtures.frame(spark, "markdown")).select("path", "title", "body", "section", "note", "channel", "date")
    if name == "markdown_sections":
        return markdown.sections(fixtures.frame(spark, "docs"), "report").select("path", "title", F.length("body").cast(LONG).alias("n"), "section", "date")
    if name == "decision_fields":
        return decisions().select("title", "choice", "reason", "cost", "context", "outcome", "date", "project")
    if name == "decision_stats":
        return catalog.placed(decisions())
    got = verdicts.parsed(fixtures.frame(spark, "judge"))
    if name == "verdict_coerce":
        return verdicts.coerced(got, fixtures.frame(spark, "rubric")).select("draft_id", "key", "pass", "parsed")
    out = verdicts.judged(got, fixtures.frame(spark, "rubric"))
    return out.select("draft_id", "items", "passed", "n_fail", F.round("weighted_fail", 6).alias("weighted_fail"), F.round("pass_rate", 6).alias("pass_rate"), "smells")


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_literal_files(spark, small, name):
    same(given(spark, name).toPandas(), duck(small).execute(EXPECTED[name]).df())


PIECES = ["# Top", "## Section é", "## ", "### Entry — Substack (01.02.2026)", "### A. Law", "### ", "---", "-----", "```", "  ```py", "> note", "> ", "", "  ", "text", "a longer line of text, so that sections are kept",
          "Neden: because", "- Karar: do it", "Durum: it waits", "YÖNTEM: by vote", "- 2026-01-02 cache: slow. KARAR: add / NEDEN: fast / GERI ALMA: ucuz", "- t: c GERİ ALMA: lost", "# x\u2028y"]


def files(seed, count, most):
    rng = random.Random(seed)
    return [(f"p{k % 3}/f{k}.md", "\n".join(rng.choice(PIECES) for _ in range(rng.randint(0, most)))) for k in range(count)]


def both(spark, rows):
    """The same files as whole values, and as lines in no order on many tasks."""
    whole = spark.createDataFrame(rows, "path string, content string")
    lines = [(path, n, line) for path, text in rows for n, line in enumerate(text.split("\n")) if text]
    random.Random(1).shuffle(lines)
    return whole, spark.createDataFrame(lines, "path string, n long, line string").repartition(7)


@pytest.fixture
def small_parts(spark):
    """Without it a small file's parts are put together again."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


PARSERS = {
    "entries": (markdown.entries, markdown.entries_of),
    "sections": (lambda t: markdown.sections(t, "report"), lambda t: markdown.sections_of(t, "report")),
    "decisions": (markdown.decisions, markdown.decisions_of),
}


@pytest.mark.parametrize("name", sorted(PARSERS))
@pytest.mark.parametrize("count,most", [(40, 60), (1, 3000)])
def test_scan_equals_windows(spark, small_parts, name, count, most):
    """Many files, and one that is cut into as many parts as there are tasks: fences, sections and labels reach over the cuts."""
    whole, lines = both(spark, files(most, count, most))
    want, got = (sorted(map(str, f(t).drop("n").collect())) for f, t in zip(PARSERS[name], (whole, lines)))
    assert got == want and (want or count == 1)
    if count == 1:
        parts = markdown.scanned(lines).select("part").distinct().count()
        assert parts >= 4


def test_scan_of_nothing(spark):
    none = spark.createDataFrame([], "path string, n long, line string")
    assert markdown.entries_of(none).count() == markdown.sections_of(none, "x").count() == markdown.decisions_of(none).count() == 0


def test_one_open_fence(spark, small_parts):
    """A fence that is never closed hides all that follows, whatever part of the file it is in."""
    text = "### A\nbody\n" + "x\n" * 500 + "```\n" + "### B\nmore\n" * 500
    _, lines = both(spark, [("a/f.md", text)])
    rows = markdown.entries_of(lines).collect()
    assert len(rows) == 1 and rows[0].title == "A" and rows[0].body.count("### B") == 500


@pytest.mark.parametrize("name,most", [("entries", 2), ("sections", 6), ("decisions", 4)])
def test_lines_are_gone_through_few_times(spark, name, most):
    """Running values that build on each other don't each read all lines again: the plan's leaves, which hold lines or one row a part."""
    _, lines = both(spark, files(3, 4, 40))
    leaves = PARSERS[name][1](lines)._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves <= most


def test_segments_over_many_parts(spark, small_parts):
    """A segment that begins in one part and ends in another, with fences over the cuts, is one row; the section above it is known in all parts."""
    text = "## S\n### A\n> n\n" + "x\n" * 300 + "```\n## no\n" + "### y\n" * 300 + "```\n> q\n" + "z\n" * 300 + "### B\n> m\n\nb\n---\n" + "lost\n" * 300 + "### C\nc"
    whole, lines = both(spark, [("a/f.md", text), (None, "### N\nnull path"), ("b/g.md", "### G\ng")])
    want, got = (sorted(map(str, f(t).drop("n").collect())) for f, t in zip(PARSERS["entries"], (whole, lines)))
    assert got == want and len(got) == 5
    assert sorted((r.title, r.section, r.note) for r in markdown.entries_of(lines).collect()) == [("A", "S", "n"), ("B", "S", "m"), ("C", "S", ""), ("G", "", ""), ("N", "", "")]


def test_bullets_of_one_heading_stay_in_their_parts(spark, small_parts):
    """Only what becomes one row is brought together: bullets under one heading are rows of their own."""
    text = "# Log\n" + "\n".join(f"- 2026-01-02 t{k}: slow. KARAR: add {k} / NEDEN: fast" for k in range(2000))
    whole, lines = both(spark, [("p/decisions.md", text)])
    assert markdown.scanned(lines, ("H1", "H2"), ("H2",)).select("part").distinct().count() >= 4
    want, got = (sorted(map(str, f(t).drop("n").collect())) for f, t in zip(PARSERS["decisions"], (whole, lines)))
    assert got == want and len(got) == 2000


@pytest.mark.parametrize("name", sorted(PARSERS))
def test_rows_that_hold_many_lines(spark, small_parts, name):
    """The lines of a file may come as rows of several lines each."""
    text = files(7, 1, 2000)[0][1].split("\n")
    one = spark.createDataFrame([("a/f.md", k, line) for k, line in enumerate(text)], "path string, n long, line string")
    many = spark.createDataFrame([("a/f.md", k, "\n".join(text[k : k + 9])) for k in range(0, len(text), 9)], "path string, n long, line string")
    want, got = (sorted(map(str, PARSERS[name][1](t).drop("n").collect())) for t in (one, many))
    assert got == want and want


def test_white_space_is_that_of_patterns(spark):
    """SPACES are the code points that (?U)\\s takes."""
    points = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    got = points.where(F.col("c").rlike(r"\A(?U:\s)\z")).select("c").collect()
    assert sorted(r.c for r in got) == sorted(SPACES)
    ends = spark.createDataFrame([(a + b + c,) for a in ("", " ", "\u3000\n\x85") for b in ("", "x", "a \u2003 b", "é\tß") for c in ("", "\t", "\u2028 \r\n")], "t string")
    assert ends.where(~strip(F.col("t")).eqNullSafe(trim_u(F.col("t")))).count() == 0
