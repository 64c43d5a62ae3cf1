"""Markdown to traces and decisions: what a line means follows from running sums and last values over the lines before it.

Inputs are DataFrames (path, content), as `spark.read.text(wholetext=True)` gives them; windows by file then parse files in parallel.
Or they are lines (path, n, line) of files of any size (`entries_of`, `sections_of`, `decisions_of`): those are range-partitioned by path and
place, so that one file is many tasks. The few lines that can change what others mean (fences, headings, rules) tell, for a part that starts
outside of a fence and for one that starts inside, how it ends; a prefix over one row a part gives what each part starts from. A segment that
goes on into later parts is then counted to the part that it began in, so lines are shuffled once for the windows and not again for the groups.

Lines inside code fences are opaque.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import BREAKS, LINE_BREAKS, any_of, project_of, split_title, strip, trim_u
from ..operators.lineage import cut, stored

# Labels of decision records and the slots that they fill.
LABELS = {
    "karar": "choice", "neden": "reason", "gerekçe": "reason", "gerekce": "reason", "geri alma": "cost", "geri alma maliyeti": "cost",
    "etki": "cost", "durum": "context", "hakem": "outcome", "kanit": "outcome", "kanıt": "outcome", "pin disiplini": "outcome",
}
INLINE_LABEL = "KARAR|NEDEN|GERI ALMA|GERİ ALMA"
LABEL_LINE = r"^-?\s*([A-Za-zÇĞİÖŞÜçğıöşü ]{3,30}?):\s*(.*)\z"
MONTHS = "Oca|Şub|Mar|Nis|May|Haz|Tem|Ağu|Eyl|Eki|Kas|Ara"
#: Least lines of a part of a file, and about how many parts there are at most; they are more than tasks, so that tasks are alike.
PART_LINES, MOST_PARTS = 2048, 2048
EDGES = ("H1", "H2", "H3", "RULE")
SLOTS = ("context", "choice", "reason", "cost", "outcome")
#: Paths that hold any of these are copies or build output.
EXCLUDED = r"/\.audit-clones/|/worktrees/|/node_modules/|/\.venv/|/__pycache__/"


def read_files(spark: SparkSession, path: str, glob: str = "*.md", recursive: bool = False) -> DataFrame:
    """(path, content) of whole text files; S15: without copies and build output."""
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("content")).where(~F.col("path").rlike(EXCLUDED))


def _running(rows: DataFrame, **values: tuple[str, Column]) -> DataFrame:
    """`rows` with, for each name, the "sum" or the "last" value that isn't null over the lines of the file, or of the part of it, up to this one."""
    whole = Window.partitionBy(*_file(rows)).orderBy("n")
    kept = {name: (how, f"__{name}") for name, (how, _) in values.items()}
    rows = rows.withColumns({f"__{name}": value for name, (_, value) in values.items()})
    rows = rows.withColumns({name: F.sum(c).over(whole) if how == "sum" else F.last(c, True).over(whole) for name, (how, c) in kept.items()})
    return rows.drop(*[c for _, c in kept.values()])


def _file(rows: DataFrame) -> list[str]:
    return ["path", "part"] if "part" in rows.columns else ["path"]


def _mark(st: Column) -> Column:
    """What a stripped line is outside of fences: FENCE, H1, H2, H3, RULE or C."""
    return (
        F.when(st.startswith("```"), "FENCE")
        .when(st.startswith("# "), "H1")
        .when(st.startswith("## "), "H2")
        .when(st.startswith("### "), "H3")
        .when(st.startswith("---") & st.rlike(r"^-{3,}\z"), "RULE")
        .otherwise("C")
    )


def _kinds(rows: DataFrame) -> DataFrame:
    """Lines with their st (stripped) and mark, with fence, free (outside of fences), k (H1, H2, H3, RULE or C)."""
    rows = rows.withColumn("fence", F.col("mark") == "FENCE")
    rows = _running(rows, fences=("sum", F.col("fence").cast("int")))
    inside = F.col("fences") + F.col("inside") if "part" in rows.columns else F.col("fences")
    rows = rows.withColumn("free", ~F.col("fence") & (inside % 2 == 0)).drop("fences", "inside")
    return rows.withColumn("k", F.when(F.col("free"), F.col("mark")).otherwise("C")).drop("mark")


def lines(files: DataFrame) -> DataFrame:
    """The lines of whole files, with their kinds."""
    text = F.regexp_replace(F.regexp_replace("content", LINE_BREAKS, "\n"), r"\n\z", "")
    rows = files.where(F.length("content") > 0).select("path", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return _kinds(rows.withColumn("st", strip(F.col("line"))).withColumn("mark", _mark(F.col("st"))))


def scanned(rows: DataFrame, edges: tuple[str, ...] = EDGES, whole: tuple[str, ...] | None = None) -> DataFrame:
    """The lines (path, n, line) of files of any size, with their kinds and `part`, the part of a range that a line is in. `n` orders the lines of a file;
    rows that hold line breaks are several lines, and have the place of the first.

    Lines of one part up to its first edge are counted to the part that their segment began in, if it is of the kinds `whole` (all by default).
    `above` says what a part starts from: the head (kind of the last edge) and the section (the last `## ` line).
    """
    rows = rows.repartitionByRange("path", "n").sortWithinPartitions("path", "n")
    text = F.coalesce("line", F.lit(""))
    split = F.when(any_of(text, BREAKS), F.split(text, rf"{LINE_BREAKS}|\n")).otherwise(F.split(text, "\n"))  # a pattern over all text is slow
    rows = rows.select("path", F.col("n").alias("at"), F.posexplode(split).alias("within", "line"))
    rows = rows.withColumn("st", strip(F.col("line"))).withColumn("mark", _mark(F.col("st")))
    # Headings are written twice, so that they can be read without all other text.
    named = F.when(F.col("mark") != "C", F.col("st")).alias("named")
    rows = stored(rows.select("path", F.monotonically_increasing_id().alias("row"), F.struct("at", "within").alias("n"), "line", "mark", named))
    size = max(PART_LINES, -(-rows.count() // MOST_PARTS))
    rows = rows.withColumn("part", F.expr(f"row div {size}")).drop("row")
    starts = F.broadcast(cut(_starts(rows, edges, whole)))  # a part has at most one file that began in an earlier one
    rows = rows.join(starts, rows["path"].eqNullSafe(starts["__path"]) & (rows["part"] == starts["__part"]), "left")
    leads = F.col("led").isNotNull() & (F.col("first").isNull() | (F.col("n") < F.col("first")))
    to = F.when(leads, F.col("led")).otherwise(F.col("own"))
    rows = rows.select("path", F.coalesce(to["part"], "part").alias("part"), "n", "line", "mark", F.coalesce(to["inside"], F.lit(0)).alias("inside"), to["above"].alias("above"))
    return _kinds(rows.withColumn("st", strip(F.col("line"))))


def _starts(rows: DataFrame, edges: tuple[str, ...], whole: tuple[str, ...] | None) -> DataFrame:
    """What the parts start from that go on with a file: `first`, the place of their first edge; `own`, what their lines from there on start from
    and `led`, what those before it do, each with the part that they are counted to, if that is another one."""
    marks = rows.where("mark <> 'C'").select("path", "part", "n", "mark", "named")
    marks = _running(marks, odd=("sum", (F.col("mark") == "FENCE").cast("int"))).withColumn("odd", F.col("odd") % 2)
    edge, ends = F.col("mark").isin(*edges), []
    for inside in (0, 1):  # whether a part starts in a fence
        free = F.col("odd") == inside
        last, section = F.when(edge & free, F.col("n")), F.when((F.col("mark") == "H2") & free, F.col("n"))
        ends.append(F.struct(F.min(last).alias("first"), F.max_by("mark", last).alias("head"), F.max_by("named", section).alias("section")).alias(f"ends{inside}"))
    told = marks.groupBy(F.col("path").alias("__path"), F.col("part").alias("__part")).agg(F.sum((F.col("mark") == "FENCE").cast("int")).alias("fences"), *ends)
    parts = rows.select("path", "part").distinct()
    parts = parts.join(told, F.col("path").eqNullSafe(F.col("__path")) & (F.col("part") == F.col("__part")), "left")
    # One row a part of a file from here on.
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("inside", F.coalesce(F.sum("fences").over(before), F.lit(0)) % 2)
    parts = parts.withColumn("ends", F.when(F.col("inside") == 0, F.col("ends0")).otherwise(F.col("ends1")))
    above = F.struct(F.last("ends.head", True).over(before).alias("head"), F.last("ends.section", True).over(before).alias("section"))
    parts = parts.withColumn("above", above).withColumn("begins", F.first("part").over(before))
    leads = F.coalesce(F.col("above.head").isin(*whole), F.lit(False)) if whole is not None else F.lit(True)
    # A part whose first lines are counted to another one starts with an edge, and so outside of fences.
    leads = leads & F.col("begins").isNotNull()
    own = F.struct("part", F.when(leads, F.lit(0)).otherwise(F.col("inside")).alias("inside"), "above")
    parts = parts.withColumn("own", own)
    opened = F.last(F.when(F.col("ends.first").isNotNull(), F.col("own")), True).over(before)
    parts = parts.withColumn("led", F.when(leads, F.coalesce(opened, F.first("own").over(before))))
    return parts.where("begins IS NOT NULL").select(F.col("path").alias("__path"), F.col("part").alias("__part"), F.col("ends.first").alias("first"), "own", "led")


def _segments(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """seg: number of the boundary line that a line follows, in the file or in the part; head: kind of that line."""
    rows = rows.withColumn("edge", F.col("k").isin(*kinds))
    rows = _running(rows, seg=("sum", F.col("edge").cast("int")), head=("last", F.when(F.col("edge"), F.col("k"))))
    return rows.withColumn("head", F.coalesce("head", "above.head")) if "part" in rows.columns else rows


def _joined(when: Column, value: Column, glue: str) -> Column:
    rows = F.array_sort(F.collect_list(F.when(when, F.struct(F.col("n"), value.alias("x")))))
    return F.array_join(F.transform(rows, lambda r: r["x"]), glue)


def entries(files: DataFrame, kind: str = "semantic") -> DataFrame:
    """One row per `### ` entry: path, n, title, body, section, note, channel, date, source, kind."""
    return _entries(lines(files), kind)


def entries_of(rows: DataFrame, kind: str = "semantic") -> DataFrame:
    """S1 over lines (path, n, line)."""
    return _entries(scanned(rows, EDGES, ("H3",)), kind)


def _entries(rows: DataFrame, kind: str) -> DataFrame:
    rows = _segments(rows, EDGES)
    st = F.col("st")
    ends = F.col("fence") | (F.col("free") & ~F.col("edge") & (st != "") & ~st.startswith(">"))
    rows = _running(rows, section=("last", F.when(F.col("k") == "H2", trim_u(F.substr("st", F.lit(4))))), ends=("sum", ends.cast("int")))
    if "part" in rows.columns:
        rows = rows.withColumn("section", F.coalesce("section", trim_u(F.substr("above.section", F.lit(4)))))
    # How many lines have ended the notes since the entry began.
    rows = _running(rows, ended_before=("last", F.when(F.col("edge"), F.col("ends"))))
    rows = rows.withColumn("ended", F.col("ends") - F.coalesce("ended_before", F.lit(0)))
    rows = rows.where("head = 'H3'").withColumn("noted", F.col("free") & st.startswith(">") & (F.col("ended") == 0))
    got = rows.groupBy(*_file(rows), "seg").agg(
        F.min("n").alias("n"),
        F.max(F.when(F.col("edge"), trim_u(F.substr("st", F.lit(5))))).alias("title"),
        F.max(F.when(F.col("edge"), F.coalesce("section", F.lit("")))).alias("section"),
        trim_u(_joined(F.col("noted"), trim_u(F.substr("st", F.lit(2))), " ")).alias("note"),
        strip(_joined(~F.col("noted") & ~F.col("edge"), F.col("line"), "\n")).alias("body"),
    )
    ruled = trim_u(F.regexp_replace("body", r"\n?-{3,}(?U:\s*)\z", ""))
    got = got.withColumn("body", F.when(F.endswith("body", F.lit("---")), ruled).otherwise(F.col("body")))
    got = got.where((F.col("body") != "") & ~F.col("title").rlike(r"^[A-Z]\.\s") & ~F.col("title").rlike(r"^_\(.*\)_\s*\z"))
    hints = split_title(F.col("title"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", "")
    return got.select(
        "path", "n", "title", "body", "section", "note", hints["channel"].alias("channel"), hints["date"].alias("date"), stem.alias("source"), F.lit(kind).alias("kind")
    )


def sections(files: DataFrame, channel: str, min_chars: int = 40) -> DataFrame:
    """One row per `## ` section, and one for what stands before the first: path, n, title, body, section, channel, date, kind."""
    return _sections(lines(files), channel, min_chars)


def sections_of(rows: DataFrame, channel: str, min_chars: int = 40) -> DataFrame:
    """S13 over lines (path, n, line)."""
    return _sections(scanned(rows, ("H2",)), channel, min_chars)


def _sections(rows: DataFrame, channel: str, min_chars: int) -> DataFrame:
    rows = _segments(rows, ("H2",))
    place = F.col("n.at") + F.col("n.within") if "part" in rows.columns else F.col("n")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", "")
    # The title of a file: its first `# ` line, fenced or not, within the first five.
    top = F.col("st").startswith("# ") & (place < 5)
    titles = rows.where(top).groupBy(F.col("path").alias("__path")).agg(F.min_by(trim_u(F.substr("st", F.lit(3))), "n").alias("named"))
    if "part" in rows.columns:  # by part too: a file's lines stay in many tasks
        parts = rows.select(F.col("path").alias("__file"), F.col("part").alias("__part")).distinct()
        titles = parts.join(titles, F.col("__file") == F.col("__path")).drop("__file")
        rows = rows.join(titles, (F.col("path") == F.col("__path")) & (F.col("part") == F.col("__part")), "left")
    else:
        rows = rows.join(titles, F.col("path") == F.col("__path"), "left")
    named = F.col("named")
    rows = rows.withColumn("file_title", F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(stem))
    got = rows.groupBy(*_file(rows), "seg").agg(
        F.min("n").alias("n"),
        F.max("file_title").alias("section"),
        F.max(F.when(F.col("edge"), trim_u(F.substr("st", F.lit(4))))).alias("h"),
        strip(_joined(~F.col("edge") & (F.col("k") != "H1"), F.col("line"), "\n")).alias("body"),
    )
    under = F.concat(F.col("section"), F.lit(" — "), F.col("h"))
    title = F.when(F.coalesce("h", F.lit("")) != "", under).otherwise(F.col("section"))
    name = F.element_at(F.split("path", "/"), -1)
    return got.where((F.col("body") != "") & (F.length("body") >= min_chars)).select(
        "path", "n", title.alias("title"), "body", "section", F.lit(channel).alias("channel"), F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1).alias("date"), F.lit("episodic").alias("kind")
    )


def norm_label(label: Column) -> Column:
    """Slot of a label, null for unknown ones."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.try_element_at(known, F.lower(trim_u(label)))


def decision_date(text: Column) -> Column:
    """The first ISO date, or day and abbreviated month."""
    return trim_u(F.regexp_extract(text, rf"(\d{{4}}-\d{{2}}-\d{{2}}|(?U:\b)\d{{1,2}}\s+(?:{MONTHS}))", 1))


def _inline(rows: DataFrame) -> DataFrame:
    """`- date title: situation. KARAR: ... / NEDEN: ... / GERI ALMA: ...`"""
    body = trim_u(F.regexp_replace("st", r"^-+", ""))
    at = F.regexp_instr(body, F.lit(rf"(?U)\b(?:{INLINE_LABEL})\b"))
    head = trim_u(F.expr("substring(body, 1, at - 1)"))
    parts = F.split(F.expr("substring(body, at)"), rf"\s*/\s*(?=(?U:(?:{INLINE_LABEL})\b))")
    rows = rows.withColumn("body", body).withColumn("at", at).withColumn("h", head).withColumn("parts", parts)
    colon = F.instr("h", ":")
    title = F.when(colon > 0, trim_u(F.substring_index("h", ":", 1))).otherwise(F.col("h"))
    title = trim_u(F.regexp_replace(title, r"^\d{4}-\d{2}-\d{2}\s*", ""))
    context = F.when(colon > 0, trim_u(F.expr("substring(h, instr(h, ':') + 1)"))).otherwise("")
    label = rf"(?s)^({INLINE_LABEL})\s*:?\s*(.*)\z"
    pairs = F.transform("parts", lambda p: F.struct(norm_label(F.regexp_extract(trim_u(p), label, 1)).alias("slot"), trim_u(F.regexp_extract(trim_u(p), label, 2)).alias("x")))
    rows = rows.withColumn("pairs", pairs).withColumn("title", F.when(title != "", title).otherwise(F.substring("h", 1, 60)))

    def slot(name: str) -> Column:
        return F.array_join(F.transform(F.filter("pairs", lambda p: (p["slot"] == name) & (p["x"] != "")), lambda p: p["x"]), " ")

    choice = F.when(slot("choice") != "", slot("choice")).otherwise(F.col("title"))
    return rows.select(
        "path", "n", "title", choice.alias("choice"), slot("reason").alias("reason"), slot("cost").alias("cost"), context.alias("context"),
        slot("outcome").alias("outcome"), decision_date(F.col("h")).alias("date"), F.col("st").alias("raw"),
    )


def _sectioned(rows: DataFrame) -> DataFrame:
    """A `## ` title, then `Label: value` lines and what continues them."""
    slot = norm_label(F.regexp_extract("st", LABEL_LINE, 1))
    rows = rows.withColumn("slot", F.when(~F.col("edge"), slot))
    # The slot that a line continues: the last one named since the section began.
    rows = _running(rows, cur=("last", F.when(F.col("edge") | F.col("slot").isNotNull(), F.struct("slot"))))
    rows = rows.withColumn("cur", F.col("cur.slot"))
    value = F.when(F.col("slot").isNotNull(), trim_u(F.regexp_extract("st", LABEL_LINE, 2))).when(~F.col("edge"), F.col("st"))
    rows = rows.withColumn("x", value)
    title = F.max(F.when(F.col("edge"), trim_u(F.regexp_replace("st", "^#+", ""))))
    got = rows.groupBy(*_file(rows), "seg").agg(
        F.min("n").alias("n"),
        title.alias("title"),
        strip(_joined(F.lit(True), F.when(F.col("edge"), F.col("st")).otherwise(F.col("line")), "\n")).alias("raw"),
        *[_joined((F.col("cur") == s) & (F.col("x") != ""), F.col("x"), " ").alias(s) for s in SLOTS],
    )
    rest = trim_u(F.regexp_replace("title", r"^.*?·\s*[^·]*·\s*", ""))
    choice = F.when(F.col("choice") != "", F.col("choice")).when(rest != "", rest).otherwise(F.col("title"))
    return got.select("path", "n", "title", choice.alias("choice"), "reason", "cost", "context", "outcome", decision_date(F.col("title")).alias("date"), "raw")


def decisions(files: DataFrame) -> DataFrame:
    """Path, n, title, choice, reason, cost, context, outcome, date, raw, project, of both formats."""
    return _decisions(lines(files))


def decisions_of(rows: DataFrame) -> DataFrame:
    """S6 over lines (path, n, line)."""
    return _decisions(scanned(rows, ("H1", "H2"), ("H2",)))


def _decisions(rows: DataFrame) -> DataFrame:
    rows = _segments(rows, ("H1", "H2"))
    bullet = F.col("free") & (F.coalesce("head", F.lit("H1")) != "H2") & F.col("st").startswith("- ") & F.col("st").rlike(rf"(?U)\b(?:{INLINE_LABEL})\b")
    both = _inline(rows.where(bullet)).unionByName(_sectioned(rows.where("head = 'H2'")))
    both = both.where("choice <> '' or reason <> '' or context <> ''")
    return both.withColumn("project", project_of(F.col("path")))


def dedup_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row, in `order`, of each combination of keys: combined map-side, no window over rows."""
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names)], F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("__o"), F.struct(*[F.col(c) for c in df.columns]).alias("__r"))
    return rows.groupBy(*names).agg(F.min_by("__r", "__o").alias("__r")).select("__r.*")


def load_decisions(files: DataFrame, dedup: bool = True) -> DataFrame:
    """Decisions of files (path, content) or of lines (path, n, line), the first of those that agree in title and the start of the choice."""
    rows = decisions(files) if "content" in files.columns else decisions_of(files)
    if not dedup:
        return rows
    keys = [F.lower(trim_u(F.col("title"))), F.substring(F.lower(trim_u(F.col("choice"))), 1, 120)]
    return dedup_first(rows, keys, [F.col("path"), F.col("n")])


def decision_body() -> Column:
    """Labelled fields that aren't empty, one a line; the raw text without any."""
    names = {"context": "durum", "choice": "karar", "reason": "neden", "cost": "geri alma", "outcome": "sonuç"}
    parts = [F.when(F.col(c) != "", F.concat(F.lit(f"{n}: "), F.col(c))) for c, n in names.items()]
    text = F.concat_ws("\n", *parts)
    return F.when(text != "", text).otherwise(trim_u(F.col("raw")))


def decision_memory(rows: DataFrame) -> DataFrame:
    """Decisions as traces."""
    return rows.select(
        "title", decision_body().alias("body"), F.concat(F.lit("decision:"), F.col("project")).alias("source"), F.lit("episodic").alias("kind"),
        F.col("project").alias("section"), F.when(F.col("cost") != "", F.concat(F.lit("reversal-cost: "), F.col("cost"))).otherwise("").alias("note"),
        F.lit("decision").alias("channel"), "date", F.lit(0.0).alias("salience"),
    )
