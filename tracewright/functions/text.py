"""Text expressions: trimming, counting, splitting, titles, keys, caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest body that is embedded, shortest that teaches anything.
MAX_BODY, MIN_BODY = 4000, 30
#: All Unicode white space, as (?U)\s has it.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Line breaks besides the line feed.
BREAKS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
LINE_BREAKS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def trim_u(text: Column) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def strip(text: Column) -> Column:
    """As trim_u, looking at the ends only: a pattern is tried at each character of a text."""
    return F.trim(text, F.lit(SPACES))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def collapse(text: Column) -> Column:
    """White-space runs become one space, ends are stripped."""
    return trim_u(F.regexp_replace(text, r"(?U)\s+", " "))


def long_enough(body: Column, least: int = MIN_BODY) -> Column:
    """Is the stripped body long enough to be kept?"""
    return F.length(trim_u(body)) >= least


def cap_body(body: Column) -> Column:
    """Bodies over MAX_BODY end at their last space within it, marked by an ellipsis."""
    head = F.regexp_replace(F.substring(body, 1, MAX_BODY), r"(?s) [^ ]*\z", "")
    return F.when(F.length(body) > MAX_BODY, F.concat(head, F.lit(" …"))).otherwise(body)


def body_full(body: Column) -> Column:
    """The whole of a body that cap_body shortens, else null."""
    return F.when(F.length(body) > MAX_BODY, body)


def sentences(text: Column) -> Column:
    """array of sentences; ends are . ! ? before white space, or line feeds."""
    parts = F.split(trim_u(text), r"(?<=[.!?])(?U:\s+)|\n+")
    return F.filter(F.transform(parts, trim_u), lambda s: s != "")


def infer_title(body: Column) -> Column:
    """first line, collapsed, cut to 70 characters; 'untitled' if empty."""
    line = collapse(F.element_at(F.split(trim_u(body), "\n"), 1))
    cut = F.when(F.length(line) > 70, F.concat(F.substring(line, 1, 70), F.lit("…"))).otherwise(line)
    return F.when(line == "", "untitled").otherwise(cut)


def text_key(text: Column) -> Column:
    """content key of the embedding cache."""
    return F.sha1(text.cast("binary"))


def sanitize(text: Column) -> Column:
    """F8: em dashes and sentence-joining colons become full stops; runs of stops become one."""
    out = F.replace(F.replace(text, F.lit(" — "), F.lit(". ")), F.lit("—"), F.lit(". "))
    out = F.regexp_replace(out, r":(?U:\s+)", ". ")
    return trim_u(F.regexp_replace(out, r"(?U)[.\s]*\.[.\s]*\.[.\s]*", ". "))


def project_of(path: Column) -> Column:
    """name of the folder that a file lies in."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Does the text hold any of the substrings?"""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def split_title(title: Column) -> dict[str, Column]:
    """Date (first DD.MM.YYYY) and surface (first of SURFACES, in this order, found as a word)."""
    surface = F.lit("")
    for name in reversed(SURFACES):
        surface = F.when(title.rlike(rf"(?iU)\b{name}\b"), name).otherwise(surface)
    return {"date": F.regexp_extract(title, r"(?U)\b(\d{2}\.\d{2}\.\d{4})\b", 1), "channel": surface}


#: Surfaces that a title may name, in order of preference.
SURFACES = ("LinkedIn", "Substack", "reel", "carousel", "vlog", "video", "Instagram")
