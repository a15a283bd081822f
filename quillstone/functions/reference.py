"""Written-out references as structs.

A reference is read from both ends. The words up to the first full stop are its
authors; what follows, up to ``[J]`` where that is written, is a title; then come
the journal, as far as the first number, and a tail of numbers. One reader takes
year, volume, issue and pages out of the tail, whatever stands between them.
Talks and posters of meetings have a meeting and an abstract number instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import cases, let, rx, s

FIELDS = ("authors", "title", "journal", "year", "volume", "issue", "pages")
#: Meetings whose abstracts are cited, longer names first.
MEETINGS = ("ASCO-GI", "ASCO-GL", "ASCO", "ESMO", "EASL", "AASLD", "APASL", "CSCO")
#: What marks a reference as a meeting's abstract even where no year stands beside it.
MEETING_WORDS = ("ESMO", "ASCO", "Annual Meeting", "Abstract")
#: What may stand before the number of an abstract.
NUMBERED = ("Abstract", "Poster", "LBA", "TiP")
MARKS = r"[\s,，.;:：]"


def _last_of(text: Column) -> Column:
    """Without marks at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"^{MARKS}+", ""), f"{MARKS}+$", "")


def _tail(numbers: Column) -> dict[str, Column]:
    """Year, volume, issue and pages of the numbers that end a reference; empty where one is not written."""
    part = lambda x, p: F.regexp_extract(x, p, 1)
    bracketed, leading = part(numbers, r"\((\d{4})\)"), part(numbers, rf"^{MARKS}*(\d{{4}})(?!\w)")
    year = F.when(bracketed != "", bracketed).otherwise(leading)
    rest = F.when(bracketed != "", F.regexp_replace(numbers, r"\(\d{4}\)", " ")).otherwise(F.regexp_replace(numbers, rf"^{MARKS}*\d{{4}}(?!\w)(?:\s+[A-Za-z]+)?", " "))
    after = part(rest, r"(?i)vol\.\s*\d+\s*,\s*(\d+)")
    return {
        "year": year,
        "volume": part(rest, r"^\D*?(\d+)"),
        "issue": F.when(after != "", after).otherwise(part(rest, r"\d\s*\((\w+)\)")),
        "pages": part(rest, r"[:：,，]\s*(e?\d+(?:[-–]\d+)?)\D*$"),
    }


def parse_reference(text: Column) -> Column:
    """(authors ... pages, kind, meeting, meeting_year, abstract).

    A meeting's abstract has authors, year, meeting and number; a reference without
    a journal and a year after its first full stop has only the first year in it.
    """
    # each step is worked out once
    return let(F.trim(s(text)), lambda d: let(_body(d), lambda b: let(_journal(b["body"]), lambda j: let(_tail_of(b["body"], j), lambda tail: _fields(d, b, j, tail)))))


def _body(d: Column) -> Column:
    """(authors, title, body): what stands before the first full stop, up to ``[J]``, and behind."""
    authors = _last_of(F.when(F.contains(d, F.lit(".")), F.substring_index(d, ".", 1)).otherwise(""))
    rest = F.when(rx(d, r"\.\s"), F.regexp_replace(d, r"^[^.]*\.\s+", "")).otherwise("")

    def parts(rest: Column) -> Column:
        titled = F.contains(rest, F.lit("[J]"))
        title = F.when(titled, _last_of(F.substring_index(rest, "[J]", 1))).otherwise("")
        return F.struct(authors.alias("authors"), title.alias("title"), _last_of(F.when(titled, F.substring_index(rest, "[J]", -1)).otherwise(rest)).alias("body"))

    return let(rest, parts)


def _journal(body: Column) -> Column:
    return F.regexp_extract(body, r"(?i)^(\D*?)(?:\bvol\.|\d|$)", 1)


def _tail_of(body: Column, journal: Column) -> Column:
    return let(F.substring(body, F.length(journal) + 1, F.length(body)), lambda numbers: F.struct(*[v.alias(k) for k, v in _tail(numbers).items()]))


def _fields(d: Column, b: Column, journal: Column, tail: Column) -> Column:
    first = lambda p: F.regexp_extract(d, p, 1)
    year, authors = first(r"(?<!\w)(\d{4})(?!\w)"), b["authors"]
    values = {"authors": authors, "title": b["title"], "journal": _last_of(journal), **{k: tail[k] for k in ("year", "volume", "issue", "pages")}}
    whole = (values["journal"] != "") & (tail["year"] != "")

    named = rf"(?i)(\d{{4}})\s*({'|'.join(MEETINGS)})(?![A-Za-z])"
    beside = rx(d, named)
    meeting = beside | rx(d, f"(?i)(?:{'|'.join(MEETING_WORDS)})")
    return let(F.struct(beside.alias("beside"), meeting.alias("meeting"), whole.alias("whole")), lambda is_: _reference(d, named, values, year, is_["beside"], is_["meeting"], is_["whole"]))


def _reference(d: Column, named: str, values: dict[str, Column], year: Column, beside: Column, meeting: Column, whole: Column) -> Column:
    authors, first = values["authors"], lambda p: F.regexp_extract(d, p, 1)
    number = first(rf"(?i)(?:{'|'.join(NUMBERED)})\s*(\w*\d\w*)")
    # else the word that follows the meeting, if it has a figure in it
    number = F.when(number != "", number).otherwise(F.when(beside, F.regexp_extract(d, rf"{named}{MARKS}+(\w*\d\w*)", 3)).otherwise(""))
    fields = {f: F.when(meeting, {"authors": authors, "year": year}.get(f, F.lit(""))).when(whole, values[f]).otherwise(year if f == "year" else F.lit("")) for f in FIELDS}
    return F.struct(
        *[v.alias(k) for k, v in fields.items()],
        cases([(meeting, "conference_abstract")], "literature").alias("kind"),
        F.when(beside, F.upper(F.regexp_extract(d, named, 2))).otherwise("").alias("meeting"),
        F.when(beside, F.regexp_extract(d, named, 1)).otherwise("").alias("meeting_year"),
        F.when(meeting, number).otherwise("").alias("abstract"),
    )
