"""Parts of pages: data embedded in a script, regions between anchors, images of sections.

All are expressions inside the row: a page is never shuffled to be cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import bound, html_lines, unescape

#: A string with its escapes (an open one reaches the end), or a brace; possessive, so long strings need no stack.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\z)|[{}]'
IMAGE = r"""(?i)<img[^>]+src\s*=\s*["']([^"']+)["']"""
#: Fixed value: characters of a region that no end marker closes.
REGION = 60_000
#: Sections that count as the body of a page.
BODY_SECTIONS = ("공연소개", "프로그램북", "공연정보", "공지사항", "알립니다")
DETAILS = "array<struct<Name:string,Value:string>>"


def _after(text: Column, anchor: str, skip: int = 0) -> Column:
    """The text from an anchor on, less some characters; null without the anchor."""
    return bound(F.instr(text, F.lit(anchor)), lambda at: F.when(at > 0, F.substring(text, at + skip, F.length(text))))


def _first_object(tail: Column) -> Column:
    """The text up to the brace that closes its first one; null if none does."""

    def step(acc: Column, x: Column) -> Column:
        at, depth = acc["at"] + x["n"], acc["depth"] + x["d"]
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(acc["end"].isNull() & (x["d"] == -1) & (depth == 0), at).otherwise(acc["end"]).alias("end"))

    sized = lambda piece, hit: F.struct((F.length(piece) + F.length(hit)).alias("n"), F.when(hit == "{", 1).when(hit == "}", -1).otherwise(0).alias("d"))
    steps = bound(F.regexp_extract_all(tail, F.lit(TOKEN), F.lit(0)), lambda hits: F.zip_with(F.slice(F.split(tail, TOKEN, -1), F.lit(1), F.size(hits)), hits, sized))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("end"))
    return F.substring(tail, F.lit(1), F.aggregate(steps, zero, step, lambda acc: acc["end"]))


def embedded_json(page: Column, first: str, second: str) -> Column:
    """The object that begins with the brace at the end of ``second``, the first one after ``first``; as text.

    Braces are counted outside strings. Null if an anchor is missing, the braces do
    not close, or what they hold is no JSON.
    """
    found = bound(_after(page, first), lambda rest: bound(_after(rest, second, len(second) - 1), _first_object))
    return bound(found, lambda x: F.when(F.try_parse_json(x).isNotNull(), x))


def regions(page: Column, begin: str, end: str, cap: int = REGION) -> Column:
    """array<string>: from each match of ``begin`` to the next match of ``end``, or ``cap`` characters where none follows.

    Matches of the two do not overlap. Mostly an end lies before the next begin, and
    the piece between two begins is all that is read; only else is the rest of the
    page searched.
    """
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + F.length(x))
    cut = lambda text, none: bound(F.get(F.split(text, end, 2), F.lit(0)), lambda head: F.when(F.length(head) < F.length(text), head).otherwise(none))

    def all_of(parts: Column) -> Column:
        pieces, hits = parts["pieces"], parts["hits"]
        at = lambda i: length(F.slice(pieces, F.lit(1), i)) + length(F.slice(hits, F.lit(1), i)) + 1
        far = lambda i: bound(F.substring(page, at(i), F.length(page)), lambda tail: cut(tail, F.substring(tail, 1, cap)))
        return F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: cut(F.get(pieces, i), far(i)))

    parts = F.struct(F.split(page, begin, -1).alias("pieces"), F.regexp_extract_all(page, F.lit(f"({begin})"), F.lit(1)).alias("hits"))
    return F.when(page.rlike(begin), bound(parts, all_of)).otherwise(F.expr("CAST(array() AS array<string>)"))


def distinct_lines(parts: Column) -> Column:
    """Lines of all parts in order, each once."""
    return F.array_distinct(F.flatten(F.transform(parts, html_lines)))


def region_lines(page: Column, begin: str, end: str, cap: int = REGION) -> Column:
    """Lines of a page's regions in order, each once."""
    return distinct_lines(regions(page, begin, end, cap))


def _bodies(details: Column, sections: Sequence[str]) -> Column:
    return F.transform(F.filter(F.coalesce(details, F.expr(f"CAST(array() AS {DETAILS})")), lambda d: d["Name"].isin(*sections)), lambda d: F.coalesce(d["Value"], F.lit("")))


def section_lines(details: Column, sections: Sequence[str] = BODY_SECTIONS) -> Column:
    """Lines of the named sections of array<struct<Name, Value>> in order, each once."""
    return distinct_lines(_bodies(details, sections))


def section_images(details: Column, site: str, sections: Sequence[str] = BODY_SECTIONS) -> Column:
    """Addresses of images in the named sections, each once; relative ones belong to the site, drawings (.svg) are left out."""
    found = F.flatten(F.transform(_bodies(details, sections), lambda v: F.regexp_extract_all(v, F.lit(IMAGE), F.lit(1))))
    clean = F.transform(found, lambda u: unescape(F.trim(u)))
    whole = F.transform(clean, lambda u: F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(F.startswith(u, F.lit("/")), F.concat(F.lit(site), u)).otherwise(u))
    return F.array_distinct(F.filter(whole, lambda u: ~F.endswith(F.lower(u), F.lit(".svg"))))
