"""Text rules of single blocks, titles, references and replies.

Patterns carry (?U): white space and digits are Unicode's, as in the rules these columns state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of a str.strip(), which also takes the four separators below the space.
WS = r"[\s\x1c-\x1f]"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, even where f uses it several times or inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+|{WS}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+\z", "")


def strip_chars(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))


def effective_text(normalized: Column, source: Column) -> Column:
    """An empty normalised text counts as unset."""
    return F.coalesce(F.nullif(normalized, F.lit("")), source)


# What counts as a citation that was taken for a formula.
SUPERSCRIPT_CITATION = r"(?U)\$\s*\^\s*\{?\s*(\[[0-9][^$]{0,25}?\])\s*\}?\s*\$"
CITATION = r"(?U)\$\s*(\[\s*\d+(?:\s*[,\-–—]\s*\d+)*\s*\])\s*\$"


def plain_citations(c: Column) -> Column:
    """Bracketed references that stand in math marks lose them; superscripts keep a caret."""
    return F.regexp_replace(F.regexp_replace(c, SUPERSCRIPT_CITATION, r"^$1"), CITATION, "$1")


def clean_spaces(c: Column) -> Column:
    """Runs of blanks become one, line ends lose white space; text with display math or fences stays."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: rstrip(F.regexp_replace(x, r"[ \t]{2,}", " ")))
    return F.when(F.contains(c, F.lit("$$")) | F.contains(c, F.lit("```")), c).otherwise(F.array_join(lines, "\n"))


def clean_block(kind: Column, c: Column) -> Column:
    """The cleaning that a block's type calls for."""
    text = F.when(kind.isin("code", "math"), c).otherwise(plain_citations(c))
    return F.when(kind == "heading", rstrip(text)).when(kind.isin("paragraph", "list", "blockquote", "table", "raw"), clean_spaces(text)).otherwise(text)


def image_source(c: Column) -> Column:
    """The target of the first image, null without one."""
    return F.nullif(F.regexp_extract(c, r"(?U)!\[[^\]]*\]\(([^)\s]+)", 1), F.lit(""))


def clean_reference(c: Column) -> Column:
    """A local path with forward slashes; empty for remote and data references."""
    ref = strip_chars(strip(c), "<>")
    path = F.replace(F.regexp_extract(ref, r"(?s)\A([^?#]*)", 1), F.lit("\\"), F.lit("/"))
    return F.when(ref.rlike(r"\A(?:https?://|data:|//)"), F.lit("")).otherwise(F.regexp_replace(path, r"\A(?:\./)+", ""))


def image_references(c: Column) -> Column:
    """The distinct local references of a Markdown text, of both its own and HTML images."""
    own = F.regexp_extract_all(c, F.lit(r"(?U)!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))
    tags = F.regexp_extract_all(c, F.lit(r"""(?iU)<img[^>]*?\ssrc=["']([^"']+)["']"""), F.lit(1))
    return F.array_remove(F.array_distinct(F.transform(F.concat(own, tags), clean_reference)), "")


def base_name(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, r"/+\z", ""), r"(?s)([^/]*)\z", 1)


IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"


def rewrite_images(c: Column, urls: Column) -> Column:
    """Local image targets become the URLs that a map has for them, by whole path or else by file name; others stay.

    Of several entries for one name the last counts.
    """
    listed = F.flatten(F.transform(F.map_entries(urls), lambda e: F.array(F.struct(e["key"].alias("k"), e["value"].alias("v")), F.struct(base_name(e["key"]).alias("k"), e["value"].alias("v")))))
    between = F.split(c, IMAGE, -1)
    found = F.arrays_zip(F.regexp_extract_all(c, F.lit(IMAGE), F.lit(0)).alias("m"), F.regexp_extract_all(c, F.lit(IMAGE), F.lit(1)).alias("alt"), F.regexp_extract_all(c, F.lit(IMAGE), F.lit(2)).alias("ref"))

    def new(x: Column, entries: Column) -> Column:
        known = lambda name: F.nullif(F.try_element_at(F.filter(entries, lambda e: e["k"] == name), F.lit(-1))["v"], F.lit(""))
        ref = strip_chars(strip(x["ref"]), "<>")
        url = F.coalesce(known(ref), known(base_name(ref)))
        return F.when(ref.rlike(r"\A(?:https?://|data:)") | url.isNull(), x["m"]).otherwise(F.concat(F.lit("!["), x["alt"], F.lit("]("), url, F.lit(")")))

    # The entries are bound to a lambda's variable, so that they are listed once for each text and not for each image.
    rewritten = F.get(F.transform(F.array(listed), lambda entries: F.transform(found, lambda x: new(x, entries))), F.lit(0))
    joined = F.array_join(F.transform(F.arrays_zip(between.alias("t"), rewritten.alias("r")), lambda x: F.concat(x["t"], F.coalesce(x["r"], F.lit("")))), "")
    return F.when(F.coalesce(F.size(urls), F.lit(0)) <= 0, c).otherwise(joined)


def title_key(c: Column) -> Column:
    """A title as it is looked up: stripped, without final full stops."""
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), rf"(?U)(?:{WS}*\.)+\z", "")


# Section numbers at the start of a title.
ARABIC = r"(?Ud)\A\(?(\d+(?:\.\d+)*)\)?(?:[.)]\s+|\s+)"
LETTER = r"(?Ud)\A\(?([A-Za-z]{1,5})\)?[.)]\s+"


def number_token(c: Column) -> Column:
    """struct<hint, token>: arabic, letter or empty."""
    t = strip(c)
    arabic, letter = F.regexp_extract(t, ARABIC, 1), F.regexp_extract(t, LETTER, 1)
    return F.when(arabic != "", F.struct(F.lit("arabic").alias("hint"), arabic.alias("token"))).when(letter != "", F.struct(F.lit("letter").alias("hint"), letter.alias("token"))).otherwise(F.struct(F.lit("").alias("hint"), F.lit("").alias("token")))


def is_roman(token: Column) -> Column:
    """More than one character, all of them Roman numerals."""
    return (F.length(token) > 1) & F.upper(token).rlike(r"\A[IVXLCDM]+\z")


def dots(token: Column) -> Column:
    return F.length(token) - F.length(F.replace(token, F.lit("."), F.lit("")))


def level_of_number(title: Column, anchor: int = 2) -> Column:
    """The level that a title's number alone implies; 0 without one."""
    t = number_token(title)
    return F.when(t["hint"] == "arabic", anchor + dots(t["token"])).when(t["hint"] == "letter", F.when(is_roman(t["token"]), anchor).otherwise(anchor + 1)).otherwise(0)


def level_of_type(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.rlike(r"\Ah[1-6]\z"), F.expr("0") + F.substring(low, 2, 1).try_cast("int")).when(low.isin("title", "heading"), 1).otherwise(0)


def with_level(text: Column, level: Column) -> Column:
    """A heading's text with exactly so many marks; levels outside 1 to 6, 0 and null are brought inside."""
    marks = F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce(F.nullif(level, F.lit(0)), F.lit(1)), F.lit(1)), F.lit(6)))
    body = strip(F.regexp_replace(text, rf"(?U)\A{WS}*#{{1,6}}{WS}*", ""))
    return F.when(body == "", marks).otherwise(F.concat(marks, F.lit(" "), body))


def has_content(text: Column) -> Column:
    """Whether more is there than white space and marks of headings, quotes, lists and code."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A[\s\x1c-\x1f#>*\-`]*", "")) != ""


def collapse_blank_lines(text: Column) -> Column:
    lines = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.trim(F.regexp_replace(lines, r"\n[ \t]*\n+", "\n"), F.lit("\n"))


def without_thoughts(text: Column) -> Column:
    """A leading think element goes."""
    return strip(F.regexp_replace(text, rf"(?Us)\A{WS}*<think>.*?</think>", ""))


def absolute_url(source: Column, base: str) -> Column:
    return F.when(source.rlike(r"\Ahttps?://") | (source == ""), source).otherwise(F.concat(F.lit(base.rstrip("/")), source))
