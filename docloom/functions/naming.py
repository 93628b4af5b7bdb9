"""Names of folders and files made from titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import strip, strip_chars

# Words that tell manuals, the two categories, and how file names put authors and years first.
MANUAL_WORDS = ("manual", "datasheet", "data sheet", "handbook", "user guide", "userguide", "应用笔记", "应用手册", "数据手册", "用户手册", "规格书", "参考手册", "specification", "product brief")
PAPER, MANUAL = "paper", "Manual"
YEAR = r"(?:1[89]\d{2}|20\d{2}[a-z]?)"
DASH = r"\s*[-–—]\s*"
YEAR_FIRST = rf"(?Ud)\A\s*{YEAR}{DASH}(.+)$"
AUTHORS_YEAR = rf"(?Ud)\A\s*([^-]{{1,120}}?){DASH}({YEAR}){DASH}(.+)$"
AUTHORS = rf"(?Ud)\A\s*([^-–—]{{1,60}}?){DASH}(.+)$"
LIKE_AUTHORS = r"(?Ud)(等|和|,|&|\band\b|\bet al\b|^[A-Z][a-zA-Z.\-]+(\s+[A-Z][a-zA-Z.\-]+){1,3}$)"


def category(*hints: Column) -> Column:
    """Manual if any hint has one of its words, else paper."""
    said = F.lower(F.concat_ws(" ", *(F.nullif(h, F.lit("")) for h in hints)))
    return F.when(said.rlike("|".join(MANUAL_WORDS)), MANUAL).otherwise(PAPER)


def title(stem: Column) -> Column:
    """A file name's title: what follows a year, authors and a year, or authors who look like some."""
    name = strip(F.coalesce(stem, F.lit("")))
    return (
        F.when(name.rlike(YEAR_FIRST), strip(F.regexp_extract(name, YEAR_FIRST, 1)))
        .when(name.rlike(AUTHORS_YEAR), strip(F.regexp_extract(name, AUTHORS_YEAR, 3)))
        .when(name.rlike(AUTHORS) & strip(F.regexp_extract(name, AUTHORS, 1)).rlike(LIKE_AUTHORS), strip(F.regexp_extract(name, AUTHORS, 2)))
        .otherwise(name)
    )


def _cleaned(name: Column) -> Column:
    safe = strip(F.regexp_replace(F.coalesce(name, F.lit("")), r'[:*?"<>|\\/]+', "_"))
    safe = strip_chars(F.regexp_replace(safe, r"(?U)[\s\x1c-\x1f]+", " "), " ._")
    return F.when(safe == "", "untitled").otherwise(safe)


def folder_name(name: Column, most: int = 64) -> Column:
    """Safe for a folder; overlong names are cut and told apart by a hash of the whole."""
    safe = _cleaned(name)
    cut = F.rtrim(F.substring(safe, 1, most - 9), F.lit(" ._"))
    return F.when(F.length(safe) > most, F.concat(cut, F.lit("_"), F.left(F.sha1(name), F.lit(8)))).otherwise(safe)


def file_name(name: Column, most: int = 120) -> Column:
    cut = F.rtrim(F.substring(_cleaned(name), 1, most), F.lit(" ._"))
    return F.when(cut == "", "untitled").otherwise(cut)


def batch_folder(stem: Column, path: Column, category_: Column | None = None, sub_category: Column | None = None) -> Column:
    """category / sub-category, if there is one / title."""
    own = F.coalesce(F.nullif(category_, F.lit("")), category(stem, path)) if category_ is not None else category(stem, path)
    sub = F.nullif(sub_category, F.lit("")) if sub_category is not None else F.lit(None).cast("string")
    return F.concat_ws("/", folder_name(own, 32), F.when(sub.isNotNull(), folder_name(sub, 32)), folder_name(title(stem)))


def request_id(folder: Column, prefix: str = "docloom-") -> Column:
    """Equal folders get equal keys, so that a repeated upload is recognised."""
    return F.concat(F.lit(prefix), F.left(F.sha1(folder), F.lit(12)))


def work_dir(parent: Column, stem: Column, root: str = ".docloom") -> Column:
    return F.concat_ws("/", parent, F.lit(root), folder_name(title(stem)))


def out_dir(parent: Column, stem: Column, path: Column, category_: Column, sub_category: Column, root: str = "outfile") -> Column:
    """The root itself unless a category or a sub-category is given."""
    base = F.concat_ws("/", parent, F.lit(root))
    none = (F.coalesce(category_, F.lit("")) == "") & (F.coalesce(sub_category, F.lit("")) == "")
    return F.when(none, base).otherwise(F.concat_ws("/", base, batch_folder(stem, path, category_, sub_category)))


def translated_path(folder: Column, stem: Column, suffix: str = ".zh.md") -> Column:
    return F.concat(folder, F.lit("/"), stem, F.lit(suffix))
