"""Wiki markup to plain text, approximately, and the string functions of its templates."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN = (
    (r"(?s)<!--.*?-->", ""), (r"(?s)<(ref|gallery|timeline|math|code|noinclude)\b[^>]*?/>", ""), (r"(?s)<(ref|gallery|timeline|math|code|noinclude)\b.*?</\1>", ""), (r"<[^<>]+>", ""),
    (r"\[\[(?:File|Image|Category):[^\[\]]*\]\]", ""), (r"\[\[[^\[\]|]*\|([^\[\]|]*)\]\]", "$1"), (r"\[\[([^\[\]|]*)\]\]", "$1"), (r"\[(?:https?|ftp)://\S+ ([^\]]*)\]", "$1"), (r"\[(?:https?|ftp)://\S+\]", ""),
    (r"'{2,5}", ""), (r"__[A-Z]+__", ""), (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"), (r"(?m)^[*#:;]+\s*", ""), (r"[ \t]+", " "), (r" +([,.;:!?])", "$1"), (r"\n{3,}", "\n\n"),
)


def remove_nested(text: str, opening: str, closing: str) -> str:
    """Without spans of balanced signs; a span that is not closed stays."""
    out, depth, kept, start = [], 0, 0, 0
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if m.group() == opening:
            if depth == 0:
                start = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append(text[kept:start])
                kept = m.end()
    return "".join([*out, text[kept:]])


@F.pandas_udf(T.StringType())
def drop_templates(text: pd.Series) -> pd.Series:
    """Templates {{...}} and tables {|...|} removed, and entities resolved."""
    return text.map(lambda t: None if t is None else html.unescape(remove_nested(remove_nested(t, "{{", "}}"), "{|", "|}")))


def plain_text(text: Column) -> Column:
    out = drop_templates(text)
    for pattern, by in PLAIN:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def roman(n: Column, otherwise: Column | None = None) -> Column:
    """Roman numeral of 1 to 4999; else the second argument."""
    digits = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    tables = [["", "M", "MM", "MMM", "MMMM"], digits("C", "D", "M"), digits("X", "L", "C"), digits("I", "V", "X")]
    parts = [F.element_at(F.array(*map(F.lit, t)), (F.floor(n / 10**e) % 10 + 1).cast("int")) for t, e in zip(tables, (3, 2, 1, 0), strict=True)]
    return F.when((n >= 1) & (n < 5000), F.concat(*parts)).otherwise(otherwise if otherwise is not None else n.cast("string"))


def first_upper(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def first_lower(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def normal_title(title: Column) -> Column:
    return first_upper(F.trim(F.regexp_replace(title, r"[\s_]+", " ")))


def find(text: Column, part: Column) -> Column:
    """Place from 1; -1 where there is none."""
    at = F.position(part, text)
    return F.when(at > 0, at).otherwise(-1)


def compact(text: Column) -> Column:
    """Paragraphs of plain text: headings without text below are left out, list marks go, blank lines end a paragraph, and its lines become one."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[*#:;|!\-]+\s*", "")))
    # A heading (= x =) that the next heading, or the end, follows says nothing.
    marked = F.array_join(lines, "\n")
    for _ in range(6):  # levels of headings
        marked = F.regexp_replace(marked, r"(?m)^(=+)[^=\n]+\1[ ]*\n\s*(?=(=+)[^=\n]+\2[ ]*(\n|\z)|\z)", "")
    paragraphs = F.split(F.regexp_replace(marked, r"(?m)^=+\s*(.*?)\s*=+[ ]*$", "\n$1.\n"), r"\n\s*\n")
    joined = F.transform(paragraphs, lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " ")))
    return F.array_join(F.filter(joined, lambda p: p != ""), "\n")


def base_name(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def substring(text: Column, begin: Column, length: Column) -> Column:
    """Places from 1; a negative one counts from the end."""
    return F.substr(text, begin, length)


def replace_some(text: Column, part: str, by: str, times: int | None = None) -> Column:
    """text with the first so many occurrences of part (all, if not given) replaced."""
    pieces = F.split(text, "\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    if times is None:
        return F.array_join(pieces, by)
    n = F.size(pieces)
    head = F.slice(pieces, F.lit(1), F.least(n, F.lit(times + 1)))
    tail = F.slice(pieces, F.least(n, F.lit(times + 1)) + 1, F.greatest(n - times - 1, F.lit(0)))
    return F.array_join(F.concat(F.array(F.array_join(head, by)), tail), part)
