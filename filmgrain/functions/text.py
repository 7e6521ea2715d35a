"""Text functions as Column expressions; one Arrow UDF for markup that expressions can't read."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All white space of Unicode, spelled out so that every regex engine agrees.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Named entities that expressions decode, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"))


#: Shown names of sources.
SOURCE_NAMES = {"tmdb": "TMDB Reviewer"}
UUID = r"(?i)^(?:urn:uuid:)?(?:\{[0-9a-f]{8}-?(?:[0-9a-f]{4}-?){3}[0-9a-f]{12}\}|[0-9a-f]{8}-?(?:[0-9a-f]{4}-?){3}[0-9a-f]{12})$"


def is_uuid(text: Column) -> Column:
    """Whether a text is a UUID, with or without dashes or braces; NULL is none."""
    return F.coalesce(text.rlike(UUID), F.lit(False))


def display_name(name: Column) -> Column:
    """A source's shown name in the place of its key; other names stay."""
    out = name
    for key, shown in SOURCE_NAMES.items():
        out = F.when(name == key, F.lit(shown)).otherwise(out)
    return out


def trimmed_query(text: Column) -> Column:
    """A query without white space at its ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def iso(moment: Column) -> Column:
    """A moment in ISO form, to the second."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def clean_html(text: Column) -> Column:
    """Text without scripts, styles, comments and tags (a blank in the place of each), common entities decoded; NULL gives ''."""
    out = F.coalesce(text, F.lit(""))
    for pattern in (r"(?is)<(script|style)\b.*?</(script|style)\s*>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def normalize_whitespace(text: Column) -> Column:
    """Every run of white space one blank, none at the ends; NULL gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))


def preprocess(text: Column, lowercase: bool = True, remove_html: bool = True, collapse: bool = True) -> Column:
    """Markup, then white space, then case."""
    out = clean_html(text) if remove_html else F.coalesce(text, F.lit(""))
    out = normalize_whitespace(out) if collapse else out
    return F.lower(out) if lowercase else out


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def parse_html(texts: pd.Series) -> pd.Series:
    """As clean_html by a real parser: all entities, broken markup. NULL gives ''."""

    def one(t):
        if t is None or ("<" not in t and "&" not in t):
            return t or ""
        if "<" not in t:
            return html.unescape(t)
        p = _Text()
        p.feed(t)
        p.close()
        return " ".join(p.parts)

    return texts.map(one, na_action=None)


def stripped_length(text: Column) -> Column:
    """Characters without white space at the ends; 0 for NULL."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", ""))


def is_valid_review(text: Column, least: int = 20) -> Column:
    return stripped_length(text) >= least


def shorten(text: Column, size: int = 200) -> Column:
    """At most size characters and an ellipsis only where something is cut; NULL stays."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def given(text: Column) -> Column:
    """NULL for the empty text."""
    return F.nullif(text, F.lit(""))


def image_url(path: Column, prefix: str) -> Column:
    return F.when(given(path).isNotNull(), F.concat(F.lit(prefix), path))


def contains_ilike(text: Column, part: str) -> Column:
    """Case-blind search for part, whose % and _ are wildcards."""
    return text.ilike(f"%{part}%")


def markdown(text: Column) -> Column:
    """**bold** and *italic* as tags."""
    bold = F.regexp_replace(text, r"\*\*(.*?)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(bold, r"\*(.*?)\*", "<em>$1</em>")


def initial(text: Column) -> Column:
    return F.upper(F.substring(text, 1, 1))


def author_name(author: Column, nickname: Column, has_user: Column, source: Column) -> Column:
    """The author's name, else the user's nickname as it is, else the source."""
    return F.coalesce(given(author), F.when(has_user, nickname), source)


def parse_date(text: Column) -> Column:
    """yyyy-MM-dd, else NULL."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
