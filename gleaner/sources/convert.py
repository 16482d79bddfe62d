"""In-process converters, as column functions and by name for files."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_html(html: Column) -> Column:
    """Visible text of an HTML page on one line: no scripts, styles, comments or tags; the five named references of XML are decoded."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(s, r"[ \t\n\r]+", " "))


#: Elements whose content isn't text of the page, and those whose content is text without tags.
HIDDEN, PLAIN = ("script", "style"), ("title", "textarea")
_NAME = re.compile(r"[A-Za-z][^ \t\n\f\r/>]*+")
#: The rest of a tag: quoted values may hold a >; possessive, so that it is read once.
_REST = re.compile(r"""(?:[^>=]|=[ \t\n\f\r]*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+>""")
_END = {n: re.compile(rf"</{n}(?=[ \t\n\f\r/>])", re.I) for n in HIDDEN + PLAIN}
_BLANKS = re.compile(r"[ \t\n\f\r]+")


def html_text(html: str) -> str:
    """Visible text of an HTML page on one line.

    One scan from left to right, each character read a bounded number of times whatever the
    markup: tags, comments, declarations and processing instructions are one
    space each, scripts and styles too; a < that begins none of these is text.
    What is not closed reaches to the end of the page.  All named and numbered
    character references are decoded, within a stretch of text.
    """
    out, at, n = [], 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            out.append(unescape(html[at:]))
            break
        after = html[lt + 1 : lt + 2]
        closes = after == "/"
        name = _NAME.match(html, lt + 2 if closes else lt + 1)
        if name is None and (after == "" or after not in "/!?"):
            out.append(unescape(html[at:lt]) + "<")  # no reference holds a <, so the stretch may be cut here
            at = lt + 1
            continue
        out += unescape(html[at:lt]), " "
        if name is None:
            comment = html.startswith("<!--", lt)
            end = html.find("-->", lt + 2) if comment else html.find(">", lt + 1)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        tag = _REST.match(html, name.end())
        at = tag.end() if tag else n
        kind = name[0].lower()
        if not closes and kind in _END:
            end = _END[kind].search(html, at)
            stop = end.start() if end else n
            if kind in PLAIN:
                out.append(unescape(html[at:stop]))
            at = stop
    return _BLANKS.sub(" ", "".join(out)).strip(" ")


def html_texts(html: Column) -> Column:
    """html_text of a column in Arrow batches; null gives an empty text."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: html_text(x) if x is not None else "")

    return run(html)


def from_html(raw: bytes) -> str:
    return html_text(raw.decode("utf-8", "replace"))


#: Converters that need no program, by what the configuration calls them.
BUILT_IN = {"builtin:html": from_html}
