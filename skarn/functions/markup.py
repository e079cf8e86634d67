"""URL, HTML and snippet expressions."""

from __future__ import annotations

import json
from html.entities import html5
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

URL_CHARS, TITLE_CHARS = 2000, 512
SNIPPET_CHARS, SNIPPET_LEAD = 220, 80
_SPACE = r"[\s\p{Z}]+"
#: Charsets that Spark decodes beside UTF-8.
CHARSETS = ("US-ASCII", "ISO-8859-1", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32")
#: Elements whose content is no text and holds no links.
DROPPED = ("script", "style", "noscript", "nav", "footer", "header")
#: Named entities, from the standard library's table.
_NAMED = json.dumps({f"&{name}": text for name, text in html5.items() if name.endswith(";") and name not in ("amp;", "AMP;")})
_AMPERSAND = r"&(?:amp;|AMP;|#0*38;|#[xX]0*26;)"
#: Private-use characters that stand for the marks until the text is escaped.
_OPEN, _CLOSE = "\ue000", "\ue001"


def url_hash(url: Column) -> Column:
    return F.sha2(F.substring(url, 1, URL_CHARS), 256)


def decode_bytes(raw: Column, charset: Column) -> Column:
    """Text of bytes in a named charset, UTF-8 where none or an unknown one is named; bad bytes are replaced."""
    out = F.decode(raw, "utf-8")
    for name in CHARSETS:
        out = F.when(F.lower(charset) == name.lower(), F.decode(raw, name)).otherwise(out)
    return out


def without_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def snippet(text: Column, terms: list[str], length: int = SNIPPET_CHARS) -> Column:
    """Escaped text around the first match of a term, matches in <mark>; substring matches count."""
    text = F.coalesce(text, F.lit(""))
    if not terms:
        return escape_html(F.substring(text, 1, length))
    pattern = "(?i)(" + "|".join(sorted(terms, key=terms.index)) + ")"
    found = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(F.lit(0), found - 1 - SNIPPET_LEAD)
    end = F.least(F.length(text), start + length)
    part = F.regexp_replace(text.substr(start + 1, end - start), pattern, f"{_OPEN}$1{_CLOSE}")
    marked = F.replace(F.replace(escape_html(part), F.lit(_OPEN), F.lit("<mark>")), F.lit(_CLOSE), F.lit("</mark>"))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), marked, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(found == 0, escape_html(F.substring(text, 1, length))).otherwise(cut)


def _each(text: Column, pattern: str, to) -> Column:
    """Text with every match of the pattern replaced by what to gives; those without an answer stay."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    # longest first, so that no match is a part of one that is replaced later
    found = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(found, text, lambda out, e: F.replace(out, e, F.coalesce(to(e), e)))


def _character(entity: Column) -> Column:
    """The character that a numeric entity names; null for none, U+FFFD for what is no character."""
    digits = F.regexp_extract(entity, r"&#[xX]?0*([0-9a-fA-F]*);", 1)
    code = F.when(F.lower(entity).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
    good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def _decoded(text: Column) -> Column:
    """Text with entities decoded, once: those of the ampersand come last."""
    named = F.from_json(F.lit(_NAMED), "map<string,string>")
    text = _each(text, r"&#(?:[0-9]+|[xX][0-9a-fA-F]+);", lambda e: F.when(e.rlike(_AMPERSAND), e).otherwise(_character(e)))
    text = _each(text, r"&[A-Za-z][A-Za-z0-9]*;", lambda e: F.element_at(named, e))
    return F.replace(F.regexp_replace(text, _AMPERSAND, "&"), F.lit("\u00a0"), F.lit(" "))


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def content(html: Column) -> Column:
    """HTML without comments and without the elements that hold no text."""
    html = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return html


def html_title(html: Column, fallback: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return F.coalesce(F.nullif(_collapsed(_decoded(F.regexp_replace(found, "<[^>]*>", " "))), F.lit("")), fallback)


def html_text(html: Column) -> Column:
    return _collapsed(_decoded(F.regexp_replace(content(html), "<[^>]*>", " ")))


def html_hrefs(html: Column) -> Column:
    """array<string>: link targets as written, outside of dropped elements."""
    found = F.regexp_extract_all(content(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.transform(found, lambda href: _decoded(F.regexp_replace(href, r"""^["']|["']$""", "")))


@F.arrow_udf(StringType())
def _resolve(base: pa.Array, href: pa.Array) -> pa.Array:
    out = []
    for b, h in zip(base.to_pylist(), href.to_pylist(), strict=True):
        try:
            url = urljoin(b, h)
            found = urlparse(url)
            out.append(url.split("#")[0] if found.scheme in ("http", "https") and found.netloc == urlparse(b).netloc else None)
        except (TypeError, ValueError):
            out.append(None)
    return pa.array(out, pa.string())


#: A link target joined to its page's URL; null unless it is http(s) and of the page's host. Arrow, as pandas
#: takes half of a worker's memory; called nondeterministic, else a filter of nulls makes a second worker a task.
resolve_url = _resolve.asNondeterministic()
