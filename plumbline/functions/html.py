"""Column expressions over raw html: tags, attributes, blocks, text and link resolution; Python only in the tag table function."""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import col

SCRIPTS = r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>"
COMMENTS, TAGS, SPACE = r"(?s)<!--.*?-->", r"(?s)<[^>]+>", r"[ \t\n\r\f\x{a0}]+"
#: Named references that pages use most; numeric ones are decoded by number.
ENTITIES = (
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&pound;", "£"),
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
)


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)


def _numeric(x: Column) -> Column:
    """Decimal and hexadecimal character references, each part after a reference mark decoded by itself."""
    code = r"^(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));"

    def one(p: Column) -> Column:
        hexadecimal, decimal = F.regexp_extract(p, code, 1), F.regexp_extract(p, code, 2)
        number = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).otherwise(decimal).cast("int")
        # UTF-32 of the code point, in four bytes
        char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        good = lambda n: n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return let(number, lambda n: F.when(good(n), F.concat(char(n), F.regexp_replace(p, code, ""))).otherwise(F.concat(F.lit("&#"), p)))

    return let(F.split(x, "&#"), lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: one(p)), "")))


def decoded(x: Column | str) -> Column:
    """Character references replaced, ``&amp;`` last."""

    quoted = lambda t: "'" + t.replace("'", r"\'") + "'"
    table = ", ".join(f"named_struct('a', {quoted(a)}, 'b', {quoted(b)})" for a, b in (*ENTITIES, ("&amp;", "&")))

    def every(v: Column) -> Column:
        # one pass over a list, which keeps the plan small
        plain = F.when(F.contains(v, F.lit("&#")), _numeric(v)).otherwise(v)
        return F.aggregate(F.expr(f"array({table})"), plain, lambda out, e: F.replace(out, e["a"], e["b"]))

    return let(col(x), lambda v: F.when(F.contains(v, F.lit("&")), every(v)).otherwise(v))


def clean(x: Column | str) -> Column:
    """Decoded, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(decoded(x), SPACE, " "))


def visible(x: Column | str) -> Column:
    """Text of a piece of html: scripts, styles, comments and tags out."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(x), SCRIPTS, " "), COMMENTS, " "), TAGS, " ")
    return clean(bare)


def inner(x: Column) -> Column:
    return clean(F.regexp_replace(x, TAGS, " "))


def tags(html: Column | str, names: str) -> Column:
    """Opening tags, whole, of the given names (a regular expression), quotes respected."""
    return F.regexp_extract_all(col(html), F.lit(rf"""(?is)<(?:{names})(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in any of its three spellings, not yet decoded; empty if it has none."""
    pattern = rf"""(?is)^<\w+(?:\s+(?!{name}[\s=>/])[^\s=>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?|/)*\s+{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return F.trim(F.regexp_replace(F.regexp_extract(tag, pattern, 1), r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2"))


def has_attribute(tag: Column, name: str) -> Column:
    values_out = F.regexp_replace(tag, r"""(?s)=\s*(?:"[^"]*"|'[^']*')""", "= ")
    return values_out.rlike(rf"(?i)\s{name}(?=[\s=>/])")


def blocks(html: Column | str, name: str) -> Column:
    """Inner html of the elements of one name that do not nest in themselves."""
    return F.regexp_extract_all(col(html), F.lit(rf"""(?is)<{name}(?=[\s>])(?:[^>"']|"[^"]*"|'[^']*')*>(.*?)</{name}\s*>"""), F.lit(1))


def body_of(html: Column | str) -> Column:
    """What is inside ``body``; without one, everything but the head and the title."""
    h = col(html)
    inside = F.regexp_replace(F.regexp_extract(h, r"(?is)<body(?=[\s>])[^>]*>(.*)", 1), r"(?is)</body\s*>.*$", "")
    rest = F.regexp_replace(F.regexp_replace(h, r"(?is)<head(?=[\s>]).*?</head\s*>", " "), r"(?is)<title\b.*?</title\s*>", " ")
    return F.when(h.rlike(r"(?i)<body[\s>]"), inside).otherwise(rest)


def resolve(base: Column | str, href: Column | str) -> Column:
    """Absolute URL of a link on a page, dot segments removed, without fragment; null if it is none over http(s)."""
    b = col(base)
    origin = F.regexp_extract(b, r"^(?i)(https?://[^/?#]+)", 1)
    path = F.regexp_extract(b, r"^(?i)https?://[^/?#]+([^?#]*)", 1)

    def absolute(h: Column) -> Column:
        folder = F.concat(F.lit("/"), F.regexp_extract(path, "^/?(.*/)?[^/]*$", 1))
        return (
            F.when(h.rlike("(?i)^https?://[^/]"), h)
            .when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^(?i)(https?:)//", 1), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), h))
            .when(h == "", F.regexp_replace(b, "#.*$", ""))
            .otherwise(F.concat(origin, folder, h))
        )

    def tidy(whole: Column) -> Column:
        top = F.regexp_extract(whole, r"^(?i)(https?://[^/?#]+)", 1)
        rest = F.regexp_extract(whole, r"^(?i)https?://[^/?#]+/?([^?]*)", 1)
        query = F.regexp_extract(whole, r"(\?.*)$", 1)
        plain = F.concat(F.lower(top), F.lit("/"), rest, query)
        steps = F.split(F.regexp_replace(F.concat(F.lit("/"), rest), r"/(\.|\.\.)$", "/$1/"), "/")
        dots = let(steps, lambda p: F.aggregate(
            F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
        ))
        return F.when(whole.isNull() | (top == ""), F.lit(None).cast("string")).when(F.contains(rest, F.lit(".")) & rest.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.lower(top), F.lit("/"), F.array_join(dots, "/"), query)).otherwise(plain)

    return let(F.regexp_replace(F.trim(col(href)), "#.*$", ""), lambda h: let(absolute(h), tidy))


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []

    def handle_starttag(self, tag, attrs):
        self.found.append([tag, {k: v or "" for k, v in attrs}, ""])

    handle_startendtag = handle_starttag

    def handle_data(self, data):
        if self.found:
            self.found[-1][2] += data


class HtmlTags:
    """Handler of the table function ``html_tags``: one row for each opening tag, with its attributes and the text up to the next tag."""

    def eval(self, html: str):
        if html:
            p = _Tags()
            p.feed(html)
            p.close()
            for pos, (name, attrs, text) in enumerate(p.found):
                yield pos, name, attrs, " ".join(_html.unescape(text).split())


def register_html_tags(spark: SparkSession) -> None:
    """Make ``html_tags(html)`` known to SQL: ``select p.page_id, t.* from pages p, lateral html_tags(p.html) t``."""
    spark.udtf.register("html_tags", F.udtf(HtmlTags, returnType="pos int, name string, attrs map<string,string>, text string", useArrow=True))
