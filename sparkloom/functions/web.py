"""Addresses, dates, colours and labels as Column builders, and sound as Arrow functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def with_scheme(url: Column) -> Column:
    """A typed address as a url; https where it names no scheme."""
    text = F.trim(url)
    return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), text).when(text != "", F.concat(F.lit("https://"), text))


#: The parts of a reference, link elements with any quoting, parameters that only track, and what a url never shows as it is.
REFERENCE = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template|textarea|title)\b.*?(?:</(?:script|style|noscript|template|textarea|title)\s*>|\z)"
ANCHOR = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*>"""
HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
TRACKING = r"(?i)^(?:utm_|fbclid|gclid|ref(?:=|\z))"
ESCAPES = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E"}


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments; a path of a closing . or .. keeps the slash before it."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?\z") & (F.size(kept) > 1), "/").when(F.size(kept) == 1, "/").otherwise(""))


def staged(rows: DataFrame, steps: list[tuple[str, Column]], out: str) -> DataFrame:
    """rows with the last of the steps, each a column made of those before it, as ``out``.

    Written as one expression, each step would be repeated at all its uses. The closing explode of one value keeps filters on ``out`` from being pushed
    below the steps, which would write them out again.
    """
    kept = rows.columns
    for name, column in steps:
        rows = rows.withColumn(name, column)
    return rows.select(*kept, F.explode_outer(F.array(steps[-1][0])).alias(out))


def with_resolved(rows: DataFrame, reference: Column, base: Column, out: str) -> DataFrame:
    """rows with the http or https url, without fragment, that a reference means on the page ``base``; null for any other scheme, a null reference or base, and what names no host.

    Scheme and host are lower-cased, default ports and blanks around go, a back slash is a slash.
    """
    part = lambda url, k: F.regexp_extract(url, REFERENCE, k)
    said, scheme, own, relative, full, there = (F.col(f"__{c}") for c in ("said", "scheme", "own", "relative", "full", "there"))
    path, query, proto, host, whole = (F.col(f"__{c}") for c in ("path", "query", "proto", "host", "whole"))
    near = F.concat(F.regexp_replace(part(base, 3), r"[^/]*\z", ""), part(relative, 3))
    trimmed = F.regexp_replace(F.regexp_replace(reference, r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    escaped = F.concat(proto, F.lit("://"), host, whole, F.when(query == "?", "").otherwise(query))
    for character, escape in ESCAPES.items():
        escaped = F.replace(escaped, F.lit(character), F.lit(escape))
    steps = [
        ("__trimmed", trimmed),
        ("__said", F.concat(F.translate(F.regexp_extract("__trimmed", r"^[^?#]*", 0), "\\", "/"), F.regexp_extract("__trimmed", r"^[^?#]*(.*)", 1))),
        ("__scheme", F.lower(part(said, 1))),
        # http:path on an http page is relative; http:/x and http:///x name the host that follows
        ("__own", (scheme != "") & ((scheme != F.lower(part(base, 1))) | F.regexp_like(said, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:/")))),
        ("__relative", F.when(scheme != "", F.regexp_replace(said, r"^[^:]*:", "")).otherwise(said)),
        ("__full", F.when(own, F.concat(scheme, F.lit("://"), F.regexp_replace(relative, "^/*", ""))).when(relative.startswith("//"), F.concat(F.lower(part(base, 1)), F.lit(":"), relative))),
        ("__there", F.coalesce(full, base)),
        ("__path", F.when(full.isNotNull(), part(full, 3)).when(part(relative, 3) == "", part(base, 3)).when(part(relative, 3).startswith("/"), part(relative, 3)).otherwise(near)),
        ("__query", F.when(full.isNotNull(), part(full, 4)).when((part(relative, 3) == "") & (part(relative, 4) == ""), part(base, 4)).otherwise(part(relative, 4))),
        ("__proto", F.lower(part(there, 1))),
        ("__host", F.regexp_replace(F.lower(part(there, 2)), F.concat(F.when(proto == "http", r":(?:80)?").otherwise(r":(?:443)?"), F.lit(r"\z")), "")),
        ("__rooted", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))),
        ("__whole", F.when(path == "", F.lit("/")).otherwise(without_dots(F.col("__rooted")))),
        ("__url", F.when(proto.isin("http", "https") & (host != ""), escaped)),
    ]
    return staged(rows, steps, out)


def untracked(url: Column) -> Column:
    """A url without its fragment and tracking parameters; one that has none keeps its query as it is."""
    bare = F.substring_index(url, "#", 1)
    params = F.split(F.regexp_extract(bare, r"\?(.*)", 1), "&")
    kept = F.filter(params, lambda p: ~p.rlike(TRACKING))
    query = F.array_join(F.filter(kept, lambda p: p != ""), "&")
    return F.when(F.size(kept) == F.size(params), bare).otherwise(F.concat(F.substring_index(bare, "?", 1), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def hrefs(html: Column) -> Column:
    """The references of a page's links in page order, with character references decoded; comments and raw elements hold none."""
    anchors = F.regexp_extract_all(F.regexp_replace(F.coalesce(html, F.lit("")), UNREAD, " "), F.lit(ANCHOR), F.lit(0))
    named = F.filter(anchors, lambda x: x.rlike(HREF))
    plain = lambda x: F.concat(*(F.regexp_extract(x, HREF, k) for k in (1, 2, 3)))

    def decoded(x: Column) -> Column:
        for entity, character in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(character))
        return x

    return F.transform(named, lambda x: decoded(plain(x)))


def links(pages: DataFrame) -> DataFrame:
    """page_id, at and link: the urls that each of the pages (page_id, url, html) links to, each once, at its first place, without fragments and tracking parameters."""
    rows = pages.select("page_id", "url", F.posexplode(hrefs(F.col("html"))).alias("at", "__reference"))
    rows = with_resolved(rows, F.col("__reference"), F.col("url"), "__full").where("__full IS NOT NULL")
    return rows.select("page_id", "at", untracked(F.col("__full")).alias("link")).groupBy("page_id", "link").agg(F.min("at").alias("at"))


#: Names of meta elements that state a title, in order of preference, and separators in a title (those of the second kind stand between levels of a site).
TITLE_NAMES = "dc:title dcterm:title og:title weibo:article:title weibo:webpage:title title twitter:title".split()
TITLE_SEPARATORS, TITLE_LEVELS = r"\|\-–—\\/>»", r"\\/>»"
TITLE_LENGTH = 300


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; written out, it would be computed at each of its uses in f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def metas(html: Column) -> Column:
    """The page's meta elements."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<meta\s(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))


def meta(html: Column, name: str) -> Column:
    """The content of the page's first meta element of that name or property, whatever the order and quoting of its attributes; null without one."""
    return _named(metas(html), name)


def _named(elements: Column, name: str) -> Column:
    mine = F.filter(elements, lambda x: x.rlike(rf"""(?is)\s(?:name|property)\s*=\s*["']?\s*{name}\s*(?:["'\s/>])"""))
    content = r"""(?is)\scontent\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return bound(F.get(mine, F.lit(0)), lambda first: F.concat(*(F.regexp_extract(first, content, k) for k in (1, 2, 3))))


def _words(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+"))


def shown_title(title: Column) -> Column:
    """The part of a <title> that names the page: without the site's name after the last separator, unless too little is left of it."""
    return bound(F.trim(F.regexp_replace(title, r"\s+", " ")), _shown)


def _shown(squeezed: Column) -> Column:
    parted = squeezed.rlike(rf" [{TITLE_SEPARATORS}] ")
    before = F.regexp_replace(squeezed, rf"^(.*)[{TITLE_SEPARATORS}] .*$", "$1")
    after = F.regexp_replace(squeezed, rf"^[^{TITLE_SEPARATORS}]*[{TITLE_SEPARATORS}](.*)$", "$1")
    colon = F.contains(squeezed, F.lit(": "))
    last, rest = F.substring_index(squeezed, ":", -1), F.regexp_replace(squeezed, r"^[^:]*:", "")
    named = F.when(_words(last) >= 3, last).when(_words(F.substring_index(squeezed, ":", 1)) > 5, squeezed).otherwise(rest)
    cut = F.trim(F.when(parted, F.when(_words(before) < 3, after).otherwise(before)).when(colon, named).otherwise(squeezed))
    levels = squeezed.rlike(rf" [{TITLE_LEVELS}] ")
    plain = F.regexp_replace(squeezed, rf"[{TITLE_SEPARATORS}]+", "")
    return bound(cut, lambda c: F.when((_words(c) <= 4) & (~levels | (_words(c) != _words(plain) - 1)), squeezed).otherwise(c))


def title(html: Column, url: Column) -> Column:
    """A page's title: that of its meta elements, of <title>, or the path of its url; TITLE_LENGTH characters at most."""
    filled = lambda x: bound(F.trim(F.regexp_replace(x, r"\s+", " ")), lambda s: F.when(s != "", s))
    own = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    path = F.coalesce(F.nullif(F.regexp_extract(url, REFERENCE, 3), F.lit("")), F.lit("/"))
    said = bound(metas(html), lambda elements: F.coalesce(*(filled(_named(elements, n)) for n in TITLE_NAMES)))
    return F.substring(F.coalesce(said, filled(shown_title(own)), path), 1, TITLE_LENGTH)


def host_allowed(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains, or below one written as *.domain."""
    low = F.lower(host)
    tests = [low.endswith(d[1:].lower()) if d.startswith("*.") else low == d.lower() for d in domains]
    out = F.lit(False)
    for x in tests:
        out = out | x
    return out


def private_ip(address: Column) -> Column:
    """Whether an IPv4 address is private, local, shared or reserved; true for what is no address."""
    parts = F.transform(F.split(address, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    sound = (F.size(parts) == 4) & F.forall(parts, lambda x: x.between(0, 255))
    inside = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.between(18, 19))
    return F.coalesce(~sound | inside, F.lit(True))


#: Where a page states its date, in order of preference.
DATES = [
    r"""(?is)<meta[^>]+property=["']article:published_time["'][^>]+content=["']([^"']+)""", r"""(?is)<meta[^>]+name=["']date["'][^>]+content=["']([^"']+)""",
    r"""(?is)<meta[^>]+itemprop=["']datePublished["'][^>]+content=["']([^"']+)""", r"""(?is)<time[^>]+datetime=["']([^"']+)""",
]


def published(html: Column) -> Column:
    """The page's first stated date that can be read, as an instant."""
    return F.coalesce(*(F.try_to_timestamp(F.nullif(F.regexp_extract(html, p, 1), F.lit(""))) for p in DATES))


def like_pattern(query: Column) -> Column:
    return F.concat(F.lit("%"), F.regexp_replace(query, r"([%_\\])", r"\\$1"), F.lit("%"))


def clock(minutes: Column) -> Column:
    return F.concat_ws(":", F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("string"), 2, "0"))


def minutes(clock_: Column) -> Column:
    """Minutes of HH:MM; null for anything else."""
    h, m = (F.nullif(F.regexp_extract(clock_, r"^([01]?\d|2[0-4]):([0-5]\d)\z", k), F.lit("")).cast("int") for k in (1, 2))
    return F.when(h * 60 + m <= 1440, h * 60 + m)


def luminance(color: Column) -> Column:
    """Relative luminance of #rrggbb, 0 to 1."""
    part = lambda a: F.conv(F.substring(color, a, 2), 16, 10).cast("double") / 255
    line = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * line(part(2)) + 0.7152 * line(part(4)) + 0.0722 * line(part(6))


def byte_label(size: Column) -> Column:
    k = F.lit(1024.0)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, F.concat(F.round(size / k, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(size / k / k, 1).cast("string"), F.lit(" MB")))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, a number or an HTTP date; 300 at most, null where it is neither."""
    number = F.try_to_number(F.trim(header), F.lit("999999")).cast("double")
    date = F.timestamp_diff("SECOND", now, F.try_to_timestamp(F.trim(F.substring(F.trim(header), 6, 100)), F.lit("dd MMM yyyy HH:mm:ss z"))).cast("double")
    said = F.coalesce(number, date)
    return F.when(said.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(300.0), said)))  # least() alone would skip a null


def pcm_rms(pcm: Column) -> Column:
    """Loudness of 16-bit little-endian samples, 0 to 1; 0 for none."""

    def run(column: pd.Series) -> pd.Series:
        of = lambda b: float(np.sqrt(np.mean((np.frombuffer(b[: len(b) // 2 * 2], "<i2") / 32768.0) ** 2))) if b and len(b) > 1 else 0.0
        return column.map(of)

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(pcm)


IMAGE, LINK = r"""(?is)<img\s(?:[^>"']|"[^"]*"|'[^']*')*>""", r"""(?is)<link\s(?:[^>"']|"[^"]*"|'[^']*')*>"""


def attribute(element: Column, name: str) -> Column:
    """The value of an element's attribute, whatever its quoting; null without it."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(element.rlike(pattern), F.concat(*(F.regexp_extract(element, pattern, k) for k in (1, 2, 3))))


def brands(pages: DataFrame) -> DataFrame:
    """page_id, name, logo and icon of the site, as each of the pages (page_id, url, html) tells them; a logo drawn in the page itself is not looked for.

    The name is og:site_name, else the title up to its first separator, else the host. The logo is the first image that calls itself one. An icon
    for touch screens comes before a scalable one, that before any other, and /favicon.ico serves where none is named.
    """
    html, url, image, links = (F.col(c) for c in ("html", "url", "__image", "__links"))
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    own = F.get(F.split(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"[|–—-]", 2), F.lit(0))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")
    named = lambda x: F.concat_ws(" ", *(attribute(x, a) for a in ("class", "id", "alt", "data-testid"))).rlike("(?i)logo|brand")
    first = F.get(F.split(F.trim(F.get(F.split(attribute(image, "srcset"), ","), F.lit(0))), r"\s+"), F.lit(0))
    source = F.coalesce(*(F.nullif(x, F.lit("")) for x in (attribute(image, "src"), attribute(image, "data-src"), first)))
    of = lambda x: F.struct(F.lower(attribute(x, "rel")).alias("rel"), attribute(x, "type").alias("type"), attribute(x, "href").alias("href"))
    icon = lambda x: F.array_contains(F.split(x["rel"], r"\s+"), "icon")
    orders = [lambda x: x["rel"] == "apple-touch-icon", lambda x: icon(x) & (x["type"] == "image/svg+xml"), lambda x: icon(x) & x["href"].endswith(".svg"), icon]
    first_of = lambda o: F.get(F.filter(links, lambda x: o(x) & x["href"].isNotNull()), F.lit(0))["href"]
    rows = pages.select("page_id", "url", F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.select(
        "page_id", "url", F.coalesce(filled(meta(html, "og:site_name")), filled(own), host).alias("name"), F.get(F.filter(F.regexp_extract_all(html, F.lit(IMAGE), F.lit(0)), named), F.lit(0)).alias("__image"),
        F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), of).alias("__links"),
    )
    rows = rows.select("page_id", "url", "name", source.alias("__source"), F.coalesce(*map(first_of, orders)).alias("__icon"))
    rows = with_resolved(with_resolved(with_resolved(rows, F.col("__source"), url, "logo"), F.col("__icon"), url, "__given"), F.lit("/favicon.ico"), url, "__plain")
    return rows.select("page_id", "name", "logo", F.coalesce("__given", "__plain").alias("icon"))


#: What stands for a color that is none or stays too light, the least light of a ground for dark text, the most light of an accent on white, and steps towards it.
DARK, LIGHT_GROUND, ACCENT, STEPS, SHADE = "#0f1f16", 0.55, 0.32, 12, 0.8


def full_hex(color: Column) -> Column:
    """#rrggbb of a color of three or six digits, with or without #; null for anything else."""
    digits = F.lower(F.regexp_replace(F.trim(color), "^#", ""))
    return F.concat(F.lit("#"), F.when(digits.rlike(r"^[0-9a-f]{6}\z"), digits).when(digits.rlike(r"^[0-9a-f]{3}\z"), F.regexp_replace(digits, "(.)(.)(.)", "$1$1$2$2$3$3")))


def text_on(color: Column) -> Column:
    """Dark or white text, whichever is read better on the color."""
    return F.when(luminance(full_hex(color)) > LIGHT_GROUND, DARK).otherwise("#ffffff")


def accent(color: Column) -> Column:
    """The color, its channels scaled down until it is dark enough to be read on white; DARK where it never is, or is no color."""
    full = full_hex(color)
    part = lambda a: F.conv(F.substring(full, a, 2), 16, 10).cast("double")
    two = lambda x: F.lpad(F.lower(F.hex(F.floor(x + 0.5).cast("long"))), 2, "0")
    shades = F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda k: F.concat(F.lit("#"), *(two(part(a) * F.pow(F.lit(SHADE), k)) for a in (2, 4, 6))))
    return F.coalesce(F.get(F.filter(shades, lambda s: luminance(s) <= ACCENT), F.lit(0)), F.lit(DARK))


#: Units of relative times, with their seconds and the names of one of them gone by and to come.
UNITS = [("year", 31_536_000, "last year", "next year"), ("month", 2_592_000, "last month", "next month"), ("week", 604_800, "last week", "next week"), ("day", 86_400, "yesterday", "tomorrow"), ("hour", 3_600, "1 hour ago", "in 1 hour"), ("minute", 60, "1 minute ago", "in 1 minute")]


def relative_time(at: Column, now: Column) -> Column:
    """How long ago, or how far ahead, an instant is, in the largest unit that it fills."""
    seconds = F.floor((F.unix_micros(at.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6 + 0.5)
    out = F.lit("just now")
    for unit, size, gone, coming in reversed(UNITS):
        n = F.floor(seconds / size + 0.5).cast("long")
        many = F.when(n < 0, F.concat((-n).cast("string"), F.lit(f" {unit}s ago"))).otherwise(F.concat(F.lit("in "), n.cast("string"), F.lit(f" {unit}s")))
        out = F.when(F.abs(seconds) >= size, F.when(n == -1, gone).when(n == 1, coming).otherwise(many)).otherwise(out)
    return F.when(at.isNotNull(), out)


def message_time(at: Column, now: Column) -> Column:
    """The clock of a message of today, with its day of an earlier one, and with the year of another one."""
    clock = F.date_format(at, "HH:mm")
    day, today = F.to_date(at), F.to_date(now)
    dated = F.date_format(at, "d MMM")
    year = F.when(F.year(at) == F.year(now), dated).otherwise(F.concat(dated, F.date_format(at, " yyyy")))
    return F.when(day == today, clock).when(day == F.date_sub(today, 1), F.concat(F.lit("Yesterday "), clock)).otherwise(F.concat(year, F.lit(" "), clock))


def pcm_millis(pcm: Column, rate: int = 16_000) -> Column:
    """How long 16-bit mono samples last."""
    return F.floor(F.octet_length(pcm) / 2 / rate * 1000 + 0.5).cast("long")


def _little(value: Column, width: int) -> Column:
    """A number as that many bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.concat(*(F.unhex(F.substring(digits, 2 * k + 1, 2)) for k in reversed(range(width))))


def wav(pcm: Column, rate: int = 16_000) -> Column:
    """16-bit mono samples as a WAV file."""
    size = F.octet_length(pcm)
    n = lambda value, width: _little(F.lit(value), width)
    text = lambda s: F.lit(s).cast("binary")
    return F.concat(text("RIFF"), _little(size + 36, 4), text("WAVEfmt "), n(16, 4), n(1, 2), n(1, 2), n(rate, 4), n(rate * 2, 4), n(2, 2), n(16, 2), text("data"), _little(size, 4), pcm)


def pcm_of(samples: Column) -> Column:
    """Samples of -1 to 1 as 16-bit little-endian ones; what lies beyond is cut."""
    cut = F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    whole = F.transform(cut, lambda x: F.when(x < 0, x * 32768).otherwise(x * 32767).cast("int"))
    # two digits of a byte at a time, the low byte first
    digits = F.transform(whole, lambda x: F.lpad(F.hex((x.bitwiseAND(F.lit(0xFFFF))).cast("long")), 4, "0"))
    return F.unhex(F.array_join(F.transform(digits, lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))), ""))
