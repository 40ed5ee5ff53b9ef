"""Text, address and similarity functions as Column expressions."""

from __future__ import annotations

import functools
import html.entities
import ipaddress
import json
import re

from pyspark.sql import Column, functions as F, types as T

from cairn import lexicon as L

#: White space as Unicode has it, the ideographic space included.
SPACE = r"(?U)\s+"


def quoted(words: list[str]) -> str:
    """A pattern that finds any of the words."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


@functools.lru_cache(maxsize=1)
def _names() -> str:
    """The names of HTML 5's character references as JSON, by their first letter: a map of 52 maps, some forty names each."""
    by: dict[str, dict[str, str]] = {}
    for name, value in html.entities.html5.items():
        by.setdefault(name[0], {})[name] = value
    return json.dumps(by)


def _value(name: Column) -> Column:
    """What a name stands for, with or without its semicolon as the table has it; null for what is none."""
    table = F.from_json(F.lit(_names()), T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))
    return F.try_element_at(F.try_element_at(table, F.substring(name, 1, 1)), name)


#: Names that stand for a character without a semicolon too have so many letters at most.
_SHORT = max(len(n) for n in html.entities.html5 if not n.endswith(";"))
#: Numbers from 128 to 159, which stand for what an old Windows code page has there.
_WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}


def _number(ref: Column) -> Column:
    """What ``#`` and a number stand for: nothing for what is no character, a replacement character for what no text may hold."""
    def number(digits: Column) -> Column:
        return F.when(digits == "", F.lit(0)).when(F.length(digits) > 7, 0x110000).otherwise(F.when(ref.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int"))

    return _with(_with(F.regexp_extract(ref, r"^#[xX]?0*([0-9a-fA-F]*);?$", 1), number), _character)


def _character(n: Column) -> Column:
    wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    windows = F.element_at(F.create_map(*[F.lit(x) for kv in _WINDOWS.items() for x in kv]), n)
    bad = ((n >= 1) & (n <= 8)) | (n == 11) | ((n >= 14) & (n <= 31)) | ((n >= 127) & (n <= 159)) | ((n >= 0xFDD0) & (n <= 0xFDEF)) | (n % 65536 >= 65534)
    return F.when((n == 0) | (n > 0x10FFFF) | ((n >= 0xD800) & (n <= 0xDFFF)), "\ufffd").when(windows.isNotNull(), windows).when(n == 13, "\r").when(bad & ~n.isin(129, 141, 143, 144, 157), "").otherwise(wide)


def unescape(text: Column) -> Column:
    """All character references of HTML 5 decoded: every name, the longest that fits where no semicolon ends it, and every number.

    One pass over the pieces between ampersands, so what a reference spells is not
    read again; texts without any are left alone.
    """
    def decoded(p: Column) -> Column:
        return _with(F.regexp_extract(p, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1), lambda ref: F.concat(spelled(ref), F.substr(p, F.length(ref) + 1)))

    def spelled(ref: Column) -> Column:
        part = [F.when(F.length(ref) > k, F.concat(_value(F.substring(ref, 1, k)), F.substr(ref, F.lit(k + 1)))) for k in range(_SHORT, 1, -1)]
        return F.when(ref == "", "&").when(ref.startswith("#"), _number(ref)).otherwise(F.coalesce(_value(ref), *part, F.concat(F.lit("&"), ref)))

    def whole(t: Column) -> Column:
        pieces = F.split(t, "&")
        rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.when(t.contains("&"), F.concat(F.element_at(pieces, 1), F.array_join(F.transform(rest, decoded), ""))).otherwise(t)

    return _with(text, whole)


def unescape_only(names: dict[str, str]):
    """A decoder of these references alone, each with its semicolon; ``amp`` comes last, so what it spells is not read again."""
    def decode(text: Column) -> Column:
        for name in sorted(names, key=lambda n: n == "amp"):
            text = F.replace(text, F.lit(f"&{name};"), F.lit(names[name]))
        return text

    return decode


def _with(value: Column, rule) -> Column:
    """``rule`` of a value that it names several times, computed once."""
    return F.transform(F.array(value), rule)[0]


def escape(text: Column, apostrophe: str = "&#x27;") -> Column:
    for value, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        text = F.replace(text, F.lit(value), F.lit(name))
    return text


def stripped_ends(text: Column) -> Column:
    """Without the white space, as Unicode has it, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


def clean_markup_first(text: Column, decode=unescape) -> Column:
    """The daily profile: tags to spaces, then references, then white space to one space."""
    return one_space(decode(F.regexp_replace(text, "<[^>]+>", " ")))


def clean_references_first(text: Column, decode=unescape) -> Column:
    """The archive profile: references first, tags to nothing, then white space to one space."""
    return one_space(F.regexp_replace(decode(text), "<[^>]+>", ""))


def stripped(text: Column, size: int = 300) -> Column:
    return F.substring(clean_markup_first(text), 1, size)


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"^https?://([^/]+)", 1)
    return F.when(found != "", found).otherwise(url)


def safe_url(url: Column) -> Column:
    """The trimmed address if it is http or https, else the empty text."""
    u = stripped_ends(F.coalesce(url, F.lit("")))
    return F.when(u.rlike("^(?i)https?://"), u).otherwise("")


def absolute_url(base: Column, href: Column) -> Column:
    """An address as it is, below the base's host, or put behind the base."""
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), href))


def literal_host_is_public(url: Column) -> Column:
    """For addresses whose host is a dotted number: whether it is outside the closed ranges; null for names.

    ``operators.addresses`` judges names by what they resolve to, and colon addresses.
    """
    h = F.regexp_extract(url, r"^https?://(?:[^@/]*@)?(\d+\.\d+\.\d+\.\d+)(?::\d+)?(?:/|$)", 1)
    part = F.split(h, r"\.")
    number = ((part[0].try_cast("long") * 256 + part[1].try_cast("long")) * 256 + part[2].try_cast("long")) * 256 + part[3].try_cast("long")

    def public(n: Column) -> Column:
        within = lambda ranges: functools.reduce(lambda a, b: a | b, [n.between(int(r[0]), int(r[-1])) for r in map(ipaddress.ip_network, ranges) if r.version == 4])
        return within(L.OPEN_RANGES) | ~within(L.CLOSED_RANGES)

    return F.when(h == "", F.lit(None)).otherwise(_with(number, public))


def bump_version(version: Column) -> Column:
    """The third number raised by one; anything else becomes 2.3.0."""
    n = F.split(version, r"\.")
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.concat_ws(".", n[0], n[1], (F.try_element_at(n, F.lit(3)).try_cast("int") + 1).cast("string"))).otherwise("2.3.0")


def checksum(text: Column) -> Column:
    """The sum of the code points."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda s, c: s + c)


def pick(text: Column, choices: list[str]) -> Column:
    """One of the choices, always the same for a text."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (checksum(text) % len(choices) + 1).cast("int"))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer, letters in lower case; equal texts 1, an empty one 0."""
    a, b = F.lower(a), F.lower(b)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def character_jaccard(a: Column, b: Column) -> Column:
    """Share of common characters, case counted; 0 if either text is empty or null."""
    x, y = characters(a), characters(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(F.coalesce(F.length(a), F.lit(0)) * F.coalesce(F.length(b), F.lit(0)) == 0, 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def plain_title(title: Column) -> Column:
    """For comparing: lower case, without white space, punctuation and digits."""
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)[\s\p{Punct}\p{P}]|[0-9]", "")


def tags(text: Column) -> Column:
    """A comma list as an array of trimmed items."""
    return F.filter(F.transform(F.split(text, ","), stripped_ends), lambda t: t != "")


def unwrap_jsonp(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)jQuery\w*\((.*)\)", 1), F.lit(""))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))
