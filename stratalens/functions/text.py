"""Text functions as column expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import Walked, has

#: Characters that count as white space, Unicode included.
_SPACES = r"\s\p{Z}\x1c-\x1f\x85"
SPACE = f"[{_SPACES}]+"
#: White space that isn't a single blank already.
_UNEVEN = f"[{_SPACES}&&[^ ]][{_SPACES}]*| [{_SPACES}]+"
# Fixed value: phrases that cleaning deletes.
BOILERPLATE = "(?i)Cookie Policy|Privacy Policy|Terms of Use"

MAX_CHARS, OVERLAP = 1800, 250


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}|{SPACE}$", "")


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, _UNEVEN, " ")


def clean(x: Column) -> Column:
    """White space collapsed, boilerplate deleted, ends stripped; null gives ''.  A second pass may change it again."""
    return F.coalesce(F.trim(F.regexp_replace(collapse(x), BOILERPLATE, "")), F.lit(""))


def content_hash(x: Column) -> Column:
    """SHA-256 of the cleaned text in lower case."""
    return hashed(F.lower(clean(x)))


def hashed(lowered: Column) -> Column:
    return F.sha2(lowered.cast("binary"), 256)


def chunks(x: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of the cleaned text, in order; none for an empty text.

    The text is cleaned and cut into pieces of ``max_chars - overlap`` once, and a
    window is a piece with the beginning of the next: time is linear in the text.
    """
    step = max_chars - overlap
    if not 0 <= overlap <= step:
        raise ValueError("windows may overlap by half of their size at most")
    pieces = F.regexp_extract_all(clean(x), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def windows(ps: Column) -> Column:
        n = F.size(ps)
        covered = (F.length(F.try_element_at(ps, n)) <= overlap) & (n > 1)  # the window before holds the last piece
        heads = F.slice(ps, F.lit(1), n - covered.cast("int"))
        return F.transform(heads, lambda p, i: F.trim(F.concat(p, F.substring(F.coalesce(F.get(ps, i + 1), F.lit("")), 1, overlap))))

    # a lambda's variable is a value: it isn't computed again for each window
    return F.flatten(F.transform(F.array(pieces), lambda ps: F.when(F.size(ps) > 0, windows(ps)).otherwise(F.array().cast("array<string>"))))


def token_count(x: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(x, F.lit(f"[^{_SPACES}]+"))


def short(x: Column, n: int) -> Column:
    """At most about ``n`` characters: cut, the last partial word dropped, dots added."""
    text = flat(x)
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(F.substring(text, 1, n), " [^ ]*$", ""), F.lit("..."))).otherwise(text)


def contains_any(lowered: Column | Walked, keywords) -> Column:
    """Whether any keyword (in lower case) is a substring."""
    out = F.lit(False)
    for k in keywords:
        out = out | has(lowered, k)
    return out


def count_terms(lowered: Column | Walked, terms) -> Column:
    """How many of the terms are substrings."""
    out = F.lit(0)
    for t in terms:
        out = out + has(lowered, t).cast("int")
    return out


def flat(x: Column) -> Column:
    """One line: white space collapsed, ends stripped, null as ''."""
    return F.trim(collapse(F.coalesce(x, F.lit(""))))


def snippet_of(line: Column, lowered: Column, keywords, size: int = 550, before: int = 140) -> Column:
    """Part of a ``flat`` line around the earliest keyword, or its beginning."""
    places = F.array(*[F.nullif(F.instr(lowered, k.lower()), F.lit(0)) for k in keywords])
    return F.substring(line, F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - before, F.lit(1)), F.lit(size))


def snippet(x: Column, keywords, size: int = 550, before: int = 140) -> Column:
    """Text around the earliest keyword, or the beginning."""
    return snippet_of(flat(x), F.lower(flat(x)), keywords, size, before)


#: A character reference of a page, whether it means anything or not.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Code points above which there are no characters, and what stands for one that can't be.
_LAST, _LOST = 0x10FFFF, "\ufffd"


def _numeric() -> dict[int, str]:
    """What numeric references of control characters mean: the old Windows characters, or nothing."""
    out = {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)} | {0: _LOST, 0x0D: "\r"}
    nothing = [*range(1, 9), 0x0B, *range(0x0E, 0x20), 0x7F, *range(0xFDD0, 0xFDF0), *(p << 16 | e for p in range(17) for e in (0xFFFE, 0xFFFF))]
    return dict.fromkeys(nothing, "") | out


def _map(pairs: dict) -> Column:
    """A constant map of strings, made from one literal."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _meaning(reference: Column) -> Column:
    """What one reference stands for; itself, if it means nothing."""
    digits = F.regexp_extract(reference, "^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
    is_hex = F.rlike(reference, F.lit("^&#[xX]"))
    code = F.when(digits == "", 0).when(F.length(digits) > 8, _LAST + 1)
    code = code.when(is_hex, F.conv(digits, 16, 10).cast("long")).otherwise(F.conv(digits, 10, 10).cast("long"))
    special = _map(_numeric())[code.cast("string")]
    number = F.when((code > _LAST) | code.between(0xD800, 0xDFFF), _LOST).otherwise(F.coalesce(special, _character(code)))
    names, whole = _map(html5), F.substring(reference, F.lit(2), F.length(reference))
    # names that need no semicolon also count at the beginning of others, the longest first
    open_names = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    head = F.regexp_extract(reference, f"^&({'|'.join(open_names)})", 1)
    named = F.coalesce(names[whole], F.when(head != "", F.concat(names[head], F.substring(whole, F.length(head) + 1, F.length(whole)))), reference)
    return F.when(F.startswith(reference, F.lit("&#")), number).otherwise(named)


def unescape(x: Column) -> Column:
    """All HTML character references, numeric and named, in one pass from left to right: what comes out isn't read again.

    The table of names is Python's own copy of the standard's.  A reference without its
    semicolon counts where the standard lets it.
    """
    between, found = F.split(x, _REFERENCE, -1), F.regexp_extract_all(x, F.lit(_REFERENCE), F.lit(0))
    decoded = F.transform(found, lambda r, i: F.concat(_meaning(r), F.get(between, i + 1)))
    return F.when(F.contains(x, F.lit("&")), F.concat(F.get(between, F.lit(0)), F.array_join(decoded, ""))).otherwise(x)


#: References that a plain reading of a page knows, each with its semicolon; the ampersand last, so that what comes out isn't read again.
COMMON_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape_common(x: Column) -> Column:
    """``COMMON_REFERENCES`` only: any other, and one that is cut off before its semicolon, stays as it is."""
    for name, mark in COMMON_REFERENCES:
        x = F.replace(x, F.lit(name), F.lit(mark))
    return x


def escape(x: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(mark), F.lit(name))
    return x


def flatten_markdown(x: Column) -> Column:
    return F.replace(F.replace(escape(x), F.lit("\n"), F.lit("<br>")), F.lit("**"), F.lit(""))


def strip_thinking(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?is)<think>.*?</think>", ""))


def blob(columns: dict[str, Column] | list[Column]) -> Column:
    """Columns joined by spaces in lower case, null as ''."""
    parts = columns.values() if isinstance(columns, dict) else columns
    return F.lower(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in parts]))
