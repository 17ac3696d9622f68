"""Display and text helpers as Column expressions (no Python UDFs)."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace sets, derived by rule: Python's str.strip() / split() use the
# characters for which str.isspace() holds; the browser's trim and \s use the
# same set without the four ASCII separators and NEL, plus the BOM.
PY_WS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
JS_WS = "".join(ch for ch in PY_WS if ch not in "\x1c\x1d\x1e\x1f\x85") + "\ufeff"


def char_class(chars: str, negate: bool = False) -> str:
    """A regex character class valid in Java regex and RE2 (oracles reuse it)."""
    body = "".join(f"\\x{{{ord(ch):X}}}" for ch in chars)
    return f"[{'^' if negate else ''}{body}]"


WS = char_class(JS_WS)
NWS = char_class(JS_WS, negate=True)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    """The browser's ``String.trim()``: a character-set trim, no regex."""
    return F.btrim(_col(c), F.lit(JS_WS))


# --------------------------------------------------------------------- C23
def truncate_words(c: Column | str, n: int = 10) -> Column:
    """First ``n`` whitespace-separated words joined by one space plus '...';
    text with at most ``n`` words is returned unchanged; NULL / '' -> '-'.

    Only the first ``n + 1`` words decide the result, so one anchored regex
    reads them and stops: the cost does not grow with the text's length, and
    the result is the same as splitting the whole text."""
    s = _col(c)
    pat = f"^{WS}*({NWS}+(?:{WS}+{NWS}+){{0,{n - 1}}})({WS}+{NWS})?"
    head = F.regexp_extract(s, pat, 1)
    more = F.regexp_extract(s, pat, 2) != ""
    cut = F.concat(F.regexp_replace(head, f"{WS}+", " "), F.lit("..."))
    return F.when(s.isNull() | (s == ""), F.lit("-")).when(more, cut).otherwise(s)


# --------------------------------------------------------------------- C24
def percent_text(c: Column | str, decimals: int = 2, null_text: str = "-") -> Column:
    """x * 100 with ``decimals`` places and a '%' sign; rounding is done on a
    decimal (half-up); NULL, and values no decimal can hold (NaN, infinite, 28
    digits before the point), -> ``null_text``."""
    x = _col(c).cast("double") * 100
    d = F.round(x.try_cast("decimal(38,10)"), decimals).try_cast(f"decimal(38,{decimals})")
    return F.when(d.isNull(), F.lit(null_text)).otherwise(F.concat(d.cast("string"), F.lit("%")))


def share_text(c: Column | str) -> Column:
    """Thousands separators, at most 2 decimals, '-' for NULL."""
    x = _col(c).try_cast("decimal(38,2)")
    return F.when(x.isNull(), F.lit("-")).otherwise(F.call_function("format_number", x, F.lit("#,##0.##")))


# --------------------------------------------------------------------- C25
def row_key(account_id: Column | str | None, hash_key: Column | str | None, index: Column | str) -> Column:
    """``acc_<id>`` else ``hash_<hash>`` else ``idx_<n>``; characters outside
    ``[a-zA-Z0-9_.:-]`` become ``_``."""
    parts = []
    if account_id is not None:
        a = _col(account_id).cast("string")
        parts.append(F.when(a.isNotNull() & (a != ""), F.concat(F.lit("acc_"), a)))
    if hash_key is not None:
        h = _col(hash_key).cast("string")
        parts.append(F.when(h.isNotNull() & (h != ""), F.concat(F.lit("hash_"), h)))
    parts.append(F.concat(F.lit("idx_"), _col(index).cast("string")))
    return F.regexp_replace(F.coalesce(*parts), "[^a-zA-Z0-9_.:-]", "_")


# --------------------------------------------------------------------- C26
def first_non_blank(cols: Sequence[Column | str]) -> Column:
    """The first value that is not blank after trimming (the value itself, untrimmed)."""
    exprs = [F.when(js_trim(_col(c).cast("string")) != "", _col(c).cast("string")) for c in cols]
    return F.coalesce(*exprs) if len(exprs) > 1 else exprs[0]


def yes_no(c: Column | str, yes: str = "Yes", no: str = "No", null_text: str | None = None) -> Column:
    x = _col(c).cast("boolean")
    out = F.when(x, F.lit(yes)).otherwise(F.lit(no))
    return out if null_text is None else F.when(x.isNull(), F.lit(null_text)).otherwise(out)


# ------------------------------------------------- accent-insensitive matching
@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and those letters; then
    the marks themselves, which stand for nothing.  Derived from Unicode."""
    pairs = []
    for ch in map(chr, range(0x80, 0x2000)):
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:]):
            pairs.append((ch, d[0]))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def fold_accents(c: Column | str) -> Column:
    """Letters without their accents, JVM-side and for any operator (``LIKE``
    takes no accent-insensitive collation)."""
    return F.translate(_col(c), *_accents())


def fold_accents_text(s: str) -> str:
    """The same for a parameter."""
    letters, plain = _accents()
    to = {ord(a): (plain[i] if i < len(plain) else None) for i, a in enumerate(letters)}
    return s.translate(to)
