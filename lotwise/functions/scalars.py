"""Scalar functions: every one is ``Column -> Column`` built from Spark
built-ins, so it stays inside whole-stage codegen (no Python per row)."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "clean_number", "py_strip", "url_strip", "url_untrack", "url_join", "url_encode", "strip_parens",
    "title_year", "is_blank", "is_empty", "to_numeric", "fmt_int", "fmt_currency", "fmt_duration",
    "utc_stamp", "run_stamp", "let", "LONG_MAX", "PY_WHITESPACE",
]

# ---- fixed values -----------------------------------------------------------
# Characters Python's str.strip()/isspace() treat as whitespace.
PY_WHITESPACE = "\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# A URL scheme: letter, then letters, digits, '+', '.', '-', then ':'.
_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
LONG_MAX = (1 << 63) - 1
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
RUN_STAMP = "yyyyMMdd-HHmmss"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_number(text) -> Column:
    """Keep the ASCII digits of the text; none (or NULL text) gives NULL.

    Fractions and ranges fuse on purpose: ``$8,999.50`` -> 899950.
    A value past a long becomes the largest long, which no limit accepts
    (NULL would pass every limit).
    """
    digits = F.regexp_replace(_c(text), "[^0-9]+", "")
    return F.coalesce(digits.try_cast("bigint"), F.when(digits != "", F.lit(LONG_MAX)))


def py_strip(x, chars: str | None = None) -> Column:
    """Strip Python whitespace (or the given characters) from both ends."""
    cls_ = PY_WHITESPACE if chars is None else "".join("\\" + ch for ch in chars)
    return F.regexp_replace(_c(x), f"^[{cls_}]+|[{cls_}]+$", "")


def is_empty(x) -> Column:
    """NULL or '' (Python falsiness of a string).  References ``x`` once, so
    a computed column pushed into a filter is not expanded twice."""
    return F.coalesce(_c(x), F.lit("")) == F.lit("")


def is_blank(x) -> Column:
    """NULL, empty, or only whitespace (as Python's ``str.strip`` sees it)."""
    c = _c(x)
    return c.isNull() | c.rlike(f"^[{PY_WHITESPACE}]*$")


def let(x: Column, f) -> Column:
    """Evaluate ``x`` once and apply ``f`` to it (a lambda binding), so an
    expression used several times is neither recomputed nor copied into the
    generated code once per use."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _clean_url_text(c: Column) -> Column:
    # What urlsplit does before splitting: strip leading C0 controls and
    # blanks, drop tab/CR/LF anywhere, lower-case a valid scheme.
    def lower_scheme(u):
        scheme = F.substring_index(u, ":", 1)
        fix = u.contains(":") & (scheme != F.lower(scheme)) & scheme.rlike("^[A-Za-z][A-Za-z0-9+.-]*$")
        return F.when(fix, F.concat(F.lower(scheme), u.substr(F.length(scheme) + 1, F.lit(1 << 30)))).otherwise(u)

    return let(F.regexp_replace(c, "^[\\x00-\\x20]+|[\\t\\r\\n]", ""), lower_scheme)


def _plain_url(c: Column) -> Column:
    # The common case needs none of the clean-up: lower-case http(s) scheme,
    # no tab / CR / LF anywhere.
    return ((c.startswith("https://") | c.startswith("http://"))
            & ~c.contains("\t") & ~c.contains("\n") & ~c.contains("\r"))


def url_strip(url) -> Column:
    """Canonical listing URL: scheme, host and path only (query and fragment dropped).

    One regex on the common path; the rare clean-ups (which commute with
    cutting at the first '?' or '#') only run for URLs that need them.
    """
    cut = F.regexp_replace(_c(url), "(?s)[?#].*$", "")
    return F.when(_plain_url(cut), cut).otherwise(_clean_url_text(cut))


def _form_encode(x: Column) -> Column:
    # Java's form encoder keeps '*' and escapes '~'; Python's quote_plus does
    # the reverse.  Fix both so the output equals urllib's urlencode.
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_encode(x) -> Column:
    """Form-encode one parameter value (space -> '+', as urllib's urlencode)."""
    return _form_encode(_c(x).cast("string"))


def _form_decode(x: Column) -> Column:
    # '+' is a space, %XX is a byte; a '%' not followed by two hex digits
    # stays as it is (escaped first so the decoder accepts the rest).
    safe = F.regexp_replace(F.replace(x, F.lit("+"), F.lit(" ")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), x)


def url_untrack(url) -> Column:
    """Drop ``utm_*`` parameters (any case) and the fragment; keep the other
    parameters in order, re-encoded; a bare ``k`` becomes ``k=``."""
    u = _clean_url_text(F.regexp_replace(_c(url), "(?s)#.*$", ""))
    base = F.regexp_replace(u, "(?s)\\?.*$", "")
    qpos = F.instr(u, "?")
    query = F.when(qpos > 0, u.substr(qpos + 1, F.lit(1 << 30))).otherwise(F.lit(""))
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")

    def kv(p):
        eq = F.instr(p, "=")
        k = F.when(eq > 0, p.substr(F.lit(1), eq - 1)).otherwise(p)
        v = F.when(eq > 0, p.substr(eq + 1, F.lit(1 << 30))).otherwise(F.lit(""))
        return F.struct(_form_decode(k).alias("k"), _form_decode(v).alias("v"))

    kept = F.filter(F.transform(pairs, kv), lambda x: ~F.lower(x["k"]).startswith("utm_"))
    enc = F.transform(kept, lambda x: F.concat(_form_encode(x["k"]), F.lit("="), _form_encode(x["v"])))
    return F.when(u.isNull(), F.lit(None)).otherwise(
        F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(enc, "&"))).otherwise(F.lit("")))
    )


def _resolve_path(hpath: Column, base_parts: list[str]) -> Column:
    """Merge a link's path with the base directory and remove dot segments
    (as ``urljoin`` does): a stack fold over the '/'-separated segments."""
    empty = F.array().cast("array<string>")
    rel = F.concat(F.array(*[F.lit(p) for p in base_parts]) if base_parts else empty, F.split(hpath, "/"))
    n = F.size(rel)
    rel = F.filter(rel, lambda x, i: (i == 0) | (i == n - 1) | (x != ""))
    segs = F.when(hpath.startswith("/"), F.split(hpath, "/")).otherwise(rel)
    stack = F.aggregate(segs, empty, lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                        .when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    stack = F.when(F.element_at(segs, -1).isin(".", ".."), F.concat(stack, F.array(F.lit("")))).otherwise(stack)
    joined = F.array_join(stack, "/")
    joined = F.when(joined == "", F.lit("/")).otherwise(joined)
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def url_join(href, base: str) -> Column:
    """Resolve a link against a fixed site base, as a browser would.

    Absolute links (with a scheme) and scheme-relative ``//host`` links are
    kept; host-relative and path-relative links are merged with the base
    path and their ``.`` / ``..`` segments removed; query-only, fragment-only
    and empty links keep the base path.
    """
    h0 = _c(href)
    # '//' with an empty host is not scheme-relative: what follows is the link
    h = F.when(h0.startswith("//") & ~h0.rlike("^//[^/?#]"), h0.substr(F.lit(3), F.lit(1 << 30))).otherwise(h0)
    parts = urlsplit(base)
    origin = f"{parts.scheme}://{parts.netloc}"
    base_parts = parts.path.split("/")
    if base_parts[-1] != "":
        del base_parts[-1]
    base_noq = origin + parts.path
    base_nofrag = base.split("#", 1)[0]
    hpath = F.regexp_extract(h, "^([^?#]*)", 1)
    rest = h.substr(F.length(hpath) + 1, F.lit(1 << 30))
    return (
        F.when(h.isNull(), F.lit(None))
        .when(h.rlike(_SCHEME), h)
        .when(h.rlike("^//[^/?#]"), F.concat(F.lit(parts.scheme + ":"), h))
        .when(h == "", F.lit(base))
        .when(h.startswith("?"), F.concat(F.lit(base_noq), h))
        .when(h.startswith("#"), F.concat(F.lit(base_nofrag), h))
        .otherwise(F.concat(F.lit(origin), _resolve_path(hpath, base_parts), rest))
    )


def strip_parens(x) -> Column:
    """Strip '(' and ')' from both ends."""
    return F.btrim(_c(x), F.lit("()"))


def title_year(title) -> Column:
    """Model year from the first 4 characters of the title, if all 4 are
    ASCII digits; otherwise NULL (and a NULL year passes every year limit)."""
    head = F.substring(_c(title), 1, 4)
    return F.when(head.rlike("^[0-9]{4}$"), head.cast("int"))


def to_numeric(x) -> Column:
    """Text to a whole number; anything else (or a fraction) is NULL."""
    c = _c(x).cast("string")
    d = c.try_cast("double")
    return F.coalesce(
        c.try_cast("bigint"),
        F.when((d == F.floor(d)) & (F.abs(d) < F.lit(9.2e18)), d.cast("bigint")),
    )


def fmt_int(n) -> Column:
    """Thousands separators; NULL -> 'n/a'."""
    return F.coalesce(F.format_number(_c(n), 0), F.lit("n/a"))


def fmt_currency(n) -> Column:
    """``$`` plus thousands separators; NULL -> 'n/a'."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(_c(n), 0)), F.lit("n/a"))


def fmt_duration(seconds) -> Column:
    """Whole seconds as ``m:ss``, or ``h:mm:ss`` from one hour on."""
    s = _c(seconds).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(s.isNull(), F.lit(None)).when(
        h > 0, F.format_string("%d:%02d:%02d", h.cast("bigint"), m.cast("bigint"), r)
    ).otherwise(F.format_string("%d:%02d", m.cast("bigint"), r))


def utc_stamp(ts) -> Column:
    """ISO-8601 text, seconds, no zone suffix (session time zone is UTC)."""
    return F.date_format(_c(ts), ISO_SECONDS)


def run_stamp(ts) -> Column:
    """Snapshot stamp ``YYYYMMDD-HHMMSS``."""
    return F.date_format(_c(ts), RUN_STAMP)
