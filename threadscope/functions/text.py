"""String and time Column builders (projections P4-P8, scalar functions X1-X9, X19, X20).

All builders return JVM-side expressions (regexp_replace, substring, concat, ...)
so they stay inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# --- fixed values -------------------------------------------------------------
# Whitespace as Python's str.isspace()/re "\s" sees it (stripping and
# splitting use these): \t \n \v \f \r, U+001C..U+001F, space, U+0085, U+00A0,
# U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# Java's "\s" is ASCII-only, so the class is spelled out; the same text is valid
# RE2, which keeps the DuckDB oracle on identical semantics.
WS_CLASS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS_CLASS = "[^" + WS_CLASS[1:]
# URL pattern: scheme http/https followed by non-whitespace.
URL_PATTERN = "https?://" + NON_WS_CLASS + "+"
# Emoji blocks removed by the cleaner (U+2640/U+2642 and other symbols are kept):
# U+1F600-1F64F, U+1F300-1F5FF, U+1F680-1F6FF, U+1F1E0-1F1FF.
EMOJI_PATTERN = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
# Placeholder appended by shorten() when text is cut.
SHORTEN_PLACEHOLDER = " (…)"
# Fullname prefixes: t3_ = submission, t1_ = comment.
POST_PREFIX = "t3_"
COMMENT_PREFIX = "t1_"
# -----------------------------------------------------------------------------


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: ColumnOrName) -> Column:
    """Strip Unicode whitespace from both ends (Python ``str.strip()``)."""
    return F.regexp_replace(_c(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def without_broken_bytes(c: ColumnOrName) -> Column:
    """The text without bytes that are not UTF-8 (what decoding that ignores errors leaves). Replacement
    characters that the text itself holds stay: they stand as a noncharacter meanwhile."""
    kept = F.replace(_c(c), F.lit("\ufffd"), F.lit("\ufdd0"))
    return F.replace(F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit("")), F.lit("\ufdd0"), F.lit("\ufffd"))


def collapse_ws(c: ColumnOrName) -> Column:
    """Every whitespace run becomes one space, then strip."""
    return F.trim(F.regexp_replace(_c(c), WS_CLASS + "+", " "))


def one_line(c: ColumnOrName) -> Column:
    """Newline -> space, strip; null -> ''."""
    return trim_ws(F.replace(F.coalesce(_c(c), F.lit("")), F.lit("\n"), F.lit(" ")))


def truncate_chars(c: ColumnOrName, n: int = 300) -> Column:
    """P5: first n characters (code points)."""
    return F.substring(_c(c), 1, n)


def searchable_blob(*cols: ColumnOrName) -> Column:
    """Fields joined with one space, null -> ''."""
    return F.concat_ws(" ", *[F.coalesce(_c(x), F.lit("")) for x in cols])


def fullname(kind_prefix: str, id_col: ColumnOrName) -> Column:
    """``t3_<id>`` / ``t1_<id>``."""
    return F.concat(F.lit(kind_prefix), _c(id_col).cast("string"))


def strip_fullname(c: ColumnOrName) -> Column:
    """P7 inverse: drop the 3-character kind prefix."""
    return F.substring(_c(c), 4, 1 << 30)


def post_text(title: ColumnOrName, selftext: ColumnOrName) -> Column:
    """``title + ' ' + selftext`` with absent parts as ''."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(selftext), F.lit("")))


def strip_urls(c: ColumnOrName) -> Column:
    """URLs -> one space; null -> ''."""
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), URL_PATTERN, " ")


def strip_emoji(c: ColumnOrName) -> Column:
    """Runs of emoji from the four blocks -> one space."""
    return F.regexp_replace(_c(c), EMOJI_PATTERN, " ")


def fold_case(c: ColumnOrName) -> Column:
    """Lower-case for matching."""
    return F.lower(_c(c))


def clean_text(c: ColumnOrName) -> Column:
    """Strip URLs, strip emoji, lower-case, collapse whitespace — in this order.

    URLs and emoji runs are removed in one regex pass: a URL match swallows any emoji
    inside it, and removing emoji cannot create a URL that the first pass missed, so
    the single alternation equals the two sequential replacements.
    """
    no_links = F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"{URL_PATTERN}|{EMOJI_PATTERN}", " ")
    return collapse_ws(F.lower(no_links))


def shorten(c: ColumnOrName, width: int = 4000, always: bool = True,
            placeholder: str = SHORTEN_PLACEHOLDER) -> Column:
    """Whitespace-collapse and cut at a word boundary with a placeholder.

    ``always=True``: the text is always collapsed (and cut if longer than width).
    ``always=False``: text whose raw length is within width is returned untouched.
    The cut keeps the longest run of whole words whose length plus the placeholder
    fits in ``width``; when not even one word fits, only the stripped placeholder is
    returned. Words are separated by whitespace only (no hyphen break points).
    """
    raw = F.coalesce(_c(c), F.lit(""))
    s = collapse_ws(raw)
    room = width - len(placeholder) + 1  # chars that may precede the last cut space
    head = F.regexp_extract(F.substring(s, 1, room), r"^(.*) ", 1)
    cut = F.when(head == "", F.lit(placeholder.strip())).otherwise(F.concat(head, F.lit(placeholder)))
    short = F.when(F.length(s) <= width, s).otherwise(cut)
    if always:
        return short
    return F.when(F.length(raw) <= width, raw).otherwise(short)


def to_utc(epoch_seconds: ColumnOrName) -> Column:
    """Epoch seconds -> UTC wall-clock TIMESTAMP_NTZ (independent of session time zone)."""
    return F.timestamp_add("SECOND", _c(epoch_seconds), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def epoch_seconds(ts: ColumnOrName) -> Column:
    """Whole seconds since 1970-01-01 of a UTC wall-clock timestamp (TIMESTAMP_NTZ)."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            _c(ts).cast("timestamp_ntz"))


def utc_year(epoch: ColumnOrName) -> Column:
    """Calendar year (UTC) of epoch seconds."""
    return F.year(to_utc(epoch)).cast("bigint")


def safe_name(c: ColumnOrName) -> Column:
    """``/`` -> ``_`` (model names used in file names)."""
    return F.replace(_c(c), F.lit("/"), F.lit("_"))


def model_name_from_path(path_col: ColumnOrName, prefix: str = "labels_") -> Column:
    """File stem without the ``labels_`` prefix and the extension."""
    stem = F.regexp_extract(_c(path_col), r"([^/]+?)(\.[^./]*)?$", 1)
    return F.regexp_replace(stem, "^" + re.escape(prefix), "")


_FIELD = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}")


def render_prompt(template: str, columns: Mapping[str, ColumnOrName] | None = None) -> Column:
    """Fill ``{name}`` fields of a template from columns (null -> '').

    The template is split once on the driver into literal pieces and column
    references and becomes a single ``concat`` expression; ``{{``/``}}`` are literal
    braces.
    """
    columns = dict(columns or {})
    parts: list[Column] = []
    pos = 0
    text = template.replace("{{", "\0").replace("}}", "\1")
    for m in _FIELD.finditer(text):
        if m.start() > pos:
            parts.append(F.lit(text[pos:m.start()].replace("\0", "{").replace("\1", "}")))
        name = m.group(1)
        col = columns.get(name, name)
        parts.append(F.coalesce(_c(col).cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(text):
        parts.append(F.lit(text[pos:].replace("\0", "{").replace("\1", "}")))
    return F.concat(*parts) if parts else F.lit("")
