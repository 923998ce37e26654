"""Label Column builders: split/join (X16, X17), vocabulary filter and cap (F10, T3),
and the three reply parsers (X10-X12) built on VARIANT so no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadscope.functions.text import ColumnOrName, _c, trim_ws

# --- fixed values -------------------------------------------------------------
# The ten label names, in this order.
LABEL_NAMES = (
    "experience",
    "clinical",
    "advice_seeking",
    "advice_giving",
    "emotional_support",
    "emotional_share",
    "lifestyle",
    "community",
    "news",
    "off_topic",
)
# Label caps and failure defaults of the three labelling set-ups (A, B, C).
CAP_STRICT = 5          # strict parser (X10), failure -> ["off_topic"]
CAP_FIRST_OBJECT = 3    # first-object parser (X11), failure -> []
CAP_FALLBACK = 3        # strict-then-greedy parser (X12), failure -> []
STRICT_FAILURE_LABEL = "off_topic"
LABEL_SEPARATOR = ";"
# -----------------------------------------------------------------------------

# JSON text allows only these four whitespace characters around a value.
_JSON_WS = r"[ \t\n\r]*"
_OBJECT_SHAPE = "^" + _JSON_WS + r"\{(?s:.*)\}" + _JSON_WS + "$"


def split_labels(c: ColumnOrName, sep: str = LABEL_SEPARATOR) -> Column:
    """``'a; b;;c'`` -> ``['a','b','c']``: split, strip, drop empties; null -> []."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), _regex_quote(sep))
    return F.filter(F.transform(parts, lambda x: trim_ws(x)), lambda x: x != "")


def join_labels(arr: ColumnOrName, sep: str = LABEL_SEPARATOR) -> Column:
    """``['a','b']`` -> ``'a;b'``."""
    return F.array_join(_c(arr), sep)


def in_vocabulary(arr: ColumnOrName, allowed: Sequence[str] = LABEL_NAMES) -> Column:
    """keep only allowed names, order kept."""
    allowed = list(allowed)
    return F.filter(_c(arr), lambda x: x.isin(allowed))


def cap_labels(arr: ColumnOrName, n: int) -> Column:
    """First n labels."""
    return F.slice(_c(arr), 1, n)


def strict_labels(reply: ColumnOrName) -> Column:
    """The ``labels`` list of a reply that is exactly one JSON object, else NULL.

    Mirrors a strict JSON loader: only JSON whitespace around the object, no
    trailing text, no second object, single quotes rejected, and ``labels`` must be
    an array (a string, number or object gives NULL).
    """
    r = _c(reply)
    wrapped, one_object = strict_json_value(r)
    is_list = F.try_variant_get(wrapped, "$[0].labels", "array<variant>").isNotNull()
    labels = F.try_variant_get(wrapped, "$[0].labels", "array<string>")
    return F.when(r.rlike(_OBJECT_SHAPE) & F.coalesce(one_object, F.lit(False)) & is_list, labels)


# A sentinel element closes the wrapper array: Spark's JSON parser stops after the first
# complete value and ignores some trailing tokens (e.g. a stray "]}"), so the wrapper
# proves the reply is exactly one value only when the sentinel is parsed as element 2.
_END = "threadscope:end-of-reply"


def strict_json_value(text: Column) -> tuple[Column, Column]:
    """``(v, ok)``: ``v`` parses ``[text, sentinel]``; ``ok`` is true only when ``text`` is
    exactly one JSON value (nothing before or after it but JSON whitespace)."""
    v = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    ok = (F.size(v.try_cast("array<variant>")) == 2) & (F.try_variant_get(v, "$[1]", "string") == _END)
    return v, ok


def parse_labels_strict(reply: ColumnOrName, allowed: Sequence[str] = LABEL_NAMES,
                        cap: int = CAP_STRICT, failure: str = STRICT_FAILURE_LABEL) -> Column:
    """The stripped reply must be ``{"labels": [...]}``; otherwise ``[failure]``.

    A valid reply whose labels are all outside the vocabulary gives ``[]``.
    """
    labels = strict_labels(trim_ws(F.coalesce(_c(reply), F.lit(""))))
    return F.coalesce(cap_labels(in_vocabulary(labels, allowed), cap), F.array(F.lit(failure)))


def parse_labels_first_object(reply: ColumnOrName, allowed: Sequence[str] = LABEL_NAMES,
                              cap: int = CAP_FIRST_OBJECT) -> Column:
    """X11: parse the first non-greedy ``{...}`` block; failure -> ``[]``.

    A nested object ends the block early and therefore fails, as a non-greedy
    pattern does.
    """
    block = F.regexp_extract(F.coalesce(_c(reply), F.lit("")), r"(?s)\{.*?\}", 0)
    labels = strict_labels(block)
    return F.coalesce(cap_labels(in_vocabulary(labels, allowed), cap), F.array().cast("array<string>"))


def parse_labels_fallback(reply: ColumnOrName, allowed: Sequence[str] = LABEL_NAMES,
                          cap: int = CAP_FALLBACK) -> Column:
    """Strict parse of the whole reply, else of the greedy ``{.*}`` block; failure -> ``[]``."""
    r = F.coalesce(_c(reply), F.lit(""))
    greedy = F.regexp_extract(r, r"(?s)\{.*\}", 0)
    labels = F.coalesce(strict_labels(r), strict_labels(greedy))
    return F.coalesce(cap_labels(in_vocabulary(labels, allowed), cap), F.array().cast("array<string>"))


def _regex_quote(s: str) -> str:
    import re

    return re.escape(s)
