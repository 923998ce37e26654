"""Verdict Column builders (X13-X15): fenced JSON replies and keyword replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadscope.functions.labels import strict_json_value
from threadscope.functions.text import WS_CLASS, ColumnOrName, _c, trim_ws

# --- fixed values -------------------------------------------------------------
# Keyword verdicts: "rare" -> yes; "common" / "not_disease" -> no; anything else -> error.
KEYWORD_YES = ("rare",)
KEYWORD_NO = ("common", "not_disease")
# JSON verdicts: is_rare "yes" -> yes; "no" / "not_disease" -> no; anything else -> error.
JSON_YES = ("yes",)
JSON_NO = ("no", "not_disease")
VERDICT_YES, VERDICT_NO, VERDICT_ERROR = "yes", "no", "error"
# -----------------------------------------------------------------------------

_FENCE = "(?s)```json" + WS_CLASS + r"*(\{.*?\})" + WS_CLASS + "*```"


def parse_fenced_json(reply: ColumnOrName) -> Column:
    """The object inside a json code fence -> ``struct(is_rare, prevalence, parsed)``.

    ``parsed`` is false when there is no fence or the object is not strict JSON;
    absent fields read as ''. Non-string ``is_rare`` values stay non-matching.
    """
    body = F.regexp_extract(F.coalesce(_c(reply), F.lit("")), _FENCE, 1)
    v, one_value = strict_json_value(body)
    ok = (body != "") & F.coalesce(one_value, F.lit(False))
    is_rare = F.coalesce(F.try_variant_get(v, "$[0].is_rare", "string"), F.lit(""))
    prevalence = F.coalesce(F.try_variant_get(v, "$[0].prevalence", "string"), F.lit(""))
    return F.struct(
        F.when(ok, is_rare).alias("is_rare"),
        F.when(ok, prevalence).alias("prevalence"),
        ok.alias("parsed"),
    )


def verdict_from_keyword(reply: ColumnOrName) -> Column:
    """Trimmed, lower-cased keyword -> yes / no / error."""
    k = F.lower(trim_ws(F.coalesce(_c(reply), F.lit(""))))
    return (F.when(k.isin(*KEYWORD_YES), F.lit(VERDICT_YES))
            .when(k.isin(*KEYWORD_NO), F.lit(VERDICT_NO))
            .otherwise(F.lit(VERDICT_ERROR)))


def verdict_from_json(is_rare: ColumnOrName, strict_parity: bool = False) -> Column:
    """``is_rare`` -> yes / no / error; ``strict_parity`` stores errors as no."""
    k = F.lower(_c(is_rare))
    error = F.lit(VERDICT_NO if strict_parity else VERDICT_ERROR)
    return (F.when(k.isin(*JSON_YES), F.lit(VERDICT_YES))
            .when(k.isin(*JSON_NO), F.lit(VERDICT_NO))
            .otherwise(error))


def fenced_verdict(reply: ColumnOrName, strict_parity: bool = False) -> Column:
    """X13 + X15: ``struct(keep, prevalence_est)`` from a fenced reply.

    A reply without a parsable fence is an error (or ``no`` with empty prevalence
    under ``strict_parity``).
    """
    p = parse_fenced_json(reply)
    tri = F.when(p["parsed"], verdict_from_json(p["is_rare"])).otherwise(F.lit(VERDICT_ERROR))
    failed = tri == VERDICT_ERROR
    keep = F.when(failed, F.lit(VERDICT_NO if strict_parity else VERDICT_ERROR)).otherwise(tri)
    prevalence = F.when(failed, F.lit("")).otherwise(p["prevalence"])
    return F.struct(keep.alias("keep"), prevalence.alias("prevalence_est"))
