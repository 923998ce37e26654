"""Column builders (scalar functions)."""

from threadscope.functions.labels import (  # noqa: F401
    LABEL_NAMES,
    cap_labels,
    in_vocabulary,
    join_labels,
    parse_labels_fallback,
    parse_labels_first_object,
    parse_labels_strict,
    split_labels,
    strict_labels,
)
from threadscope.functions.scores import engagement, latency_min, latency_sec, to_number  # noqa: F401
from threadscope.functions.text import (  # noqa: F401
    WS_CLASS,
    clean_text,
    collapse_ws,
    epoch_seconds,
    fold_case,
    fullname,
    model_name_from_path,
    one_line,
    post_text,
    render_prompt,
    safe_name,
    searchable_blob,
    shorten,
    strip_emoji,
    strip_fullname,
    strip_urls,
    to_utc,
    trim_ws,
    truncate_chars,
    utc_year,
)
from threadscope.functions.verdicts import (  # noqa: F401
    fenced_verdict,
    parse_fenced_json,
    verdict_from_json,
    verdict_from_keyword,
)
