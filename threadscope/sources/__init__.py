"""Readers (S1-S9) and writers (K1-K7)."""

from threadscope.sources.readers import (  # noqa: F401
    period_paths,
    read_by_period,
    read_catalog_csv,
    read_catalog_dump,
    read_flat_csv,
    read_flat_objects,
    read_label_files,
    read_ontology_terms,
    read_term_list,
    read_threads,
)
from threadscope.sources.sinks import (  # noqa: F401
    append_candidates,
    read_latest,
    snapshot_then_replace,
    write_clean,
    write_csv,
    write_name_list,
    write_objects,
    write_term_list,
)
