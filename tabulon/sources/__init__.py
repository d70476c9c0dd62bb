from tabulon.sources.io import (  # noqa: F401
    NA_TOKENS,
    load_tables,
    nan_to_null,
    read_table,
    read_semicolon_table,
    table,
    write_predictions,
)
