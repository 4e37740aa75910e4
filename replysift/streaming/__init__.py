from .stream import (  # noqa: F401
    classify_stream, read_csv_listing_stream, read_parquet_stream, run_counts_to_table,
    run_to_table, running_category_counts, write_classified, write_counts,
)
