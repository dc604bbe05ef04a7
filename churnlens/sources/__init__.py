from churnlens.sources.io import (  # noqa: F401
    CHURN_SCHEMA, dtype_profile, load_model, preview, read_churn_csv, read_table,
    register, save_model, scan_range, scan_snapshot, shape, string_columns,
    write_csv, write_parquet,
)
