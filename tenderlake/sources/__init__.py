"""Table sources: driver parquet tables and the views derived from them."""
