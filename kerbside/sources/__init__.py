"""Sources and stored tables: CSV/JSON ingest with strict typing, versioned Parquet tables."""
