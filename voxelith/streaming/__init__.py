"""Edit logs as streams, applied to a world that is kept as Parquet, a partition for each region."""
