"""Operations of a training-data pipeline: deduplication, scans, quality, mixing and tokens."""
