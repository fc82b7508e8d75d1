"""Operations of a large-scale training-data pipeline (ten operators and their queries)."""
