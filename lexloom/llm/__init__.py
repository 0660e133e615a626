"""Operations of a training-data pipeline: filters, sharding, search, mixing, deduplication, packing."""
