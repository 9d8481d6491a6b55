"""DataFrame operators: decode, dedupe, score, rank, serve, enrich, names."""
