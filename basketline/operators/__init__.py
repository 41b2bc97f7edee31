"""DataFrame-to-DataFrame operators: cleaning, pairing, metrics, segments, privacy, audit, charts."""
