"""DataFrame-to-DataFrame operators; key, time and value columns are parameters."""
