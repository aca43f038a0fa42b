"""DataFrame-to-DataFrame operators, keyed by store (and run) rather than looped over."""
