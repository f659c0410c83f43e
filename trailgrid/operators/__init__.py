"""DataFrame operators: joins, rankings, sequences, metrics."""
