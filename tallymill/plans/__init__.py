"""Plan shapes that keep ordered work distributed: indexes, running values, percentiles."""
