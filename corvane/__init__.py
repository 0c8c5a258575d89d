"""Planning, filtering, de-duplicating and evaluating corpora of semi-structured text records on Spark."""
