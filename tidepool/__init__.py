"""tidepool: a Spark-first analytics engine over typed, time-aware memory graphs."""
