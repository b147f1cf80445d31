"""A Spark-first engine for ranked, validated and formatted record collections."""
