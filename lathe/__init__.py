"""lathe: a Spark-first engine for semi-structured documents."""
