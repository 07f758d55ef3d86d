"""Document-corpus analytics as DataFrame-in, DataFrame-out operators on Apache Spark."""
