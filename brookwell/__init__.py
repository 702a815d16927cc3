"""A Spark-native relational engine with a small SQL dialect, and corpus operators beside it."""
