"""A PySpark-native analytics engine: DataFrame operators and a SQL dialect over them."""
