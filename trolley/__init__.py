"""Retail price intelligence on Spark: DataFrame operators for prices, search, logs and trust."""
