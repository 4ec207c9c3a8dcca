"""marketlake: a PySpark-native market-data lake.

Bars, news, fundamentals and macro series for many symbols at once: normalize, check, store as
versioned Parquet, register, and read back by range, as plain DataFrame transforms.
"""
