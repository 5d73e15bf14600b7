"""Schemas shared by sources, operators and sinks."""

from pyspark.sql import types as T

# One power sample: (time, frequency, convolution), the record written per
# recording; partition columns rat/dt/channel come from the directory names.
POWER_RECORD = T.StructType([
    T.StructField("time", T.LongType(), False),
    T.StructField("frequency", T.IntegerType(), False),
    T.StructField("convolution", T.FloatType(), True),  # NULL where samples are missing
])

PARTITION_KEYS = T.StructType([
    T.StructField("rat", T.StringType(), True),
    T.StructField("dt", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
])

# Power table as read back from partitioned Parquet. Declaring dt as STRING
# stops partition inference from turning '2009-11-19' into a DATE.
POWER_TABLE = T.StructType(POWER_RECORD.fields + PARTITION_KEYS.fields)

# Parsed raw recording sample.
SIGNAL = T.StructType([
    T.StructField("time", T.LongType(), True),
    T.StructField("voltage", T.FloatType(), True),
])

# Kernel bank, long form: one row per tap.
KERNEL_LONG = T.StructType([
    T.StructField("frequency", T.IntegerType(), False),
    T.StructField("u", T.IntegerType(), False),
    T.StructField("h", T.ShortType(), False),
])

PASSES = T.StructType([
    T.StructField("lo", T.LongType(), True),
    T.StructField("hi", T.LongType(), True),
])

PHASE = T.StructType([
    T.StructField("time", T.LongType(), True),
    T.StructField("phase", T.IntegerType(), True),
])
