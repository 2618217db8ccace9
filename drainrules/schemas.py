"""Fixed schemas of the data model (no inference anywhere).

``SAMPLE`` is the flat record the miner works on (ten columns, this order).
``READING`` is one raw device reading, ``PAIR`` two consecutive readings of a
device, ``RATE`` the drain rate of a pair with the apps seen in it, and
``REGISTRATION`` a device sign-up used as an as-of dimension.
"""

from pyspark.sql import types as T

D = T.DoubleType()
S = T.StringType()

# --- fixed values: names and order of fields, as the files have them -----------
# Flat sample: column names and order of the TSV header.
SAMPLE_COLUMNS = [
    "rate", "cpu", "distance", "temp", "voltage", "screen",
    "mobileNetwork", "network", "wifiStrength", "wifiSpeed",
]
SAMPLE = T.StructType([
    T.StructField(name, S if name in ("mobileNetwork", "network") else D, True)
    for name in SAMPLE_COLUMNS
])

NETWORK_INFO = T.StructType([
    T.StructField("mobileNetworkType", S, True),
    T.StructField("networkType", S, True),
    T.StructField("wifiSignalStrength", T.IntegerType(), True),
    T.StructField("wifiLinkSpeed", T.IntegerType(), True),
])

ANDROID_FIELDS = T.StructType([
    T.StructField("cpuUsage", D, True),
    T.StructField("battery", T.StructType([
        T.StructField("temperature", D, True),
        T.StructField("voltage", D, True),
    ]), True),
    T.StructField("screenBrightness", D, True),
    T.StructField("networkInfo", NETWORK_INFO, True),
])

# One raw reading.  ``reading_id`` only breaks ties of equal times.
READING = T.StructType([
    T.StructField("reading_id", T.LongType(), True),
    T.StructField("uuid", S, True),
    T.StructField("time", D, True),
    T.StructField("battery_level", D, True),
    T.StructField("distanceTraveled", D, True),
    T.StructField("apps", T.ArrayType(S), True),
    T.StructField("androidFields", ANDROID_FIELDS, True),
])

PAIR = T.StructType([
    T.StructField("uuid", S, True),
    T.StructField("prev", READING, True),
    T.StructField("cur", READING, True),
])

REGISTRATION = T.StructType([
    T.StructField("uuid", S, True),
    T.StructField("reg_time", D, True),
    T.StructField("os", S, True),
])

RATE = T.StructType([
    T.StructField("rate", D, True),
    T.StructField("all_apps", T.ArrayType(S), True),
    T.StructField("sp", T.StructType([
        T.StructField("prev", READING, True),
        T.StructField("cur", READING, True),
    ]), True),
    T.StructField("registration", REGISTRATION, True),
])

RULE = T.StructType([
    T.StructField("antecedent", T.ArrayType(S), False),
    T.StructField("consequent", T.ArrayType(S), False),
    T.StructField("confidence", D, False),
])

APP_COUNT = T.StructType([
    T.StructField("app", S, True),
    T.StructField("n", T.LongType(), True),
])
