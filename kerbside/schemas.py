"""Fixed schemas of the stored tables and source files."""

from __future__ import annotations

from pyspark.sql import types as T

ADDRESS_COLUMNS = [
    "address_room",
    "address_number",
    "address_street",
    "address_locality",
    "address_city",
    "address_postcode",
]

# camelCase names used by every premises result (id, six address parts, updatedAt)
RESULT_NAMES = {
    "id": "id",
    "address_room": "addressRoom",
    "address_number": "addressNumber",
    "address_street": "addressStreet",
    "address_locality": "addressLocality",
    "address_city": "addressCity",
    "address_postcode": "addressPostcode",
    "updated_at": "updatedAt",
}

PREMISES = T.StructType(
    [T.StructField("id", T.LongType(), False)]
    + [T.StructField(c, T.StringType(), True) for c in ADDRESS_COLUMNS]
    + [
        T.StructField("search_postcode", T.StringType(), True),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

JOBS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("premises_id", T.LongType(), False),
        T.StructField("bin", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
    ]
)

POSTCODES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("latitude", T.DoubleType(), False),
        T.StructField("longitude", T.DoubleType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

MARKERS = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("etag", T.StringType(), True),
        T.StructField("checked_at", T.TimestampType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

# Source CSV files: no header, every field read as text first (typing is ING3).
PREMISES_CSV_COLUMNS = ["id"] + ADDRESS_COLUMNS
JOBS_CSV_COLUMNS = ["premises_id", "bin", "date"]

# Alternate premises layout of the SQLite loader (same file, other names).
SQLITE_PREMISES_COLUMNS = ["id", "address_1", "address_2", "address_3", "locality", "city", "postcode"]

# Geocode documents: {"result": [{postcode, longitude, latitude, distance}]}
GEOCODE_ELEMENT = T.StructType(
    [
        T.StructField("postcode", T.StringType(), True),
        T.StructField("longitude", T.DoubleType(), True),
        T.StructField("latitude", T.DoubleType(), True),
        T.StructField("distance", T.DoubleType(), True),
    ]
)
GEOCODE_DOCUMENT = T.StructType(
    [T.StructField("result", T.ArrayType(GEOCODE_ELEMENT), True), T.StructField("status", T.LongType(), True)]
)

# Saved-list document: {"premises": [{id, six nullable address strings}]}
SAVED_ELEMENT = T.StructType(
    [T.StructField("id", T.DoubleType(), True)]
    + [
        T.StructField(n, T.StringType(), True)
        for n in ["addressRoom", "addressNumber", "addressStreet", "addressLocality", "addressCity", "addressPostcode"]
    ]
)
SAVED_DOCUMENT = T.StructType([T.StructField("premises", T.ArrayType(SAVED_ELEMENT), True)])
