"""Dates and coordinates as they are written."""

import datetime

from pyspark.sql import functions as F

from docquarry.functions.parsing import parse_coordinates, parse_date

DATES = {
    "D:20240131120405+01'00'": (2024, 1, 31, 12, 4, 5), "D:20240131": (2024, 1, 31), "2024:01:31 12:04:05": (2024, 1, 31, 12, 4, 5), "2024:1:31": (2024, 1, 31), "2024-01-31": (2024, 1, 31), " 2024/01/31 ": (2024, 1, 31),
    "2024-01-31T12:04:05Z": (2024, 1, 31, 12, 4, 5), "2024-01-31T12:04:05+02:00": (2024, 1, 31, 12, 4, 5), "2024-01-31 12:04:05": (2024, 1, 31, 12, 4, 5), "1/31/2024": (2024, 1, 31), "31/1/2024": (2024, 1, 31),
    "2/3/2024": (2024, 2, 3), "31 January 2024": (2024, 1, 31), "January 31, 2024": (2024, 1, 31), "31 Jan 2024": (2024, 1, 31), "Wed, 31 Jan 2024 12:04:05 GMT": (2024, 1, 31, 12, 4, 5), "20240131": (2024, 1, 31),
    "": None, "never": None, "D:2024": None, "2024:13:40": None, "2024-02-30": None, None: None,
}
PLACES = {
    "40.7128, -74.0060": (40.7128, -74.006), "(40.7128,-74.0060)": (40.7128, -74.006), "40.7128°N, 74.0060°W": (40.7128, -74.006), "1.5 s 2.5 e": (-1.5, 2.5), "40°42'46\"N 74°00'21\"W": (40.712778, -74.005833),
    "90.1, 1.0": None, "1.0, 180.5": None, "12, 13": None, "": None, None: None,
}


def test_dates(spark):
    frame = spark.createDataFrame([(t,) for t in DATES], "t string").select("t", parse_date(F.col("t")).alias("d"))
    assert {r.t: r.d for r in frame.collect()} == {t: d and datetime.datetime(*d) for t, d in DATES.items()}


def test_coordinates(spark):
    frame = spark.createDataFrame([(t,) for t in PLACES], "t string").select("t", parse_coordinates(F.col("t")).alias("p"))
    assert {r.t: r.p and (round(r.p.lat, 6), round(r.p.lon, 6)) for r in frame.collect()} == PLACES
