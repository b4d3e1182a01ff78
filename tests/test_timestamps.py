from loomwave.operators.timestamps import normalise_timestamps

SITES = [("ny", "America/New_York", "mdy"), ("de", "Europe/Berlin", "dmy"), ("jp", "Asia/Tokyo", "ymd"), ("in", "Asia/Kolkata", "dmy"), ("mars", "No/Where", "mdy")]
CASES = [
    ("2012-07-11T04:36:10", "ny", "2012-07-11T08:36:10.000000Z"), ("2012-07-11T04:36:10.5", "de", "2012-07-11T02:36:10.500000Z"), ("2012-07-11T04:36:10.123456789Z", None, "2012-07-11T04:36:10.123456Z"),
    ("2012-07-11 04:36:10 -0400", "de", "2012-07-11T08:36:10.000000Z"), ("2012-07-11T04:36:10+05:30", None, "2012-07-10T23:06:10.000000Z"), ("1341306125", "ny", "2012-07-03T09:02:05.000000Z"), ("1344074836432", None, "2012-08-04T10:07:16.432000Z"),
    ("20120714205856", "jp", "2012-07-14T11:58:56.000000Z"), ("20120703T163140", "in", "2012-07-03T11:01:40.000000Z"), ("07/23/2012 07:49:25 AM", "ny", "2012-07-23T11:49:25.000000Z"), ("12/01/2012 12:00:01.25 PM", "ny", "2012-12-01T17:00:01.250000Z"),
    ("12/01/2012 12:10", "de", "2012-01-12T11:10:00.000000Z"), ("12.01.2012 12:10", "ny", "2012-01-12T17:10:00.000000Z"), ("2013/03/27 08:48", "ny", "2013-03-27T12:48:00.000000Z"), ("Jul 2, 2012 12:05 AM", "ny", "2012-07-02T04:05:00.000000Z"),
    ("Tue, 09 Oct 2012 01:48:11 -0500", None, "2012-10-09T06:48:11.000000Z"), ("2012-11-04 01:30:00 EDT", "ny", "2012-11-04T05:30:00.000000Z"), ("2012-11-04 01:30:00 EST", "ny", "2012-11-04T06:30:00.000000Z"), ("2012-11-21 04:41:02 JST", "jp", "2012-11-20T19:41:02.000000Z"),
    ("2012-11-21 04:41:02 IST", "in", "2012-11-20T23:11:02.000000Z"), ("2012-11-21 04:41:02 JST", "ny", "none"), ("2012-11-04 01:30:00", "ny", "ambiguous"), ("2012-03-11 02:30:00", "ny", "nonexistent"), ("2012-03-25 02:00:00", "de", "nonexistent"), ("2012-03-25 03:00:00", "de", "2012-03-25T01:00:00.000000Z"),
    ("2012-10-28 02:00:00", "de", "ambiguous"), ("2012-10-28 03:00:00", "de", "2012-10-28T02:00:00.000000Z"), ("  2012-07-11T04:36:10  ", "jp", "2012-07-10T19:36:10.000000Z"),
    (None, "ny", "none"), ("", "ny", "none"), ("n/a", "ny", "none"), ("unknown", "ny", "none"), ("2012-02-30T10:00:00", "ny", "none"), ("2012-02-03T25:00:00", "ny", "none"), ("2012-02-03T10:61:00", "ny", "none"), ("13/13/2012 10:00", "ny", "none"), ("02/03/2012 13:00 PM", "ny", "none"),
    ("1910-06-15T12:00:00", "ny", "none"), ("1901-01-01T00:00:00Z", "ny", "none"), ("2012-07-11T04:36:10", None, "none"), ("2012-07-11T04:36:10", "nowhere", "none"), ("2012-07-11T04:36:10", "mars", "none"), ("07/08/2012 10:00", None, "none"), ("123456789", "ny", "none"), ("2012-07-11T04:36:10+99:00", "ny", "none"),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, t, s, "x", "y") for i, (t, s, _) in enumerate(CASES)], "i int, t string, s string, tz_name string, acq_utc string")
    sites = spark.createDataFrame(SITES + SITES[:1], "site string, tz_name string, date_order string")
    out = normalise_timestamps(df, "t", "s", sites)
    assert out.columns == ["i", "t", "s", "tz_name", "acq_utc", "acq_utc_format"]
    got = {r["i"]: r["acq_utc"] for r in out.collect()}
    for i, (text, site, expect) in enumerate(CASES):
        assert got[i] == expect, (text, site)


def test_other_session_zone_and_empty(spark):
    sites = spark.createDataFrame(SITES, "site string, tz_name string, date_order string")
    spark.conf.set("spark.sql.session.timeZone", "Australia/Sydney")
    try:
        df = spark.createDataFrame([("2012-10-07T02:30:00", "de")], "t string, s string")
        assert normalise_timestamps(df, "t", "s", sites).collect()[0]["acq_utc"] == "2012-10-07T00:30:00.000000Z"
        assert normalise_timestamps(df.where("false"), "t", "s", sites).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
