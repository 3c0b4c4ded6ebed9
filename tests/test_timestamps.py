from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from lexigrid.functions import timestamps as TS

CASES = [  # value, zone, order, ISO UTC or None
    ("2014-10-02T22:43:30Z", "Asia/Seoul", "YMD", "2014-10-02T22:43:30"),
    ("2021-01-25 13:49:34", "Europe/Berlin", "DMY", "2021-01-25T12:49:34"),
    ("2016-09-14T22:57:57.829094+0530", "UTC", "YMD", "2016-09-14T17:27:57.829094"),
    ("2025-08-17T06:33:07.010267943Z", "UTC", "YMD", "2025-08-17T06:33:07.010267"),
    ("1601477916", None, None, "2020-09-30T14:58:36"),
    ("1480482003916", "Asia/Seoul", "YMD", "2016-11-30T05:00:03.916"),
    ("07/04/2020", "America/New_York", "MDY", "2020-07-04T04:00:00"),
    ("07/04/2020", "Europe/London", "DMY", "2020-04-06T23:00:00"),
    ("2020/04/07", "Europe/London", "DMY", "2020-04-06T23:00:00"),
    ("06.10.17", "Europe/Berlin", "DMY", "2017-10-05T22:00:00"),
    ("2024年8月31日", "Asia/Seoul", "YMD", "2024-08-30T15:00:00"),
    ("November 3, 2013 1:07 AM EST", "America/New_York", "MDY", "2013-11-03T06:07:00"),
    ("November 3, 2013 1:07 AM EDT", "America/New_York", "MDY", "2013-11-03T05:07:00"),
    ("November 3, 2013 1:07 AM", "America/New_York", "MDY", "2013-11-03T05:07:00"),
    ("2018-03-11T02:07:00", "America/New_York", "MDY", "2018-03-11T07:07:00"),
    ("Posted Feb 27th, 2021 at 8:02 AM", "UTC", "YMD", "2021-02-27T08:02:00"),
    ("Aug. 19, 2020 - 23:47 (UTC-04:00)", "America/New_York", "MDY", "2020-08-20T03:47:00"),
    ("29 septembre 2025 à 20h14", "Europe/Berlin", "DMY", "2025-09-29T18:14:00"),
    ("16 de noviembre de 2017", "Europe/Berlin", "DMY", "2017-11-15T23:00:00"),
    ("15. November 2022, 23:29 Uhr", "Europe/Berlin", "DMY", "2022-11-15T22:29:00"),
    ("Fri 29-Jan-2021", "UTC", "YMD", "2021-01-29T00:00:00"),
    ("23:03 UTC, 11 Nov 2017", "Asia/Seoul", "YMD", "2017-11-11T23:03:00"),
    ("July 13, 2018 10:54 pm UTC+5:30", "Asia/Kolkata", "DMY", "2018-07-13T17:24:00"),
    ("  MAY 26 2013 ", "UTC", "YMD", "2013-05-26T00:00:00"),
    ("30 февраля 2020", "UTC", "YMD", None),
    ("12:00 2020-02-29", "UTC", "YMD", "2020-02-29T12:00:00"),
    *[(x, "UTC", "YMD", None) for x in ("Soon", "yesterday", "3 days ago", "March 2021", "2022", "0000-00-00", "2021-13-40", "31/31/2020", "Today at 5 PM", "N/A", "", " ", "null", "2021-02-29", "x" * 50000)],
    (None, "UTC", "YMD", None),
    ("2020-01-01", None, None, None),
    ("2020-01-01T00:00:00Z", None, None, "2020-01-01T00:00:00"),
]


def micros(iso):
    return None if iso is None else round((datetime.fromisoformat(iso).replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def test_cases(spark):
    df = spark.createDataFrame([(i, v, z, o, "clash") for i, (v, z, o, _) in enumerate(CASES)], "i int, value string, tz string, ord string, mask string")
    got = {r.i: r.utc_micros for r in TS.to_utc_micros(df, "value", "tz", "ord").collect()}
    assert {CASES[i][0]: v for i, v in got.items()} and all(got[i] == micros(c[3]) for i, c in enumerate(CASES)), [(c, got[i]) for i, c in enumerate(CASES) if got[i] != micros(c[3])]
    assert TS.to_utc_micros(df.limit(0), "value", "tz", "ord").collect() == []


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/Los_Angeles", "Australia/Sydney", "Asia/Kolkata", "UTC", "Europe/London"])
def test_transition_table_against_zoneinfo(zone):
    tz = ZoneInfo(zone)
    rng = np.random.default_rng(3)
    epoch = datetime(1970, 1, 1)
    secs = rng.integers(0, 2_000_000_000, 3000)
    at, _ = TS.transitions(zone)
    near = (at[1:, None] + rng.integers(-90_000, 90_000, (len(at) - 1, 4))).ravel()
    secs = np.concatenate([secs, near])
    want = [int(((epoch + timedelta(seconds=int(s))).replace(tzinfo=tz).astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) for s in secs]
    assert TS.local_to_utc(secs, zone).tolist() == want


def test_masks_share_a_parser(spark):
    df = spark.createDataFrame([("2020-01-02",), ("1999-12-31",), ("May 3, 2020",), ("June 4, 2021",)], "v string")
    assert df.select(TS.mask("v").alias("m")).distinct().count() == 2


def test_query(spark, sf):
    from lexigrid.plans.timestamps import p4_found

    rows = p4_found(spark, sf).collect()
    assert rows and len({(r.field, r.record_key, r.utc_micros) for r in rows}) == len(rows)
