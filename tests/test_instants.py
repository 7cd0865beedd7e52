import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from brightloom.operators import instants

PROFILE = [("us", "America/New_York", "MDY"), ("de", "Europe/Berlin", "DMY"), ("au", "Australia/Sydney", "DMY"), ("jp", "Asia/Tokyo", "YMD"), ("odd", "Mars/Base", "MDY"), ("lord", "Australia/Lord_Howe", "YMD")]


def run(spark, rows):
    df = spark.createDataFrame([(i, s, t, "clash") for i, (s, t) in enumerate(rows)], "id long, source string, text string, region string")
    got = instants.normalise(df, spark.createDataFrame(PROFILE, "source string, default_zone string, date_order string"), ["id"]).collect()
    out = {r["id"]: (r["utc_us"], r["reading"]) for r in got}
    return [out.get(i, (None, None)) for i in range(len(rows))]


def us(*a, zone="UTC", fold=0, micro=0):
    t = datetime(*a, tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc)
    return ((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1)) * 1_000_000 + micro


NY = "America/New_York"
CASES = [
    ("us", "2025-07-09T00:50:54", us(2025, 7, 9, 0, 50, 54, zone=NY)),
    ("us", "2026-11-06T18:45:12-05:00", us(2026, 11, 6, 23, 45, 12)),
    ("us", "1737388094", 1737388094_000_000),
    ("us", "1719584160752", 1719584160752_000),
    ("us", "1751717267439815", 1751717267439815),
    ("us", "1751717267439815999", 1751717267439815),
    ("us", "2025-02-11T05:36:56.7499569z", us(2025, 2, 11, 5, 36, 56, micro=749956)),
    ("us", "Wed, 11 Jun 2025 08:16:23 -0400", us(2025, 6, 11, 12, 16, 23)),
    ("us", "20250814081758", us(2025, 8, 14, 8, 17, 58, zone=NY)),
    ("us", "20240927T133737Z", us(2024, 9, 27, 13, 37, 37)),
    ("us", "20240927", us(2024, 9, 27, zone=NY)),
    ("us", "  2026/09/10 06:47:27 ", us(2026, 9, 10, 6, 47, 27, zone=NY)),
    ("jp", "2025年4月14日 16時59分", us(2025, 4, 14, 16, 59, zone="Asia/Tokyo")),
    ("us", "2026-10-07T16:15[America/Chicago]", us(2026, 10, 7, 16, 15, zone="America/Chicago")),
    ("us", "2026-02-21 16:55:16 America/New_York", us(2026, 2, 21, 16, 55, 16, zone=NY)),
    ("us", "06/22/2024 4:05 PM ET", us(2024, 6, 22, 16, 5, zone=NY)),
    ("de", "06/08/2024 12:05 a.m.", us(2024, 8, 6, 0, 5, zone="Europe/Berlin")),
    ("de", "30.10.2024 09:54", us(2024, 10, 30, 9, 54, zone="Europe/Berlin")),
    ("us", "Sep. 24, 2026 at 4:32pm Eastern Time", us(2026, 9, 24, 16, 32, zone=NY)),
    ("us", "29 March 2026, 01:26", us(2026, 3, 29, 1, 26, zone=NY)),
    ("de", "18/05/2025 00:28:02 (UTC+10:00)", us(2025, 5, 17, 14, 28, 2)),
    ("us", "2025-02-06 07:02:47,572", us(2025, 2, 6, 7, 2, 47, zone=NY, micro=572000)),
    ("us", "2025-10-09", us(2025, 10, 9, zone=NY)),
    ("us", "13 Jun 2025 09:00:00 CDT", us(2025, 6, 13, 14)),
    ("us", "2024-11-03T01:30:00", us(2024, 11, 3, 5, 30)),  # repeated: the first pass
    ("us", "2025-03-09 02:30:00", us(2025, 3, 9, 7, 30)),  # skipped: the offset before the change
    ("lord", "2025-10-05 02:10:00", us(2025, 10, 4, 15, 40)),
    ("us", "0001-01-01T00:00:00Z", us(1, 1, 1)),
    *[("us", t, None) for t in ("2026-02-30T10:00:00Z", "2025-13-04T08:00:00Z", "0000-00-00 00:00:00", "TBD", "", " ", "13:61", "2025-01-01 13:00 PM", "2025-01-01 10:00 Nowhere/City", "2025-01-01 10:61", "12/12", "2025-01-01 10:00 XYZ")],
    ("us", "9999-12-31 23:59:59", us(9999, 12, 30, 23, 59, 59, zone=NY) + 86_400_000_000),
    ("jp", "0001-01-01 00:00:00", us(1, 1, 3, zone="Asia/Tokyo") - 2 * 86_400_000_000),
    ("us", None, None),
    ("odd", "2025-01-01", None),
    (None, "2025-01-01", None),
    (None, "2025-01-01T00:00:00Z", us(2025, 1, 1)),
    ("us", "9" * 5000, None),
]


def test_forms(spark):
    got = run(spark, [(s, t) for s, t, _ in CASES])
    wrong = [(c, g) for c, g in zip(CASES, got) if g[0] != c[2]]
    assert not wrong
    assert got[24][1] == "first_pass" and got[25][1] == "skipped" and got[0][1] == "exact"


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("zone", [NY, "Europe/Berlin", "Australia/Sydney", "Australia/Lord_Howe", "Asia/Kolkata", "Africa/Casablanca", "America/Sao_Paulo"])
def test_local_times_against_brute_force(spark, zone):
    rng = random.Random(zone)
    around = [datetime(2025, 3, 9), datetime(2025, 3, 30), datetime(2025, 11, 2), datetime(2025, 10, 26), datetime(2025, 4, 6), datetime(2025, 10, 5), datetime(2018, 11, 4)]
    times = [a + timedelta(minutes=rng.randrange(-1440, 1440)) for a in around for _ in range(25)]
    df = spark.createDataFrame([(i, "z", t.strftime("%Y-%m-%d %H:%M:%S")) for i, t in enumerate(times)], "id long, source string, text string")
    got = {r["id"]: r["utc_us"] for r in instants.normalise(df, spark.createDataFrame([("z", zone, "YMD")], "source string, default_zone string, date_order string"), ["id"]).collect()}
    for i, t in enumerate(times):  # fold 0 is the first pass of a repeated time, and the offset before the change of a skipped one
        assert got[i] == us(*t.timetuple()[:6], zone=zone), (zone, t)
