"""Snapshots over all three signals: provenance digests, content, replay."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from tests import frames as X
from tidemark.operators import replay
from tidemark.plans import combined

REGISTRIES = "commodity_id string, registry_id string"


def signals(spark, parts=1):
    prices, arrivals = X.rising_prices(spark).repartition(parts), X.flat_arrivals(spark).repartition(parts)
    return combined.combined_signals(
        prices, arrivals, X.expected(spark), None, X.weather(spark, [5.0] * 60).repartition(parts),
        X.curve(spark).repartition(parts), spark.createDataFrame([("s", "r1")], REGISTRIES),
        spark.createDataFrame([("s", "belt")], "series_id string, weather_series string"),
    )


def test_snapshot_of_three_signals_and_its_replay(spark):
    snap = combined.combined_snapshots(signals(spark))
    rows = {r.as_of_date: r for r in snap.collect()}
    assert len(rows) == 30 and all(r.signal_count == 3 and len(r.snapshot_hash) == 64 for r in rows.values())
    last = {s.agent_type: s for s in rows[X.END].signals}
    assert set(last) == {combined.MARKET, combined.FUTURES, combined.WEATHER}
    assert last[combined.MARKET].inputs["reference_count"] == "120"
    assert last[combined.WEATHER].inputs["reference_count"] == "30"
    assert last[combined.FUTURES].inputs["curve_regime"]
    again = replay.validate_cycles(lambda: combined.combined_snapshots(signals(spark, 5)), 2)
    first = replay.fingerprint(snap).first()["fingerprint"]
    assert [c["fingerprint"] for c in again] == [first, first]
    # One more price, of a market that is known: the hashes of the windows that hold it change.
    day = X.END - dt.timedelta(days=3)
    extra = [("s", "m1", day, "modal", 7000.0, "validated", "late", X.noon(day))]
    refs = combined.reference_digests({"p": X.rising_prices(spark, extra=extra)}, 30)
    plain = combined.reference_digests({"p": X.rising_prices(spark)}, 30)
    joined = refs.alias("a").join(plain.alias("b"), ["series_id", "as_of_date"]).where("a.ref_digest <> b.ref_digest")
    assert joined.count() == 4


def test_reference_digest_equals_brute_force(spark):
    start = dt.date(2026, 1, 1)
    rows = [("s", start + dt.timedelta(days=d), f"o{i}") for i, d in enumerate((0, 0, 1, 4, 9, 9, 15))]
    table = spark.createDataFrame(rows, "series_id string, as_of_date date, observation_id string")
    got = {r.as_of_date: (r.ref_count, r.ref_digest) for r in combined.reference_digests({"k": table.repartition(3)}, 5).collect()}
    for day in {r[1] for r in rows}:
        own = [r for r in rows if day - dt.timedelta(days=4) <= r[1] <= day]
        total = sum(int(hashlib.md5(f"k:{r[2]}".encode()).hexdigest()[:15], 16) for r in own)
        assert got[day] == (len(own), str(total))
    none = combined.reference_digests({"k": table.filter(F.lit(False))})
    assert none.count() == 0
