import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical as J
from tidemark.plans import features as P
from tidemark.sources import commits
from tidemark.sources import feature_store as S

DAY = dt.date(2026, 1, 31)


def at(day):
    return dt.datetime(2026, 3, day, 12)


def sets(spark, rows):
    """(commodity, day, registry, values, day of writing)"""
    data = [(c, d, r, v, at(w)) for c, d, r, v, w in rows]
    df = spark.createDataFrame(
        data, "commodity_id string, as_of_date date, registry_id string, feature_values map<string,string>, created_at timestamp"
    ).withColumn("feature_lineage", F.struct(F.lit("1").alias("assembly_version"), F.expr(
        "array(named_struct('agent', 'market', 'is_stub', false))").alias("agents")))
    return df.withColumn("feature_hash", J.digest(P.feature_json()))


def found(spark, folder, day=None, **span):
    rows = S.read_sets(spark, folder, at(day) if day else None, **span).collect()
    return {(r.commodity_id, r.as_of_date, r.registry_id): (r.feature_values, r.created_at.day) for r in rows}


def test_repeats_add_nothing_and_earlier_reads_stay(spark, tmp_path):
    folder, key, next_month = str(tmp_path), ("c", DAY, "r"), ("c", dt.date(2026, 2, 1), "r")
    one = [(*key, {"a": "1"}, 2), (*next_month, {"a": None}, 2)]
    assert S.append_sets(spark, folder, sets(spark, one * 3)) == {"versions_added": 2, "contents_added": 2}
    again = [(*k[:4], 4) for k in one]
    assert S.append_sets(spark, folder, sets(spark, again)) == {"versions_added": 0, "contents_added": 0}
    two = [(*key, {"a": "2"}, 6), (*key, {"a": "1"}, 8), (None, DAY, "r", {}, 6)]
    # Going back to an earlier content is a version, but no new content.
    assert S.append_sets(spark, folder, sets(spark, two)) == {"versions_added": 3, "contents_added": 2}
    assert S.append_sets(spark, folder, sets(spark, two)) == {"versions_added": 0, "contents_added": 0}
    assert found(spark, folder, 1) == {}
    assert found(spark, folder, 5) == {key: ({"a": "1"}, 2), next_month: ({"a": None}, 2)}
    assert found(spark, folder, 7)[key] == ({"a": "2"}, 6)
    assert found(spark, folder)[key] == ({"a": "1"}, 8) and found(spark, folder)[(None, DAY, "r")] == ({}, 6)
    assert set(found(spark, folder, first=dt.date(2026, 2, 1))) == {next_month}
    # A late version is placed where it belongs and does not hide newer ones.
    assert S.append_sets(spark, folder, sets(spark, [(*key, {"a": "9"}, 3)]))["versions_added"] == 1
    assert (found(spark, folder, 4)[key], found(spark, folder)[key]) == (({"a": "9"}, 3), ({"a": "1"}, 8))


def test_a_broken_write_stays_unseen(spark, tmp_path, monkeypatch):
    folder, row = str(tmp_path), ("c", DAY, "r", {"a": "1"}, 2)
    real = commits.Batch.append

    def breaks(self, table, rows, day="as_of_date"):
        if table == S.CONTENTS:
            raise OSError("lost")
        real(self, table, rows, day)

    with monkeypatch.context() as patch, pytest.raises(OSError):
        patch.setattr(commits.Batch, "append", breaks)
        S.append_sets(spark, folder, sets(spark, [row]), "w", 1)
    assert found(spark, folder) == {}
    want = {"versions_added": 1, "contents_added": 1}
    assert S.append_sets(spark, folder, sets(spark, [row]), "w", 1) == want
    assert S.append_sets(spark, folder, sets(spark, [(*row[:3], {"a": "7"}, 3)]), "w", 1) == want
    assert found(spark, folder) == {row[:3]: ({"a": "1"}, 2)}


def test_nothing_and_wrong_rows(spark, tmp_path):
    none = sets(spark, [("c", DAY, "r", {"a": "1"}, 2)]).limit(0)
    assert S.append_sets(spark, str(tmp_path), none) == {"versions_added": 0, "contents_added": 0}
    assert found(spark, str(tmp_path)) == {}
    with pytest.raises(ValueError):
        S.append_sets(spark, str(tmp_path), sets(spark, [("c", None, "r", {"a": "1"}, 2)]))
