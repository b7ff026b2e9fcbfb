"""The release history and the REST reader, against fetches that note every call."""

import os
from collections import Counter
from datetime import date, timedelta

import pytest

from tests.fake_fetch import POINTER
from tidepanel.sources.cache import PayloadCache
from tidepanel.sources.history import HistoryReader, HistorySource, first_of_duplicates
from tidepanel.sources.rest import RestSource


@pytest.fixture
def notes(tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    POINTER.write_text(str(folder))
    yield folder
    POINTER.unlink()


@pytest.fixture(scope="module")
def sources(spark):
    spark.dataSource.register(HistorySource)
    spark.dataSource.register(RestSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def called(notes) -> Counter:
    return Counter(n.split(".")[0] for n in os.listdir(notes))


def history(spark, notes, tmp_path, last):
    stream = spark.readStream.format("release_history").options(fetch="tests.fake_fetch:release", first="2024-04-05", last=last, cache=f"{tmp_path}/cache", wait="0").load()
    return stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()


def test_history_resumes_and_fetches_no_date_twice(sources, notes, tmp_path):
    with pytest.raises(Exception, match="cut off"):
        history(sources, notes, tmp_path, "2024-05-31").awaitTermination()
    before = called(notes)
    assert before["release 2024-05-10"] == 1
    history(sources, notes, tmp_path, "2024-05-31").awaitTermination()
    after = called(notes)
    # only the date that failed is asked for again, and those that the failure had kept from running
    assert after["release 2024-05-10"] == 2
    assert all(n == 1 for what, n in after.items() if what != "release 2024-05-10")
    got = sources.read.parquet(f"{tmp_path}/out")
    fridays = [date(2024, 4, 5) + timedelta(weeks=w) for w in range(9)]
    assert sorted({r["date"] for r in got.collect()}) == fridays
    # a week without a release on its Friday has one of days before
    late = got.where("date = '2024-04-12'").collect()
    assert {r["release_date"] for r in late} == {date(2024, 4, 10)} and len(late) == 2
    kept = first_of_duplicates(got)
    assert kept.count() == 2 * 8 + 1 and kept.where("ticker = 'T'").first()["payload"] == '{"ticker": "T", "n": 1}'
    # later releases: only the new weeks are read, with a second try
    history(sources, notes, tmp_path, "2024-06-14").awaitTermination()
    later = called(notes) - after
    assert later == {"release 2024-06-07": 2, "release 2024-06-14": 1}
    assert sources.read.parquet(f"{tmp_path}/out").count() == got.count() + 4


def test_history_offsets_and_missing_weeks(notes):
    reader = HistoryReader({"fetch": "tests.fake_fetch:release", "first": "2024-04-03", "last": "2024-04-20", "back": "1", "wait": "0"})
    assert reader.initialOffset() == {"date": "2024-03-29"} and reader.latestOffset() == {"date": "2024-04-19"}
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [p.value for p in parts] == ["2024-04-05", "2024-04-12", "2024-04-19"]
    with pytest.raises(Exception, match="within 1 days of 2024-04-12"):
        list(reader.read(parts[1]))
    skipping = HistoryReader(reader.options | {"missing": "skip"})
    assert list(skipping.read(parts[1])) == [] and len(list(skipping.read(parts[0]))) == 2
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []


def test_rest_reads_keep_the_rate_and_are_cached(sources, notes, tmp_path):
    symbols = ",".join(f"S{i}" for i in range(16))
    options = {"endpoint": "e", "fetch": "tests.fake_fetch:rows", "symbols": symbols, "partitions": "8", "perMinute": "600", "cache": f"{tmp_path}/rest"}
    read = lambda **more: sources.read.format("panel_rest").options(**(options | more)).load()
    assert read().count() == 32
    times = sorted(float(".".join(n.split(".")[1:3])) for n in os.listdir(notes))
    assert len(times) == 16
    # ten calls a second for all eight partitions: no partition's second call comes before its pause of 0.8 s
    by_symbol = {n.split(".")[0].split()[1]: float(".".join(n.split(".")[1:3])) for n in os.listdir(notes)}
    assert all(by_symbol[f"S{i + 8}"] - by_symbol[f"S{i}"] >= 0.79 for i in range(8))
    assert read().count() == 32 and len(os.listdir(notes)) == 16  # from the cache
    assert read(refresh="true").where("symbol IN ('S3', 'S9')").count() == 4
    assert called(notes) - Counter(f"e S{i}" for i in range(16)) == {"e S3": 1, "e S9": 1}
    with pytest.raises(Exception, match="no such symbol"):
        read(symbols="BAD,S1").collect()
    assert {r["symbol"] for r in read(symbols="BAD,S1", skipFailures="true").collect()} == {"S1"}
    assert read(symbols="").count() == 0
    assert read().where("symbol = 'none'").count() == 0


def test_cache_entries_are_whole(tmp_path):
    cache = PayloadCache(f"{tmp_path}/c")
    assert cache.get("a", "b") is None
    cache.put([], "a", "b")
    cache.put([{"x": 1}], "a", "c")
    cache.put([{"x": 2}], "a", "c")
    assert cache.get("a", "b") == [] and cache.get("a", "c") == [{"x": 2}] and cache.get("a", "b c") is None
    assert all(n.endswith(".json") for n in os.listdir(tmp_path / "c"))
    assert PayloadCache(None).get("a") is None
