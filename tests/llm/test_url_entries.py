from __future__ import annotations

from pyspark.sql import functions as F

from docspark.llm.url_filter import intervals, listed_by_all_events


def test_every_event_is_an_entry(spark, sf):
    pages, events = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "events"))
    _, entries = listed_by_all_events(pages, events)
    assert entries.count() == events.count()
    # the entries lie in the whole range, and patterns are listed anew on other days
    dates = lambda df, c: {r[0] for r in df.select(F.to_date(c)).distinct().collect()}
    assert dates(entries, "since") == dates(events, "ts")
    assert entries.groupBy("kind", "pattern").agg(F.count_distinct(F.to_date("since")).alias("d")).agg(F.max("d")).first()[0] >= 5
    assert intervals(entries).where("until IS NOT NULL").count() > 0
