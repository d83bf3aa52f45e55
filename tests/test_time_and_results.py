import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mentionlake.operators.alerts import cool_down, spike_alerts
from mentionlake.operators.results import (
    display_results, flatten_results, format_results, negative_feed, receive_stats, roll_up, with_latency, write_results,
)
from mentionlake.operators.tone import with_model_tone, with_tone
from mentionlake.operators.ttl import meta_sessions, visible_members
from mentionlake.schemas import RESULT
from mentionlake.staging import new_path

START = datetime(2024, 1, 1)
TTL = 86400


def at(hours):
    return START + timedelta(hours=hours)


def test_meta_restarts_after_exactly_one_ttl(spark):
    schema = "cluster_id string, ts timestamp, seq long, post_id string, similarity_score double"
    rows = [("c1", at(0), 0, "a", 0.0), ("c1", at(24), 1, "b", 0.9), ("c2", at(0), 2, "c", 0.0), ("c2", at(23.9), 3, "d", 0.8)]
    got = {r.cluster_id: (r.post_count, r.last_post_id, r.last_similarity) for r in meta_sessions(spark.createDataFrame(rows, schema), TTL).collect()}
    assert got == {"c1": (1, "b", 0.9), "c2": (2, "d", 0.8)}


def test_visible_members_like_a_store_with_expiry(spark):
    rng = random.Random(3)
    adds = sorted((at(rng.uniform(0, 200)), rng.randrange(6), i) for i in range(120))
    now, store = at(205), {}
    for when, bucket, fp in adds:
        members, last = store.get(bucket, (set(), None))
        if last is not None and when - last >= timedelta(seconds=TTL):
            members = set()
        store[bucket] = (members | {fp}, when)
    want = {fp for members, last in store.values() if now - last < timedelta(seconds=TTL) for fp in members}
    rows = spark.createDataFrame([(b, fp, t) for t, b, fp in adds], "bucket int, fp int, added_at timestamp")
    got = visible_members(rows, F.lit(now), TTL, ("bucket",)).collect()
    assert {r.fp for r in got} == want and want


def test_spikes_cool_down(spark):
    hours = [0, 0, 0, 1, 1, 2, 2, 3, 3, 3]
    rows = [("p", at(h) + timedelta(minutes=i)) for i, h in enumerate(hours)] + [("q", at(0))]
    got = spike_alerts(spark.createDataFrame(rows, "projectId string, ts timestamp"), 3600, 2, 2 * 3600).collect()
    assert sorted((r.projectId, r.window_start, r.n) for r in got) == [("p", at(0), 3), ("p", at(2), 2)]


def test_spikes_like_a_walk_in_time(spark):
    rng, schema = random.Random(4), "projectId string, window_start timestamp, n long"
    for cool in (0, 3600, 5 * 3600):
        hours = {p: sorted(rng.sample(range(300), 120)) for p in ("p", "q", None)}
        last = {"p": 20, "r": 3}
        want = set()
        for p, hs in hours.items():
            before = last.get(p)
            for h in hs:
                if before is not None and h <= before:
                    continue
                if before is None or (h - before) * 3600 >= cool:
                    want.add((p, at(h)))
                    before = h
        rows = [(p, at(h), 1) for p, hs in hours.items() for h in hs if h > last.get(p, -1)]
        fired = spark.createDataFrame([(p, at(h)) for p, h in last.items()], "projectId string, window_start timestamp")
        got = cool_down(spark.createDataFrame(rows, schema), cool, last=fired)
        assert "InPandas" not in got._jdf.queryExecution().toString()
        assert {(r.projectId, r.window_start) for r in got.collect()} == want
    assert cool_down(spark.createDataFrame([], schema), 60).count() == 0


POST = "post_id string, seq long, cluster_id string, projectId string, title string, content string, type string, url_string string, relevancy int, tone string"


def test_result_shape(spark):
    rows = [("a", 1, "c", "p", None, "😀" * 600, None, "u", None, None)]
    nested = format_results(spark.createDataFrame(rows, POST))
    assert nested.schema.simpleString() == spark.createDataFrame([], RESULT).schema.simpleString()
    post = nested.first().posts[0]
    assert (post.title, post.type, post.url_string) == ("", None, "u")
    assert post.content == "😀" * 500 and tuple(post.metrics) == (0, "neutral")
    path = new_path(spark, "results")
    write_results(nested, path)
    assert spark.read.schema(RESULT).json(path).collect() == nested.collect()


def test_flat_and_shown(spark):
    rows = [("a", 1, "c", "p", "t" * 60, "x", "post", "u", 37, "negative"), ("b", 2, "c", "p", "t", "x", "post", "u", 100, "odd")]
    nested = format_results(spark.createDataFrame(rows, POST))
    flat = sorted(map(tuple, flatten_results(nested).collect()))
    assert flat == [("p", "c", 37, "negative", "t" * 50), ("p", "c", 100, "odd", "t")]
    shown = {r.relevancy_bar: r.tone_title for r in display_results(nested).collect()}
    assert shown == {"[███░░░░░░░] 37%": "🔴 negative", "[██████████] 100%": "? odd"}


def test_rollup_keeps_every_post(spark):
    rows = [(f"p{i}", i, "big" if i % 3 else "small", "p", f"t{i}", "x", "post", "u", 1, "neutral") for i in range(60)]
    parts = roll_up(spark.createDataFrame(rows, POST), posts_per_row=5).collect()
    assert sorted(p.title for r in parts for p in r.posts) == sorted(r[4] for r in rows)
    assert len(parts) > 2 and len({(r.clusterId, r.part) for r in parts}) == len(parts)
    whole = roll_up(spark.createDataFrame(rows, POST)).collect()
    assert sorted(len(r.posts) for r in whole) == [20, 40]
    big = max(whole, key=lambda r: len(r.posts))
    assert [p.title for p in big.posts] == [f"t{i}" for i in range(60) if i % 3]


def test_latency_feed_and_counts(spark):
    stamped = spark.createDataFrame([(1.0,), (0.0,), (None,)], "timestamp double")
    assert [r.latency for r in with_latency(stamped, F.lit(5.0)).collect()] == [4.0, None, None]
    assert tuple(receive_stats(stamped.filter("timestamp IS NOT NULL")).first()) == (2, 1.0)
    rows = [("a", 2, 60), ("b", 1, 60), ("c", 3, 90), ("d", 4, 10)]
    posts = spark.createDataFrame(rows, "post_id string, seq long, relevancy int").withColumn("tone", F.lit("negative"))
    assert [r.post_id for r in negative_feed(posts, 50).collect()] == ["c", "b", "a"]


def test_tone(spark):
    posts = spark.createDataFrame([(f"p{i}", "bad news" if i % 2 else None) for i in range(90)], "post_id string, content string")
    rows = with_tone(posts).collect()
    assert {(r.tone, r.tone_score) for r in rows} == {("negative", 0.15), ("neutral", 0.5), ("positive", 0.85)}
    assert all(0.6 <= r.tone_confidence <= 0.99 for r in rows) and rows == with_tone(posts).collect()

    def load():
        return lambda texts: [("negative" if "bad" in t else None, 0.9) for t in texts]

    modelled = with_model_tone(posts, load).collect()
    assert {(r.content, r.tone, r.tone_score) for r in modelled} == {("bad news", "negative", 0.15), (None, "neutral", None)}


def test_health_stages_no_texts(spark, monkeypatch):
    from mentionlake.plans import catalog

    staged, whole = [], catalog.stage
    monkeypatch.setattr(catalog, "stage", lambda df, name: staged.append(df.columns) or whole(df, name))
    assert catalog.health_query(spark, "/root/testdata/sf0.001").count()
    assert staged and all("content" not in columns for columns in staged)
