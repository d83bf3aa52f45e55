"""Every operator as a query over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.functions.bits import bucket_key
from mentionlake.functions.ids import name_uuid
from mentionlake.functions.text import words
from mentionlake.functions.tone import tone_score
from mentionlake.operators.alerts import health, spike_alerts
from mentionlake.operators.cluster import assign_clusters, cluster_meta
from mentionlake.operators.dedup import ARRIVAL, drop_near_duplicates, first_posts, ordered_edges
from mentionlake.operators.embed import HashedEmbedder, embed
from mentionlake.operators.knn import similar_posts, similar_to
from mentionlake.operators.lemma import build_dictionary, clean_dictionary, distinct_words, lemmatize_terms, lemmatize_texts
from mentionlake.operators.neardup import near_pairs
from mentionlake.operators.prefilter import mark, prefilter
from mentionlake.operators.relevancy import keyword_sets, score_relevancy
from mentionlake.operators.results import (
    display_results, flatten_results, format_results, negative_feed, receive_stats, roll_up, with_latency,
)
from mentionlake.operators.simhash import bucket_members, bucket_rows, fingerprints
from mentionlake.operators.skew import shuffled
from mentionlake.operators.split import split_batches, with_exclusions
from mentionlake.operators.terms import mark_terms
from mentionlake.operators.tone import with_tone
from mentionlake.operators.ttl import meta_sessions, visible_members
from mentionlake.params import Params
from mentionlake.plans.monitor import monitor
from mentionlake.sources.messages import (
    accepted, check_batches, check_ids, check_posts, dead_letters, from_messages, stream_lines, to_messages,
)
from mentionlake.sources.tables import read_table
from mentionlake.sources.vector_table import lookup, merge_payload, missing, payload, upsert, with_point_ids
from mentionlake.staging import new_path, stage
from mentionlake.streaming.alerts import StreamingAlerts
from mentionlake.streaming.keyed import BucketStore, ClusterStats
from mentionlake.streaming.monitor import StreamingMonitor

# The brand settings of each language's project.
KEYWORDS = {
    "en": ["the and", "Hein"],
    "de": ["UNG", "der die"],
    "fr": ["eau", "le la"],
    "es": ["de la", "ción"],
}
EXCLUSIONS = {"en": ["token ="], "de": ["MIT License"], "fr": ["license"], "es": []}
# Found through lemmas, mostly, and kept out by one.
LEMMA_KEYWORDS = ["eringing", "thblees", "der eingtion", "ión de", "eauer"]
LEMMA_EXCLUSIONS = ["thedones"]
PARAMS = Params(similarity_threshold=0.35)
SUFFIX = "(tion|ing|ed|es|er|en)$"
WINDOW, SPIKE, COOLDOWN = 3600, 5, 6 * 3600
BATCH = 16
NOW = 1706659200  # 2024-01-31


def _per_language(values: dict[str, list[str]]) -> Column:
    out = F.array().cast("array<string>")
    for lang, words_ in values.items():
        out = F.when(F.col("lang") == lang, F.array(*map(F.lit, words_)).cast("array<string>")).otherwise(out)
    return out


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as posts; the language is the project."""
    return read_table(spark, sf, "documents", "doc_id", "text", "lang", "source").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.col("lang").alias("projectId"),
        _per_language(KEYWORDS).alias("keywords"),
        _per_language(EXCLUSIONS).alias("exclusions"),
        F.lit("").alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("type"),
        F.lit("").alias("url_string"),
        F.col("doc_id").cast("double").alias("timestamp"),
        F.col("doc_id").alias("seq"),
        F.col("doc_id").alias("arrival"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"), "label"
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    table = read_table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    # the stored times have no zone; they are taken as UTC whatever the session's zone is
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return table.withColumn("ts", F.timestamp_micros(micros))


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """A rule in place of an analyser: words of the documents without a common ending."""
    tokens = distinct_words(posts(spark, sf), F.col("content"))
    lemma = F.when(F.length("token") > 5, F.regexp_replace("token", SUFFIX, "")).otherwise(F.col("token"))
    return stage(tokens.select("token", lemma.alias("lemma")).filter("token != lemma"), "dictionary")


def conversation_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as batches of at most 16 turns."""
    post = F.struct(
        "turn", F.lit("").alias("title"), F.col("text").alias("content"), F.col("role").alias("type"),
        F.concat(F.lit("conv://"), F.col("conv_id")).alias("url_string"),
    )
    batch_id = F.concat_ws("-", "conv_id", F.floor(F.col("turn") / BATCH).cast("bigint"))
    talk = read_table(spark, sf, "conversations")
    grouped = talk.groupBy("conv_id", batch_id.alias("batch_id")).agg(
        F.array_sort(F.collect_list(post)).alias("posts"), F.max("role").alias("last_role")
    )
    has_user = F.col("last_role") == "user"
    none = F.lit(None).cast("array<string>")
    return grouped.select(
        "batch_id",
        F.lit("talk").alias("projectId"),
        F.array(F.lit("the"), F.lit("der")).alias("keywords"),
        F.when(has_user, F.array().cast("array<string>")).otherwise(none).alias("risk_words"),
        F.array(F.lit("spam")).alias("exclusions"),
        F.transform("posts", lambda p: F.struct(p["title"].alias("title"), p["content"].alias("content"),
                                                p["type"].alias("type"), p["url_string"].alias("url_string"))).alias("posts"),
    )


def document_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON messages, some of them broken by a rule on their source."""
    p = posts(spark, sf)
    body = F.to_json(F.struct("post_id", "projectId", "keywords", "exclusions", "content", "type", "timestamp"))
    damaged = (
        F.when(F.col("type") == "src7", F.substring(body, 2, 1 << 30))
        .when(F.col("type") == "src8", F.concat(F.lit("["), body, F.lit("]")))
        .when(F.col("type") == "src9", F.concat(F.lit('{"title":null,'), F.substring(body, 2, 1 << 30)))
        .when(F.col("type") == "src10", F.concat(F.lit('{"title":5,'), F.substring(body, 2, 1 << 30)))
        .otherwise(body)
    )
    return p.select(damaged.alias("value"))


# -- ingest ---------------------------------------------------------------------------

def split_batch(spark, sf):
    return split_batches(with_exclusions(conversation_batches(spark, sf))).select(
        "post_id", "batch_id", "pos", "projectId", "title", "content", "type", "url_string"
    )


def exclusion_precedence(spark, sf):
    return with_exclusions(conversation_batches(spark, sf)).select(
        "batch_id", F.array_join("exclusions", ",").alias("exclusions"), F.size("posts").alias("n_posts")
    )


def batch_messages(spark, sf):
    batches = conversation_batches(spark, sf)
    body = F.struct("projectId", "keywords", "risk_words", "exclusions", "posts")
    good = accepted(check_batches(batches.select(F.to_json(body).alias("value")), F.timestamp_seconds(F.lit(0))))
    return good.select(
        "projectId", "title", "content", "type", "url_string", F.array_join("keywords", ",").alias("keywords"),
        F.array_join("exclusions", ",").alias("exclusions"),
        F.round(F.col("timestamp") * 1e6).cast("bigint").alias("pos"),
    )


def post_messages(spark, sf):
    good = accepted(check_posts(document_messages(spark, sf)))
    return good.select("post_id", "projectId", "title", "content", "type", "url_string", "timestamp")


def dead_letter(spark, sf):
    bad = dead_letters(check_posts(document_messages(spark, sf)), "intake")
    return bad.groupBy("_stage", "_error").agg(F.count("*").alias("n"))


def required_ids(spark, sf):
    p = with_point_ids(posts(spark, sf)).withColumn(
        "qdrant_point_id", F.when(F.col("type") != "src4", F.col("qdrant_point_id")).otherwise(F.lit(""))
    )
    checked = check_ids(p)
    return checked.groupBy("projectId").agg(
        F.count("*").alias("n"), F.count("_error").alias("n_dead")
    )


def handoff_json(spark, sf):
    p = posts(spark, sf).select("post_id", "projectId", "content", "seq")
    return from_messages(to_messages(p), "post_id string, projectId string, content string, seq bigint")


# -- filter ---------------------------------------------------------------------------

def prefilter_query(spark, sf):
    return prefilter(posts(spark, sf)).select("post_id", "projectId")


def prefilter_no_keywords(spark, sf):
    none = posts(spark, sf).withColumn("keywords", F.array().cast("array<string>"))
    return prefilter(none).select("post_id", "projectId")


def prefilter_lemma(spark, sf):
    p = posts(spark, sf).withColumns({
        "keywords": F.array(*map(F.lit, LEMMA_KEYWORDS)), "exclusions": F.array(*map(F.lit, LEMMA_EXCLUSIONS)),
    })
    return prefilter(p, dictionary(spark, sf)).select("post_id", "projectId")


def prefilter_many(spark, sf):
    """Every word of the benchmark as a keyword of every project, its own exclusions included."""
    found = read_table(spark, sf, "benchmark").select(F.explode(words(F.lower(F.col("text")))).alias("word")).distinct()
    whole = found.agg(F.collect_set("word").alias("keywords")).withColumn("one", F.lit(1))
    # one row of settings per project, all with the same keywords
    projects = posts(spark, sf).select("projectId", "exclusions", F.lit(1).alias("one")).distinct()
    lists = projects.join(whole, "one").drop("one")
    marked = mark_terms(posts(spark, sf), stage(lists, "lists"))
    return marked.filter("_pass").select("post_id", "projectId", "keywords_found")


def lemmatize_text(spark, sf):
    return lemmatize_texts(posts(spark, sf), dictionary(spark, sf), "content")


def lemma_plugin(spark, sf):
    """The rule of ``dictionary`` plugged in as an analyser that sees each token once."""
    ending = re.compile(SUFFIX)
    built = build_dictionary(posts(spark, sf), F.col("content"), lambda t: ending.sub("", t) if len(t) > 5 else t)
    return lemmatize_texts(posts(spark, sf), clean_dictionary(stage(built, "analysed")), "content")


def lemmatize_keyword(spark, sf):
    terms = read_table(spark, sf, "benchmark").select(F.explode(words(F.col("text"))).alias("term")).distinct()
    return lemmatize_terms(terms, dictionary(spark, sf))


# -- fingerprints ---------------------------------------------------------------------

def _prints(spark, sf) -> DataFrame:
    return fingerprints(posts(spark, sf), key=("seq", "post_id", "projectId", "type"))


def simhash(spark, sf):
    return _prints(spark, sf).select("post_id", "simhash")


def simhash_buckets(spark, sf):
    return bucket_rows(_prints(spark, sf)).select("post_id", "bucket_idx", "fragment", "bucket")


def simhash_bucket_members(spark, sf):
    return bucket_members(_prints(spark, sf))


def near_dup_pairs(spark, sf):
    prints = stage(_prints(spark, sf), "prints")
    nodes = stage(first_posts(prints), "first-posts")
    pairs = near_pairs(nodes.select("scope", "fp"))
    ends = shuffled(nodes.select("fp", "post_id"))
    near = ordered_edges(pairs, nodes).select(
        "early", "late", F.bit_count(F.col("early").bitwiseXOR(F.col("late"))).alias("distance")
    ).join(ends.select(F.col("fp").alias("early"), F.col("post_id").alias("early_post")), "early").join(
        ends.select(F.col("fp").alias("late"), F.col("post_id").alias("late_post")), "late"
    ).select("early_post", "late_post", "distance")
    # equal fingerprints: one row per copy and its first post, not all pairs of copies
    copies = prints.join(ends.select(F.col("fp").alias("simhash"), F.col("post_id").alias("early_post")), "simhash")
    copies = copies.filter("post_id <> early_post").select("early_post", F.col("post_id").alias("late_post"), F.lit(0).alias("distance"))
    return near.unionByName(copies)


def near_dup_pairs_wide(spark, sf):
    """Above the thresholds that masks serve: pairs that share a band, at distance 8 at most."""
    nodes = stage(first_posts(_prints(spark, sf)), "first-posts")
    # there are far more pairs than nodes: the posts travel with the bands, and no pair is shuffled
    pairs = near_pairs(nodes, threshold=8, carry=ARRIVAL)
    return ordered_edges(pairs, nodes).select(
        F.col("early_rank.post_id").alias("early_post"), F.col("rank.post_id").alias("late_post"),
        F.bit_count(F.col("early").bitwiseXOR(F.col("late"))).alias("distance"),
    )


def dedup(spark, sf):
    p = posts(spark, sf)
    return drop_near_duplicates(p, _prints(spark, sf).select("seq", "post_id", "simhash")).select("post_id", "simhash")


def dedup_scoped(spark, sf):
    p = posts(spark, sf)
    return drop_near_duplicates(
        p, _prints(spark, sf), scope=("projectId", "type")
    ).select("post_id", "projectId", "type", "simhash")


def bucket_ttl(spark, sf):
    adds = events(spark, sf).select(
        (F.col("user_id") % 4).cast("int").alias("bucket_idx"), F.col("user_id").alias("fragment"),
        F.col("event_id").alias("fp"), F.col("ts").alias("added_at"),
    )
    return visible_members(adds, F.timestamp_seconds(F.lit(NOW)), PARAMS.ttl_seconds, ("bucket_idx", "fragment")).select(
        "fragment", "fp", bucket_key(F.col("bucket_idx"), F.col("fragment")).alias("bucket")
    )


# -- vectors --------------------------------------------------------------------------

def point_id(spark, sf):
    return with_point_ids(posts(spark, sf).withColumn("raw_id", F.col("post_id"))).select("raw_id", "qdrant_point_id")


def stored_payload(spark, sf):
    """What is stored next to a vector, a field that no operator knows included."""
    arrived = posts(spark, sf).withColumn("raw_id", F.col("post_id")).withColumn("desk", F.concat(F.lit("desk "), "type"))
    stored = payload(with_point_ids(arrived.withColumn("embedding", F.array(F.lit(0.0)))))
    return stored.select("post_id", *[c for c in stored.columns if c not in ("post_id", "keywords", "exclusions", "arrival", "timestamp")])


def embedding_cells(spark, sf):
    """One row per post: the width of its vector and how many cells are filled, none without tokens."""
    embedded = embed(posts(spark, sf), HashedEmbedder(PARAMS.dim))
    filled = F.size(F.filter("embedding", lambda x: x != 0))
    return embedded.select("post_id", F.size("embedding").alias("dim"), filled.alias("non_zero"))


def hashed_embedding(spark, sf):
    embedded = embed(posts(spark, sf), HashedEmbedder(PARAMS.dim))
    # the outer form, as the inner one would run the embedding once more to look for empty arrays
    cells = embedded.select("post_id", F.posexplode_outer("embedding").alias("cell", "value")).filter(F.col("value") != 0)
    return cells.select("post_id", "cell", F.round(F.col("value").cast("double"), 6).alias("value"))


def blank_embedding(spark, sf):
    """Texts of the conversations with the users' ones blanked."""
    talk = read_table(spark, sf, "conversations").withColumn(
        "text", F.when(F.col("role") == "user", F.lit(" \n")).otherwise(F.col("text"))
    )
    embedded = embed(talk, HashedEmbedder(PARAMS.dim), "text")
    return embedded.select(
        "conv_id", "turn", F.size("embedding").alias("dim"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("non_zero"),
    )


def _table(spark, sf) -> DataFrame:
    return vectors(spark, sf).select(F.col("id").alias("post_id"), "seq", F.col("vec").alias("embedding"), "label")


def _total(column: str) -> Column:
    summed = F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.round(summed, 5)


def vector_upsert(spark, sf):
    table = _table(spark, sf)
    updates = table.select(
        (F.col("seq") * 2).cast("string").alias("post_id"), (F.col("seq") + 1_000_000).alias("seq"), "embedding",
        (F.col("label") + 100).alias("label"),
    )
    return upsert(table, updates).select("post_id", "seq", "label", _total("embedding").alias("total"))


def payload_merge(spark, sf):
    table = _table(spark, sf).drop("embedding")
    patch = table.select(
        (F.col("seq") * 2).cast("string").alias("post_id"), (F.col("label") + 100).alias("label"),
        F.concat(F.lit("cluster-"), F.col("seq")).alias("cluster_id"),
    )
    return merge_payload(table, patch)


def vector_lookup(spark, sf):
    found = lookup(posts(spark, sf).withColumn("qdrant_point_id", F.col("post_id")), _table(spark, sf))
    return found.select("qdrant_point_id", "projectId", _total("embedding").alias("total"))


def missing_vectors(spark, sf):
    p = posts(spark, sf).withColumn("qdrant_point_id", F.col("post_id"))
    return missing(p, _table(spark, sf)).select("qdrant_point_id", "projectId")


def keyword_set(spark, sf):
    return keyword_sets(posts(spark, sf)).select(F.array_join("keyword_set", "|").alias("keyword_set"))


def _relevant(spark, sf) -> DataFrame:
    embedder = HashedEmbedder(PARAMS.dim)
    return score_relevancy(embed(posts(spark, sf), embedder), embedder)


def relevancy(spark, sf):
    return _relevant(spark, sf).select("post_id", "relevancy")


# -- neighbours and clusters ----------------------------------------------------------

def knn_topk(spark, sf):
    found = similar_posts(vectors(spark, sf), PARAMS.top_k)
    return found.select("id", "neighbor_id", "rank", F.round("score", 6).alias("score"))


def similar_posts_query(spark, sf):
    """For each benchmark text, the three documents most like it."""
    embedder = HashedEmbedder(PARAMS.dim)
    base = embed(posts(spark, sf), embedder).select(F.col("post_id").alias("id"), "seq", F.col("embedding").alias("vec"))
    wanted = embed(read_table(spark, sf, "benchmark"), embedder, "text").select(
        F.concat(F.lit("item-"), F.col("item_id")).alias("id"), F.col("item_id").alias("seq"), F.col("embedding").alias("vec")
    )
    found = similar_to(stage(base, "vectors"), wanted, 3)
    return found.select("id", "neighbor_id", "rank", F.round("score", 6).alias("score"))


def cluster_assign(spark, sf):
    found = assign_clusters(vectors(spark, sf), PARAMS.similarity_threshold)
    return found.select("id", "cluster_id", F.round("similarity_score", 6).alias("similarity_score"))


def cluster_assign_default(spark, sf):
    found = assign_clusters(vectors(spark, sf), Params().similarity_threshold)
    return found.select("id", "cluster_id", F.round("similarity_score", 6).alias("similarity_score"))


def cluster_meta_query(spark, sf):
    meta = cluster_meta(assign_clusters(vectors(spark, sf), PARAMS.similarity_threshold))
    return meta.withColumn("last_similarity", F.round("last_similarity", 6))


def cluster_rollup(spark, sf):
    v = vectors(spark, sf)
    clustered = assign_clusters(v, PARAMS.similarity_threshold).join(v.select("id", "label"), "id")
    rows = with_tone(clustered.select(
        F.col("id").alias("post_id"), "seq", "cluster_id", F.col("label").cast("string").alias("projectId"),
        F.col("id").alias("title"), F.lit("").alias("content"), F.lit("vector").alias("type"),
        F.lit("").alias("url_string"), F.lit(0).alias("relevancy"),
    ))
    return roll_up(rows, posts_per_row=2).select(
        "clusterId", "projectId", "part", F.size("posts").alias("n_posts"),
        F.array_join(F.transform("posts", lambda p: p["title"]), ",").alias("titles"),
    )


def _assigned(events_: DataFrame) -> DataFrame:
    return events_.select(
        F.concat(F.lit("cluster-"), F.col("user_id")).alias("cluster_id"), "ts", F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("post_id"), F.col("value").alias("similarity_score"),
    )


def ttl_sessions(spark, sf):
    return meta_sessions(_assigned(events(spark, sf)), PARAMS.ttl_seconds)


# -- tone and output ------------------------------------------------------------------

def tone(spark, sf):
    return with_tone(posts(spark, sf)).select("post_id", "tone", "tone_score", "tone_confidence")


def tone_scores(spark, sf):
    labelled = with_tone(posts(spark, sf))
    return labelled.groupBy("projectId", "tone").agg(
        F.count("*").alias("n"), F.round(F.avg(tone_score(F.col("tone"))), 6).alias("avg_score")
    )


def _stages(spark, sf):
    return monitor(posts(spark, sf), PARAMS)


def brand_monitor(spark, sf):
    """The whole way from documents to scored posts."""
    return _stages(spark, sf).scored.select(
        "post_id", "projectId", "simhash", "relevancy", "cluster_id",
        F.round("similarity_score", 6).alias("similarity_score"), "tone", "tone_score",
    )


def clustering_dead_letters(spark, sf):
    """Posts of two sources come without an id; counted by project as clustering rejects them."""
    p = posts(spark, sf)
    lost = p.withColumn("post_id", F.when(~F.col("type").isin("src4", "src5"), F.col("post_id")))
    stages = monitor(lost, PARAMS)
    project = F.get_json_object("_raw", "$.projectId")
    out = stages.dead.groupBy("_stage", "_error", project.alias("projectId")).agg(F.count("*").alias("n"))
    kept = stages.scored.groupBy("projectId").agg(F.count("*").alias("n"))
    return out.unionByName(kept.select(F.lit("kept").alias("_stage"), F.lit("").alias("_error"), "projectId", "n"))


def results(spark, sf):
    nested = _stages(spark, sf).results
    return nested.select("clusterId", "projectId", F.inline("posts")).select(
        "clusterId", "projectId", "title", "content", "type", "url_string", "metrics.relevancy", "metrics.tone"
    )


def results_flat(spark, sf):
    """Tone and relevancy of all documents, read back from the nested results."""
    scored = with_tone(_relevant(spark, sf)).withColumn("cluster_id", name_uuid(F.col("type"))).withColumn(
        "title", F.col("content")
    )
    return flatten_results(format_results(scored, PARAMS.content_cut))


def results_display(spark, sf):
    scored = with_tone(_relevant(spark, sf)).withColumn("cluster_id", name_uuid(F.col("type"))).withColumn(
        "title", F.col("content")
    )
    return display_results(format_results(scored, PARAMS.content_cut))


def latency(spark, sf):
    stamped = events(spark, sf).select("event_type", (F.unix_micros("ts") / 1e6).alias("timestamp"))
    measured = with_latency(stamped, F.lit(1706659200.0))
    return measured.groupBy("event_type").agg(
        F.count("latency").alias("n"), F.round(F.avg("latency"), 3).alias("avg_latency"),
        F.round(F.max("latency"), 3).alias("max_latency"),
    )


def receive_count(spark, sf):
    stamped = events(spark, sf).select("event_type", (F.unix_micros("ts") / 1e6).alias("timestamp"))
    return receive_stats(stamped, "event_type").withColumn("elapsed", F.round("elapsed", 3))


def negative_feed_query(spark, sf):
    return negative_feed(with_tone(_relevant(spark, sf)), 3).select("post_id", "projectId", "relevancy", "tone")


# -- alerts and health ----------------------------------------------------------------

def spike_alerts_query(spark, sf):
    found = spike_alerts(events(spark, sf).withColumnRenamed("event_type", "projectId"), WINDOW, SPIKE, COOLDOWN)
    return found.select("projectId", F.unix_seconds("window_start").alias("window_epoch"), "n")


def health_query(spark, sf):
    # the marks alone: texts are neither shuffled nor written
    marks = mark(posts(spark, sf)).select("seq", "post_id", "projectId", "_pass")
    prints = _prints(spark, sf).select("seq", "post_id", "simhash")
    marked = stage(marks.join(shuffled(prints), ["seq", "post_id"]), "marked")
    passed = marked.filter("_pass")
    kept = drop_near_duplicates(passed.drop("simhash"), passed.select("seq", "post_id", "simhash"))
    stages = {
        "received": marked, "filtered_out": marked.filter("NOT _pass"), "passed": passed, "unique": kept,
    }
    return health(stages, F.col("seq"), "projectId")


# -- streaming ------------------------------------------------------------------------

def streaming_results(spark, sf):
    """The documents as a stream of JSON files, in four micro-batches by ranges of ids."""
    folder, batches = new_path(spark, "stream"), 4
    source = posts(spark, sf)
    last = source.agg(F.max("seq")).first()[0] or 0
    files = spark.sparkContext.defaultParallelism
    for k in range(batches):
        part = source.filter(F.floor(F.col("seq") * batches / (last + 1)) == k).drop("seq", "arrival")
        to_messages(part).repartition(files).write.mode("append").text(f"{folder}/in")
    stream = StreamingMonitor(spark, f"{folder}/state", PARAMS)
    stream.start(stream_lines(spark, f"{folder}/in", files), f"{folder}/checkpoint").awaitTermination()
    return stream.read_results().select("clusterId", "projectId", F.inline("posts")).select(
        "clusterId", "projectId", "title", "content", "type", "url_string", "metrics.relevancy", "metrics.tone"
    )


def _events_in_order(source: DataFrame, folder: str, batches: int = 4) -> DataFrame:
    """Rows with a time ``ts`` as a stream in ``batches`` ranges of time, one per micro-batch."""
    spark = source.sparkSession
    first, last = source.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    first, last = first or 0, last or 0
    files = spark.sparkContext.defaultParallelism
    place = F.floor((F.unix_micros("ts") - first) * batches / (last + 1 - first))
    for k in range(batches):
        source.filter(place == k).repartition(files).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def streaming_alerts(spark, sf):
    """The events as a stream in order of time, and a last event that closes all windows."""
    folder = new_path(spark, "stream")
    source = events(spark, sf).select(F.col("event_type").alias("projectId"), "ts")
    stream = _events_in_order(source, folder)
    end = source.agg(F.timestamp_micros(F.max(F.unix_micros("ts")) + 10 * WINDOW * 1_000_000).alias("ts"))
    end.select(F.lit("end").alias("projectId"), "ts").write.mode("append").parquet(f"{folder}/in")
    alerts = StreamingAlerts(spark, f"{folder}/state", WINDOW, SPIKE, COOLDOWN)
    alerts.start(stream, f"{WINDOW} seconds", f"{folder}/checkpoint").awaitTermination()
    return alerts.read_alerts().select("projectId", F.unix_seconds("window_start").alias("window_epoch"), "n")


def streaming_bucket_ttl(spark, sf):
    """``bucket_ttl`` with the adds as a stream and one row of state per bucket."""
    folder = new_path(spark, "stream")
    stream = _events_in_order(events(spark, sf), folder).select(
        (F.col("user_id") % 4).cast("int").alias("bucket_idx"), F.col("user_id").alias("fragment"),
        F.col("event_id").alias("fp"), F.col("ts").alias("added_at"),
    )
    store = BucketStore(spark, f"{folder}/state", "bucket_idx int, fragment bigint", "fp bigint", PARAMS.ttl_seconds)
    store.start(stream, f"{folder}/checkpoint").awaitTermination()
    return store.visible(F.timestamp_seconds(F.lit(NOW))).select(
        "fragment", "fp", bucket_key(F.col("bucket_idx"), F.col("fragment")).alias("bucket")
    )


def streaming_cluster_meta(spark, sf):
    """``ttl_sessions`` with the assignments as a stream and one row of state per cluster."""
    folder = new_path(spark, "stream")
    stats = ClusterStats(spark, f"{folder}/state", PARAMS.ttl_seconds)
    stream = _assigned(_events_in_order(events(spark, sf), folder))
    stats.start(stream, f"{folder}/checkpoint").awaitTermination()
    return stats.read()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "brand_monitor": brand_monitor,
    "split_batch": split_batch,
    "exclusion_precedence": exclusion_precedence,
    "batch_messages": batch_messages,
    "post_messages": post_messages,
    "dead_letter": dead_letter,
    "required_ids": required_ids,
    "handoff_json": handoff_json,
    "prefilter": prefilter_query,
    "prefilter_no_keywords": prefilter_no_keywords,
    "prefilter_lemma": prefilter_lemma,
    "prefilter_many": prefilter_many,
    "lemmatize_text": lemmatize_text,
    "lemma_plugin": lemma_plugin,
    "lemmatize_keyword": lemmatize_keyword,
    "simhash": simhash,
    "simhash_buckets": simhash_buckets,
    "simhash_bucket_members": simhash_bucket_members,
    "near_dup_pairs": near_dup_pairs,
    "near_dup_pairs_wide": near_dup_pairs_wide,
    "dedup": dedup,
    "dedup_scoped": dedup_scoped,
    "bucket_ttl": bucket_ttl,
    "point_id": point_id,
    "stored_payload": stored_payload,
    "hashed_embedding": hashed_embedding,
    "embedding_cells": embedding_cells,
    "blank_embedding": blank_embedding,
    "vector_upsert": vector_upsert,
    "payload_merge": payload_merge,
    "vector_lookup": vector_lookup,
    "missing_vectors": missing_vectors,
    "keyword_sets": keyword_set,
    "relevancy": relevancy,
    "knn_topk": knn_topk,
    "similar_posts": similar_posts_query,
    "cluster_assign": cluster_assign,
    "cluster_assign_default": cluster_assign_default,
    "cluster_meta": cluster_meta_query,
    "cluster_rollup": cluster_rollup,
    "ttl_sessions": ttl_sessions,
    "tone": tone,
    "tone_scores": tone_scores,
    "clustering_dead_letters": clustering_dead_letters,
    "results": results,
    "results_flat": results_flat,
    "results_display": results_display,
    "latency": latency,
    "receive_count": receive_count,
    "negative_feed": negative_feed_query,
    "spike_alerts": spike_alerts_query,
    "health": health_query,
    "streaming_results": streaming_results,
    "streaming_alerts": streaming_alerts,
    "streaming_bucket_ttl": streaming_bucket_ttl,
    "streaming_cluster_meta": streaming_cluster_meta,
}
