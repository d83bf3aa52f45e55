"""The same queries as SQL for DuckDB, put together from shared common tables."""

from __future__ import annotations

from mentionlake.plans.catalog import (
    BATCH, COOLDOWN, EXCLUSIONS, KEYWORDS, LEMMA_EXCLUSIONS, LEMMA_KEYWORDS, PARAMS, SPIKE, SUFFIX, WINDOW,
)

# Fixed values, written out here so that a wrong one in the code under test shows:
# the URL namespace of RFC 4122, the scores of the tone labels, their titles.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
TONE_SCORES = {"negative": 0.15, "neutral": 0.5, "positive": 0.85}
TONE_TITLES = {"negative": "🔴 negative", "neutral": "🟡 neutral", "positive": "🟢 positive"}

_WS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[{_WS}]+'), lambda w: w <> '')"


def _bare(text: str) -> str:
    return _words(f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_{_WS}]+', '', 'g')")


def _signed(word: str) -> str:
    return f"CASE WHEN {word} >= 9223372036854775808 THEN ({word}::HUGEINT - 18446744073709551616)::BIGINT ELSE {word}::BIGINT END"


def _id_hash(value: str) -> str:
    return f"concat('0x', substr(md5({value}), 1, 8))::BIGINT"


def _uuid5(name: str) -> str:
    digest = f"sha1(unhex('{URL_NAMESPACE}') || encode({name}))"
    nibble = f"(concat('0x', substr({digest}, 17, 1))::INT % 4 + 1)::INT"
    return (
        f"concat(substr({digest}, 1, 8), '-', substr({digest}, 9, 4), '-5', substr({digest}, 14, 3), '-', "
        f"substr('89ab', {nibble}, 1), substr({digest}, 18, 3), '-', substr({digest}, 21, 12))"
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def _per_language(values: dict[str, list[str]]) -> str:
    cases = " ".join(f"WHEN '{lang}' THEN {_list(v)}" for lang, v in values.items())
    return f"CASE lang {cases} ELSE []::VARCHAR[] END"


def _with(*parts: str) -> str:
    """WITH the named tables, each after those it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            add(other)
        if name not in order:
            order.append(name)

    for part in parts:
        add(part)
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({_TABLES[name]})" for name in order) + " "


_TABLES: dict[str, str] = {}
_NEEDS: dict[str, tuple[str, ...]] = {}


def _table(name: str, sql: str, *needs: str) -> None:
    _TABLES[name], _NEEDS[name] = sql, needs


_table("posts", f"""
    SELECT doc_id AS seq, doc_id::VARCHAR AS post_id, lang AS "projectId", '' AS title, text AS content,
           source AS type, '' AS url_string, doc_id::DOUBLE AS ts,
           {_per_language(KEYWORDS)} AS keywords, {_per_language(EXCLUSIONS)} AS exclusions
    FROM documents""")

_table("matched", f"""
    SELECT *, NOT (len(list_filter(exclusions, lambda e: contains(low, lower(e)))) > 0)
              AND (len(keywords) = 0 OR len(list_filter(keywords, lambda k: contains(low, lower(k)) OR contains(joined, lower(k)))) > 0) AS pass
    FROM (SELECT *, array_to_string({_words('low')}, ' ') AS joined
          FROM (SELECT *, lower(concat(title, ' ', content)) AS low FROM posts))""", "posts")

_table("token_hashes", f"""
    SELECT seq, concat('0x', substr(md5(token), 17, 16))::UBIGINT AS h
    FROM (SELECT seq, unnest({_bare("concat(title, ' ', content)")}) AS token FROM posts)""", "posts")

_bits = ", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64))
_print = " + ".join(f"(CASE WHEN coalesce(b{i}, 0) * 2 >= coalesce(n, 0) THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64))
_table("votes", f"SELECT seq, count(*) AS n, {_bits} FROM token_hashes GROUP BY seq", "token_hashes")
_table("raw_prints", f"""
    SELECT p.seq, p.post_id, p."projectId", p.type, ({_print})::UBIGINT AS word
    FROM posts p LEFT JOIN votes v ON p.seq = v.seq""", "posts", "votes")
_table("prints", f"""
    SELECT seq, post_id, "projectId", type, word, {_signed('word')} AS simhash FROM raw_prints""", "raw_prints")
_table("bands", """
    SELECT post_id, word, i::INT AS bucket_idx, ((word >> (16 * i)::UBIGINT) & 65535)::INT AS fragment
    FROM prints, (SELECT unnest([0, 1, 2, 3])::UBIGINT AS i)""", "prints")
_table("buckets", """
    SELECT *, concat('simhash_bucket:', bucket_idx, ':', lpad(bin(fragment), 16, '0')) AS bucket FROM bands""", "bands")
_table("first_posts", "SELECT word, min(seq) AS seq FROM prints GROUP BY word", "prints")


def _greedy(name: str, source: str, scope: str) -> None:
    """First-wins over the rows of ``source`` (seq, word, and what ``scope`` needs)."""
    _table(f"{name}_rows", f"SELECT *, {scope} AS scope, row_number() OVER (ORDER BY seq) AS rn FROM {source}", source)
    _table(f"{name}_steps", f"""
        SELECT 0::BIGINT AS rn, []::STRUCT(s VARCHAR, w UBIGINT)[] AS kept, false AS keep
        UNION ALL
        SELECT rn, CASE WHEN keep THEN list_append(kept, {{'s': scope, 'w': word}}) ELSE kept END, keep
        FROM (SELECT r.rn, t.kept, r.scope, r.word,
                     len(list_filter(t.kept, lambda k: k.s = r.scope AND bit_count(xor(k.w, r.word)) <= 3)) = 0 AS keep
              FROM {name}_steps t JOIN {name}_rows r ON r.rn = t.rn + 1)""", f"{name}_rows")
    _table(f"{name}_kept", f"""
        SELECT r.* FROM {name}_rows r JOIN {name}_steps t ON r.rn = t.rn WHERE t.keep""", f"{name}_steps")


_greedy("plain", "prints", "''")
_greedy("scoped", "prints", "concat(\"projectId\", '|', type)")
_table("passed_prints", "SELECT p.* FROM prints p JOIN matched m ON p.seq = m.seq WHERE m.pass", "prints", "matched")
_greedy("passed", "passed_prints", "''")

# -- hashed vectors: one row per non-zero cell -----------------------------------------


def _cells(source: str, key: str, text: str) -> str:
    return f"""
        SELECT {key}, cell, (s / norm)::FLOAT AS value
        FROM (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY {key})) AS norm
              FROM (SELECT {key}, ((h >> 1) % {PARAMS.dim})::INT AS cell,
                           sum(CASE WHEN h & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s
                    FROM (SELECT {key}, concat('0x', substr(md5(token), 17, 16))::UBIGINT AS h
                          FROM (SELECT {key}, unnest({_bare(text)}) AS token FROM {source}))
                    GROUP BY {key}, 2))
        WHERE s <> 0"""


_table("cells", _cells("posts", "seq", "content"), "posts")
_table("keyword_words", "SELECT DISTINCT unnest(keywords) AS keyword FROM posts", "posts")
_table("keyword_cells", _cells("keyword_words", "keyword", "keyword"), "keyword_words")
_table("similarities", """
    SELECT p.seq, k.keyword, sum(c.value::DOUBLE * k.value::DOUBLE) AS sim
    FROM (SELECT seq, unnest(keywords) AS keyword FROM posts) p
    JOIN keyword_cells k ON k.keyword = p.keyword JOIN cells c ON c.seq = p.seq AND c.cell = k.cell
    GROUP BY p.seq, k.keyword""", "posts", "keyword_cells", "cells")
_table("relevant", """
    SELECT p.*, least(100, greatest(0, round_even(100 * greatest(0.0, coalesce(s.sim, 0.0)), 0)))::INT AS relevancy
    FROM posts p LEFT JOIN (SELECT seq, max(sim) AS sim FROM similarities GROUP BY seq) s ON s.seq = p.seq""",
       "posts", "similarities")

_labels = "[" + ", ".join(f"'{t}'" for t in TONE_SCORES) + "]"


def _tone(post_id: str) -> str:
    return f"({_labels})[({_id_hash(post_id)} % 3 + 1)::INT]"


def _tone_score(label: str) -> str:
    return f"CASE {label} " + " ".join(f"WHEN '{t}' THEN {s}::DOUBLE" for t, s in TONE_SCORES.items()) + " END"


_table("toned", f"""
    SELECT *, {_tone_score('tone')} AS tone_score,
           (60 + {_id_hash("concat(post_id, '#confidence')")} % 40) / 100.0::DOUBLE AS tone_confidence
    FROM (SELECT *, {_tone('post_id')} AS tone FROM relevant)""", "relevant")


# -- clusters --------------------------------------------------------------------------


def _forest(name: str, scores: str, nodes: str, threshold: float) -> None:
    """``scores``: (seq, other, score) of earlier rows; ``nodes``: seq, id."""
    _table(f"{name}_best", f"""
        SELECT seq, other, score FROM (
            SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, other) AS rn FROM {scores} WHERE score > 0)
        WHERE rn = 1""", scores)
    _table(f"{name}_links", f"""
        SELECT n.seq, n.id, CASE WHEN b.score >= {threshold} THEN b.other END AS parent, coalesce(b.score, 0.0) AS score
        FROM {nodes} n LEFT JOIN {name}_best b ON b.seq = n.seq""", f"{name}_best", nodes)
    _table(f"{name}_walk", f"""
        SELECT seq, seq AS root FROM {name}_links WHERE parent IS NULL
        UNION ALL
        SELECT l.seq, w.root FROM {name}_links l JOIN {name}_walk w ON l.parent = w.seq""", f"{name}_links")
    _table(f"{name}_clusters", f"""
        SELECT l.seq, l.id, concat('cluster-', {_uuid5('r.id')}) AS cluster_id, l.score AS similarity_score
        FROM {name}_links l JOIN {name}_walk w ON w.seq = l.seq JOIN {name}_links r ON r.seq = w.root""",
           f"{name}_walk", f"{name}_links")


_table("vector_nodes", "SELECT vec_id AS seq, vec_id::VARCHAR AS id, label, embedding::DOUBLE[] AS v FROM embeddings")
_table("vector_pairs", """
    SELECT a.seq, b.seq AS other, round(list_cosine_similarity(a.v, b.v), 9) AS score
    FROM vector_nodes a JOIN vector_nodes b ON a.seq <> b.seq""", "vector_nodes")
_table("vector_scores", "SELECT * FROM vector_pairs WHERE other < seq", "vector_pairs")
_forest("low", "vector_scores", "vector_nodes", PARAMS.similarity_threshold)
_forest("high", "vector_scores", "vector_nodes", 0.82)

_table("unique_nodes", f"SELECT seq, {_uuid5('post_id')} AS id, simhash FROM passed_kept", "passed_kept")
_table("unique_cells", """
    SELECT c.seq, c.cell, c.value::DOUBLE / sqrt(sum(c.value::DOUBLE * c.value::DOUBLE) OVER (PARTITION BY c.seq)) AS value
    FROM cells c JOIN unique_nodes u ON u.seq = c.seq""", "cells", "unique_nodes")
_table("unique_scores", """
    SELECT a.seq, b.seq AS other, round(sum(a.value * b.value), 9) AS score
    FROM unique_cells a JOIN unique_cells b ON a.cell = b.cell AND b.seq < a.seq GROUP BY a.seq, b.seq""", "unique_cells")
_forest("story", "unique_scores", "unique_nodes", PARAMS.similarity_threshold)
_table("scored", f"""
    SELECT u.id AS post_id, r.seq, r."projectId", u.simhash, r.relevancy, c.cluster_id, c.similarity_score,
           {_tone('u.id')} AS tone, r.title, r.content, r.type, r.url_string
    FROM unique_nodes u JOIN relevant r ON r.seq = u.seq JOIN story_clusters c ON c.seq = u.seq""",
       "unique_nodes", "relevant", "story_clusters")

# -- conversations as batches ----------------------------------------------------------

_table("talk", f"""
    SELECT *, concat(conv_id, '-', (turn // {BATCH})::BIGINT) AS batch_id,
           (row_number() OVER (PARTITION BY conv_id, turn // {BATCH} ORDER BY turn) - 1)::INT AS pos,
           max(role) OVER (PARTITION BY conv_id, turn // {BATCH}) = 'user' AS has_user
    FROM conversations""")

# -- lemmas ----------------------------------------------------------------------------

_table("lemmas", f"""
    SELECT token, lemma FROM (
        SELECT token, CASE WHEN length(token) > 5 THEN regexp_replace(token, '{SUFFIX}', '') ELSE token END AS lemma
        FROM (SELECT DISTINCT unnest({_words('lower(content)')}) AS token FROM posts))
    WHERE token <> lemma""", "posts")
_table("lemma_tokens", f"""
    SELECT t.seq, t.pos, coalesce(l.lemma, t.token) AS lemma
    FROM (SELECT seq, unnest(w) AS token, unnest(range(len(w))) AS pos
          FROM (SELECT seq, {_words('lower(content)')} AS w FROM posts)) t
    LEFT JOIN lemmas l ON l.token = t.token""", "posts", "lemmas")
_table("lemma_texts", """
    SELECT p.post_id, p.seq, coalesce(t.lemmas, '') AS lemmas, coalesce(t.list, []) AS list
    FROM posts p LEFT JOIN (SELECT seq, string_agg(lemma, ' ' ORDER BY pos) AS lemmas, list(lemma) AS list
                            FROM lemma_tokens GROUP BY seq) t ON t.seq = p.seq""", "posts", "lemma_tokens")
_table("term_lemmas", f"""
    SELECT w.term, coalesce(l.lemma, w.term) AS lemma
    FROM (SELECT lower(unnest({_list(LEMMA_KEYWORDS + LEMMA_EXCLUSIONS)})) AS term) w
    LEFT JOIN lemmas l ON l.token = w.term""", "lemmas")
_table("lemma_hits", f"""
    SELECT p.seq,
        (SELECT count(*) FROM (SELECT unnest({_list(LEMMA_EXCLUSIONS)}) AS e) x JOIN term_lemmas t ON t.term = lower(x.e)
         WHERE list_contains(s.list, t.lemma) OR contains(lower(p.content), t.term)) AS excluded,
        (SELECT count(*) FROM (SELECT unnest({_list(LEMMA_KEYWORDS)}) AS k) x JOIN term_lemmas t ON t.term = lower(x.k)
         WHERE contains(s.lemmas, t.term) OR contains(s.lemmas, t.lemma) OR contains(lower(p.content), t.term)) AS wanted
    FROM posts p JOIN lemma_texts s ON s.seq = p.seq""", "posts", "lemma_texts", "term_lemmas")

# -- benchmark texts as queries --------------------------------------------------------

_table("item_cells", _cells("benchmark", "item_id", "text"))
_table("item_scores", """
    SELECT i.item_id, c.seq, round(sum(i.value::DOUBLE * c.value::DOUBLE) / (any_value(i.norm) * any_value(c.norm)), 9) AS score
    FROM (SELECT *, sqrt(sum(value::DOUBLE * value::DOUBLE) OVER (PARTITION BY item_id)) AS norm FROM item_cells) i
    JOIN (SELECT *, sqrt(sum(value::DOUBLE * value::DOUBLE) OVER (PARTITION BY seq)) AS norm FROM cells) c ON c.cell = i.cell
    GROUP BY i.item_id, c.seq""", "item_cells", "cells")

# -- activity --------------------------------------------------------------------------

_TTL = PARAMS.ttl_seconds * 1_000_000


def _sessions(key: str) -> str:
    return f"""
        SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS session,
               max(ts) OVER (PARTITION BY {key}) AS last_ts
        FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id)) >= {_TTL}
                             THEN 1 ELSE 0 END AS fresh FROM events)"""


_table("sessions", _sessions("user_id"))
_table("spikes", f"""
    SELECT event_type, (epoch_us(ts) // 1000000 // {WINDOW} * {WINDOW})::BIGINT AS w, count(*) AS n
    FROM events GROUP BY 1, 2 HAVING count(*) >= {SPIKE}""")
_table("onward", f"""
    SELECT a.event_type, a.w, min(b.w) AS next FROM spikes a
    LEFT JOIN spikes b ON b.event_type = a.event_type AND b.w >= a.w + {COOLDOWN} GROUP BY 1, 2""", "spikes")
_table("fired", """
    SELECT event_type, min(w) AS w FROM spikes GROUP BY event_type
    UNION ALL
    SELECT o.event_type, o.next FROM fired f JOIN onward o ON o.event_type = f.event_type AND o.w = f.w
    WHERE o.next IS NOT NULL""", "onward")

_bar = "concat('[', repeat('█', relevancy // 10), repeat('░', 10 - relevancy // 10), '] ', relevancy, '%')"
_titles = "CASE tone " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in TONE_TITLES.items()) + " ELSE concat('? ', tone) END"
_RESULT_ROWS = f"""
    SELECT cluster_id AS "clusterId", "projectId", title, substr(content, 1, {PARAMS.content_cut}) AS content, type,
           url_string, relevancy, tone FROM scored"""


def _damage() -> str:
    """Errors of the damaged messages, by source."""
    return """CASE type WHEN 'src7' THEN 'invalid JSON' WHEN 'src8' THEN 'message is no object'
              WHEN 'src9' THEN 'title is no text' WHEN 'src10' THEN 'title is no text' END"""


def _clusters(name: str) -> str:
    return _with(f"{name}_clusters") + (
        f"SELECT id, cluster_id, round(similarity_score, 6) AS similarity_score FROM {name}_clusters"
    )


ORACLE: dict[str, str] = {
    "brand_monitor": _with("scored") + f"""
        SELECT post_id, "projectId", simhash, relevancy, cluster_id, round(similarity_score, 6) AS similarity_score,
               tone, {_tone_score('tone')} AS tone_score FROM scored""",
    "results": _with("scored") + _RESULT_ROWS,
    "streaming_results": _with("scored") + _RESULT_ROWS,
    "split_batch": _with("talk") + f"""
        SELECT {_uuid5("concat('talk#', batch_id, '#', pos)")} AS post_id, batch_id, pos, 'talk' AS "projectId",
               '' AS title, text AS content, role AS type, concat('conv://', conv_id) AS url_string FROM talk""",
    "exclusion_precedence": _with("talk") + """
        SELECT batch_id, CASE WHEN bool_or(has_user) THEN '' ELSE 'spam' END AS exclusions, count(*)::INT AS n_posts
        FROM talk GROUP BY batch_id""",
    "batch_messages": _with("talk") + """
        SELECT 'talk' AS "projectId", '' AS title, text AS content, role AS type, concat('conv://', conv_id) AS url_string,
               'the,der' AS keywords, CASE WHEN has_user THEN '' ELSE 'spam' END AS exclusions, pos::BIGINT AS pos
        FROM talk""",
    "post_messages": _with("posts") + f"""
        SELECT post_id, "projectId", title, content, type, url_string, ts AS timestamp FROM posts
        WHERE {_damage()} IS NULL""",
    "required_ids": _with("posts") + """
        SELECT "projectId", count(*) AS n, count(*) FILTER (type = 'src4') AS n_dead FROM posts GROUP BY 1""",
    "handoff_json": _with("posts") + 'SELECT post_id, "projectId", content, seq FROM posts',
    "prefilter": _with("matched") + 'SELECT post_id, "projectId" FROM matched WHERE pass',
    "prefilter_no_keywords": _with("posts") + """
        SELECT post_id, "projectId" FROM posts
        WHERE len(list_filter(exclusions, lambda e: contains(lower(content), lower(e)))) = 0""",
    "prefilter_lemma": _with("lemma_hits") + """
        SELECT p.post_id, p."projectId" FROM posts p JOIN lemma_hits h ON h.seq = p.seq
        WHERE h.excluded = 0 AND h.wanted > 0""",
    "lemmatize_text": _with("lemma_texts") + "SELECT post_id, lemmas FROM lemma_texts",
    "lemmatize_keyword": _with("lemmas") + f"""
        SELECT w.term, coalesce(l.lemma, lower(w.term)) AS lemma
        FROM (SELECT DISTINCT unnest({_words('text')}) AS term FROM benchmark) w
        LEFT JOIN lemmas l ON l.token = lower(w.term)""",
    "simhash": _with("prints") + "SELECT post_id, simhash FROM prints",
    "simhash_buckets": _with("buckets") + "SELECT post_id, bucket_idx, fragment, bucket FROM buckets",
    "simhash_bucket_members": _with("buckets") + """
        SELECT bucket, count(DISTINCT word) AS members FROM buckets GROUP BY bucket""",
    "near_dup_pairs": _with("first_posts") + """
        SELECT a.seq::VARCHAR AS early_post, b.seq::VARCHAR AS late_post, bit_count(xor(a.word, b.word))::INT AS distance
        FROM first_posts a JOIN first_posts b ON a.seq < b.seq WHERE bit_count(xor(a.word, b.word)) <= 3
        UNION ALL
        SELECT f.seq::VARCHAR, p.seq::VARCHAR, 0 FROM prints p JOIN first_posts f ON f.word = p.word WHERE p.seq <> f.seq""",
    "near_dup_pairs_wide": _with("first_posts") + """
        SELECT early_post, late_post, bit_count(x)::INT AS distance
        FROM (SELECT a.seq::VARCHAR AS early_post, b.seq::VARCHAR AS late_post, xor(a.word, b.word) AS x
              FROM first_posts a JOIN first_posts b ON a.seq < b.seq)
        WHERE bit_count(x) <= 8 AND ((x & 65535) = 0 OR ((x >> 16) & 65535) = 0 OR ((x >> 32) & 65535) = 0 OR (x >> 48) = 0)""",
    "dedup": _with("plain_kept") + "SELECT post_id, simhash FROM plain_kept",
    "dedup_scoped": _with("scoped_kept") + 'SELECT post_id, "projectId", type, simhash FROM scoped_kept',
    "bucket_ttl": _with("sessions") + f"""
        SELECT user_id AS fragment, event_id AS fp,
               concat('simhash_bucket:', user_id % 4, ':', right(concat('0000000000000000', bin(user_id)), 16)) AS bucket
        FROM (SELECT *, max(session) OVER (PARTITION BY user_id) AS current FROM sessions)
        WHERE session = current AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_ts) < {_TTL}""",
    "point_id": _with("posts") + f"SELECT post_id AS raw_id, {_uuid5('post_id')} AS qdrant_point_id FROM posts",
    "stored_payload": _with("posts") + f"""
        SELECT {_uuid5('post_id')} AS post_id, "projectId", title, content, type, url_string, seq, post_id AS raw_id,
               concat('desk ', type) AS desk FROM posts""",
    "embedding_cells": _with("posts", "cells") + f"""
        SELECT p.post_id, {PARAMS.dim}::INT AS dim, count(c.cell)::INT AS non_zero
        FROM posts p LEFT JOIN cells c ON c.seq = p.seq GROUP BY p.post_id""",
    "hashed_embedding": _with("cells") + """
        SELECT seq::VARCHAR AS post_id, cell, round(value::DOUBLE, 6) AS value FROM cells""",
    "blank_embedding": "WITH talk AS (SELECT *, concat(conv_id, '-', turn) AS k, CASE WHEN role = 'user' THEN '' ELSE text END AS t "
        "FROM conversations), talk_cells AS (" + _cells("talk", "k", "t") + f""")
        SELECT t.conv_id, t.turn, {PARAMS.dim}::INT AS dim, count(c.cell)::INT AS non_zero
        FROM talk t LEFT JOIN talk_cells c ON c.k = t.k GROUP BY t.conv_id, t.turn""",
    "vector_upsert": _with("vector_nodes") + """
        SELECT post_id, seq, label, round(list_sum(v), 5) AS total FROM (
            SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY seq DESC) AS rn FROM (
                SELECT id AS post_id, seq, label, v FROM vector_nodes
                UNION ALL SELECT (seq * 2)::VARCHAR, seq + 1000000, label + 100, v FROM vector_nodes))
        WHERE rn = 1""",
    "payload_merge": _with("vector_nodes") + """
        SELECT a.id AS post_id, a.seq, CASE WHEN b.seq IS NULL THEN a.label ELSE b.label + 100 END AS label,
               CASE WHEN b.seq IS NOT NULL THEN concat('cluster-', b.seq) END AS cluster_id
        FROM vector_nodes a LEFT JOIN vector_nodes b ON a.seq = b.seq * 2""",
    "vector_lookup": _with("posts", "vector_nodes") + """
        SELECT p.post_id AS qdrant_point_id, p."projectId", round(list_sum(v.v), 5) AS total
        FROM posts p JOIN vector_nodes v ON v.id = p.post_id""",
    "missing_vectors": _with("posts", "vector_nodes") + """
        SELECT post_id AS qdrant_point_id, "projectId" FROM posts WHERE post_id NOT IN (SELECT id FROM vector_nodes)""",
    "keyword_sets": _with("posts") + """
        SELECT DISTINCT array_to_string(list_sort(keywords), '|') AS keyword_set FROM posts""",
    "relevancy": _with("relevant") + "SELECT post_id, relevancy FROM relevant",
    "knn_topk": _with("vector_pairs") + f"""
        SELECT seq::VARCHAR AS id, other::VARCHAR AS neighbor_id, rank, round(score, 6) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, other)::INT AS rank FROM vector_pairs)
        WHERE rank <= {PARAMS.top_k}""",
    "similar_posts": _with("item_scores") + """
        SELECT concat('item-', item_id) AS id, seq::VARCHAR AS neighbor_id, rank, round(score, 6) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, seq)::INT AS rank FROM item_scores)
        WHERE rank <= 3""",
    "cluster_assign": _clusters("low"),
    "cluster_assign_default": _clusters("high"),
    "cluster_meta": _with("low_clusters") + """
        SELECT cluster_id, count(*) AS post_count, arg_max(id, seq) AS last_post_id,
               round(arg_max(similarity_score, seq), 6) AS last_similarity FROM low_clusters GROUP BY cluster_id""",
    "cluster_rollup": _with("low_clusters", "vector_nodes") + f"""
        SELECT cluster_id AS "clusterId", label::VARCHAR AS "projectId", part, count(*)::INT AS n_posts,
               string_agg(id, ',' ORDER BY seq) AS titles
        FROM (SELECT c.*, n.label, {_id_hash('c.id')} % ceil(count(*) OVER (PARTITION BY c.cluster_id, n.label) / 2.0)::BIGINT AS part
              FROM low_clusters c JOIN vector_nodes n ON n.seq = c.seq)
        GROUP BY 1, 2, 3""",
    "ttl_sessions": _with("sessions") + """
        SELECT concat('cluster-', user_id) AS cluster_id, count(*) AS post_count,
               arg_max(event_id, event_id)::VARCHAR AS last_post_id, arg_max(value, event_id) AS last_similarity
        FROM (SELECT *, max(session) OVER (PARTITION BY user_id) AS current FROM sessions)
        WHERE session = current GROUP BY user_id""",
    "tone": _with("toned") + "SELECT post_id, tone, tone_score, tone_confidence FROM toned",
    "tone_scores": _with("toned") + """
        SELECT "projectId", tone, count(*) AS n, round(avg(tone_score), 6) AS avg_score FROM toned GROUP BY 1, 2""",
    "results_flat": _with("toned") + f"""
        SELECT "projectId" AS project, {_uuid5('type')} AS cluster, relevancy, tone, substr(content, 1, 50) AS title FROM toned""",
    "results_display": _with("toned") + f"""
        SELECT "projectId" AS project, {_uuid5('type')} AS cluster, substr(content, 1, 50) AS title,
               {_bar} AS relevancy_bar, {_titles} AS tone_title FROM toned""",
    "latency": """
        SELECT event_type, count(*) AS n, round(avg(1706659200.0 - epoch_us(ts) / 1e6), 3) AS avg_latency,
               round(max(1706659200.0 - epoch_us(ts) / 1e6), 3) AS max_latency FROM events GROUP BY 1""",
    "receive_count": """
        SELECT event_type, count(*) AS received, round(max(epoch_us(ts) / 1e6) - min(epoch_us(ts) / 1e6), 3) AS elapsed
        FROM events GROUP BY 1""",
    "negative_feed": _with("toned") + """
        SELECT post_id, "projectId", relevancy, tone FROM toned WHERE tone = 'negative' AND relevancy >= 3""",
    "spike_alerts": _with("fired") + """
        SELECT f.event_type AS "projectId", f.w AS window_epoch, s.n FROM fired f
        JOIN spikes s ON s.event_type = f.event_type AND s.w = f.w""",
    "health": _with("matched", "passed_kept") + """
        SELECT 'received' AS stage, "projectId", count(*) AS n, max(seq) AS last_seen FROM matched GROUP BY 2
        UNION ALL SELECT 'filtered_out', "projectId", count(*), max(seq) FROM matched WHERE NOT pass GROUP BY 2
        UNION ALL SELECT 'passed', "projectId", count(*), max(seq) FROM matched WHERE pass GROUP BY 2
        UNION ALL SELECT 'unique', "projectId", count(*), max(seq) FROM passed_kept GROUP BY 2""",
}
# The text a dead letter keeps is JSON as Spark writes it, so only the errors are counted.
ORACLE["dead_letter"] = _with("posts") + f"""
    SELECT 'intake' AS _stage, {_damage()} AS _error, count(*) AS n FROM posts
    WHERE {_damage()} IS NOT NULL GROUP BY 2"""
ORACLE["streaming_alerts"] = ORACLE["spike_alerts"]
ORACLE["lemma_plugin"] = ORACLE["lemmatize_text"]
ORACLE["streaming_bucket_ttl"] = ORACLE["bucket_ttl"]
ORACLE["streaming_cluster_meta"] = ORACLE["ttl_sessions"]
ORACLE["prefilter_many"] = _with("posts") + f"""
    , terms AS (SELECT DISTINCT unnest({_words('lower(text)')}) AS word FROM benchmark)
    SELECT post_id, "projectId", count(*)::INT AS keywords_found
    FROM posts JOIN terms ON contains(lower(concat(title, ' ', content)), word)
    WHERE NOT list_bool_or(list_transform(list_concat(exclusions, ['\x00']), lambda e: contains(lower(concat(title, ' ', content)), lower(e))))
    GROUP BY 1, 2"""
ORACLE["clustering_dead_letters"] = _with("passed_kept") + """
    SELECT CASE WHEN type IN ('src4', 'src5') THEN 'clustering' ELSE 'kept' END AS _stage,
           CASE WHEN type IN ('src4', 'src5') THEN 'post_id or qdrant_point_id is missing' ELSE '' END AS _error,
           "projectId", count(*) AS n FROM passed_kept GROUP BY 1, 2, 3"""
