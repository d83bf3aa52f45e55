import random

from mentionlake.operators.lemma import build_dictionary, keyword_lists, lemmatize_terms, lemmatize_texts
from mentionlake.operators.prefilter import mark, prefilter
from mentionlake.operators.terms import mark_terms
from pyspark.sql import functions as F

SCHEMA = "post_id string, title string, content string, keywords array<string>, exclusions array<string>"


def passed(spark, rows, dictionary=None):
    posts = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], SCHEMA)
    if dictionary is not None:
        dictionary = spark.createDataFrame(list(dictionary.items()), "token string, lemma string")
    return {int(r.post_id) for r in prefilter(posts, dictionary).collect()}


def plain(title, content, keywords, exclusions, lemma_of):
    """The rule itself, one post at a time."""
    text = f"{title} {content}".lower()
    lemmas = [lemma_of.get(t, t) for t in text.split()]
    joined = " ".join(lemmas)
    for e in map(str.lower, exclusions):
        if lemma_of.get(e, e) in lemmas or e in text:
            return False
    return not keywords or any(
        k in joined or lemma_of.get(k, k) in joined or k in text for k in map(str.lower, keywords)
    )


def test_parts_of_words(spark):
    keywords, exclusions = ["поезд", "вокзал", "рельс"], ["розыгрыш"]
    texts = ["Поезда опаздывают", "Новый вокзал открыт", "Без рельсов никуда", "Розыгрыш билетов на поезд", "Сегодня солнечно"]
    assert passed(spark, [(t, "текст", keywords, exclusions) for t in texts]) == {0, 1, 2}


def test_lists_and_order(spark):
    rows = [
        ("a", "b", [], []), ("a", "b", None, None), ("a", "b", [], ["b"]), ("a", "b", ["a"], ["b"]),
        ("a", "b", [""], []), ("a", "x\n y", ["x y"], []), ("a", "x\n y", ["a x y"], []),
    ]
    assert passed(spark, rows) == {0, 1, 4, 5, 6}


def test_lemma_rules(spark):
    rows = [("", "люди пришли", ["чело"], []), ("", "люди пришли", [], ["чело"]),
            ("", "люди пришли", ["Человек"], []), ("", "люди пришли", [], ["Человек"])]
    assert passed(spark, rows, {"люди": "человек"}) == {0, 1, 2}


def test_against_plain_rule(spark):
    rng = random.Random(5)

    def word(n):
        return "".join(rng.choice("abc") for _ in range(rng.randint(1, n)))

    lemma_of = {word(3): word(3) for _ in range(15)}
    rows = []
    for _ in range(1500):
        content = rng.choice([" ", "  ", "\n"]).join(word(4) for _ in range(rng.randint(0, 4)))
        shapes = [word(4), word(4).upper(), f"{word(3)} {word(3)}", f"{word(2)} {word(2)} {word(2)}", f"{word(2)} ", f" {word(2)}", f"{word(2)}  {word(1)}"]
        keywords = rng.sample(shapes, rng.randint(0, 2))
        exclusions = rng.sample([word(4), f"{word(3)} {word(2)}"], rng.randint(0, 2)) if rng.random() < 0.5 else []
        rows.append((word(3), content, keywords, exclusions))
    for dictionary in (None, lemma_of):
        want = {i for i, r in enumerate(rows) if plain(*r, dictionary or {})}
        assert passed(spark, rows, dictionary) == want


def test_lemmatizers(spark):
    dictionary = spark.createDataFrame([("люди", "человек"), ("дома", "дом")], "token string, lemma string")
    texts = spark.createDataFrame([("1", "Люди  дома, дома\nлюди"), ("2", "")], "post_id string, text string")
    got = {r.post_id: r.lemmas for r in lemmatize_texts(texts, dictionary).collect()}
    assert got == {"1": "человек дома, дом человек", "2": ""}
    terms = spark.createDataFrame([("ЛЮДИ",), ("люди дома",)], "term string")
    assert {r.term: r.lemma for r in lemmatize_terms(terms, dictionary).collect()} == {"ЛЮДИ": "человек", "люди дома": "люди дома"}
    built = build_dictionary(texts, F.col("text"), lambda t: t[:3])
    assert {r.token: r.lemma for r in built.collect()} == {"люди": "люд", "дома,": "дом", "дома": "дом"}


def test_long_lists_like_the_plain_filter(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcД \t") for _ in range(n))
    lists = [("p", [text(rng.randint(2, 4)) for _ in range(40)] + ["a  b", None], [text(6) for _ in range(30)]),
             ("q", [], ["BA", "ba"]), ("r", None, None), (None, ["ab"], []), ("e", [""], [])]
    rows = [(str(i), rng.choice(["p", "p", "q", "r", "e", None, "none"]), text(5), text(12)) for i in range(200)]
    rows.append(("200", "p", None, "abc"))
    rows.append(("201", "r", None, "abc"))
    posts = spark.createDataFrame(rows, "post_id string, projectId string, title string, content string")
    settings = spark.createDataFrame(lists, "projectId string, keywords array<string>, exclusions array<string>")
    of = {p: ([k for k in ks or [] if k is not None], xs or []) for p, ks, xs in lists}
    want = {}
    for i, p, title, content in rows:
        keywords, exclusions = of.get(p, ([], []))
        if title is None:
            want[i] = (0, 0, not keywords and not exclusions)
            continue
        low = f"{title} {content}".lower()
        k = len({k.lower() for k in keywords if k.lower() in low or (any(c.isspace() for c in k) and k.lower() in " ".join(low.split()))})
        x = len({e.lower() for e in exclusions if e.lower() in low})
        want[i] = (k, x, (not keywords or k > 0) and x == 0)
    for characters in (8_000_000, 60):
        got = {r.post_id: (r.keywords_found, r.exclusions_found, r._pass) for r in mark_terms(posts, settings, characters=characters).collect()}
        assert got == want
    assert len({w[2] for w in want.values()}) == 2


def test_long_lists_and_no_posts_or_terms(spark):
    posts = spark.createDataFrame([("1", "p", "", "a")], "post_id string, projectId string, title string, content string")
    settings = spark.createDataFrame([], "projectId string, keywords array<string>, exclusions array<string>")
    assert [r._pass for r in mark_terms(posts, settings).collect()] == [True]
    some = spark.createDataFrame([("p", ["a"], ["b"])], settings.schema)
    assert mark_terms(posts.limit(0), some).count() == 0


def test_lemmas_of_texts_in_chunks(spark):
    """Repeated keys, null keys and null texts, in one chunk or in many; no text is taken apart into rows."""
    rng = random.Random(3)
    lemma_of = {w: w[:1] + "й" for w in ("ab", "abc", "cab", "bb")} | {"ca": "a b", "cc": ""}
    text = lambda: rng.choice([" ", " \n"]).join(rng.choice(["AB", "abc", "cab", "bb", "ca", "cc", "x", "я"]) for _ in range(rng.randint(0, 9)))
    rows = [(str(i), text()) for i in range(120)] + [("7", text()), ("7", None), (None, text()), (None, text()), ("no", None)]
    texts = spark.createDataFrame(rows, "post_id string, text string")
    dictionary = spark.createDataFrame(list(lemma_of.items()), "token string, lemma string")
    placed = {}
    for key, content in rows:
        placed.setdefault(key, []).extend((at, lemma_of.get(t, t)) for at, t in enumerate((content or "").lower().split()))
    want = sorted((key or "", " ".join(lemma for _, lemma in sorted(at))) for key, at in placed.items())
    for chunk_bytes in (16 << 20, 100):
        lemmas = lemmatize_texts(texts, dictionary, chunk_bytes=chunk_bytes)
        assert sorted((r.post_id or "", r.lemmas) for r in lemmas.collect()) == want
        assert "Generate" not in lemmas._jdf.queryExecution().executedPlan().toString()
    assert lemmatize_texts(texts.limit(0), dictionary).count() == 0


def test_lemma_filter_in_chunks(spark):
    """Posts carry no table of tokens that grows with the dictionary."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(4)) for _ in range(150)]
    lemma_of = {w: w[:2] for w in words if w.endswith(("a", "b"))}
    rows = [("", " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), keywords, exclusions)
            for _ in range(150) for keywords, exclusions in [([rng.choice(words), "c a"], [rng.choice(words)]), (["dd ", "cc a"], [])]]
    entries = spark.createDataFrame(list(lemma_of.items()), "token string, lemma string")
    posts = spark.createDataFrame([(str(i), *r) for i, r in enumerate([*rows, (None, "a", ["a"], []), ("a", "b", [None, "A"], None)])], SCHEMA)
    want = {i for i, r in enumerate(rows) if plain(*r, lemma_of)} | {len(rows) + 1}
    assert 0 < len(want) < len(rows)
    for chunk_bytes in (16 << 20, 300):
        marked = mark(posts, entries, chunk_bytes)
        assert marked.columns == [*posts.columns, "_pass"] and marked.count() == posts.count()
        assert {int(r.post_id) for r in marked.filter("_pass").collect()} == want
        assert "map<" not in marked._jdf.queryExecution().executedPlan().toString()
    assert [table.columns for table in keyword_lists(posts, entries)] == [["keywords", "patterns"], ["keyword", "token", "lemma"]]
