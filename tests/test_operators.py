"""Edge cases of the post-analytics operators on small tables."""

from pyspark.sql import functions as F

from feedweave.functions import scores as S
from feedweave.functions import text as T
from feedweave.operators import enrich, export, history, review
from feedweave.sources import ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_labels(spark):
    for text, want in (("Sponsored", True), ("Sponsored · x", True), ("Sponsoredness", False), ("Ad ·", True), ("Ad", True), ("Adage", False), ("贊助商提供", False), ("贊助 · 🌐", True), ("Sponsored\n", False)):
        assert one(spark, text, T.is_short_label) is want, text
    assert one(spark, "School · 贊助 · 🌐", T.has_delimited_label) is True
    assert one(spark, "我們的贊助商", T.has_delimited_label) is False
    assert one(spark, "x S s o p r n e o t d g y", T.is_spaced_ad) is True


def test_text(spark):
    assert one(spark, " a　 b\n", T.squeeze) == "a b"
    assert one(spark, "a😀b", T.emoji_density) == 1 / 3
    assert one(spark, "", T.emoji_density) == 0
    assert one(spark, "abc", T.djb2) == 193485963
    assert one(spark, "http://x.org/?utm_source=a&b=1#t", T.without_tracking) == "http://x.org/?b=1"
    assert one(spark, None, T.squeeze) is None


def test_scores(spark):
    assert one(spark, float("nan"), S.clamp, "double") is None
    assert one(spark, float("inf"), S.clamp, "double") == 1
    assert one(spark, "12345", lambda c: S.digit(c, 1, 4)) is None
    assert one(spark, " 1234 ", lambda c: S.digit(c, 4, 4)) == 0.4
    assert one(spark, 'x {"c":1}', lambda c: S.number(S.variant(c), "c")) is None
    assert one(spark, '{"c":true}', lambda c: S.number(S.variant(c), "c")) == 1


def test_nearest_ties_and_missing(spark):
    rows = [(1, "marker", 10, "m"), (1, "message", 8, "a"), (1, "message", 12, "b"), (2, "marker", 5, "m"), (3, "message", 1, "z")]
    found = enrich.nearest(spark.createDataFrame(rows, "doc_id long, kind string, pos long, value string"), "message").collect()
    assert sorted((r["doc_id"], r["message"]) for r in found) == [(1, "a"), (2, None)]


def test_prefix_lookup_with_many_copies(spark):
    rows = [(i, "same text", f"s{i}") for i in range(50)] + [(99, "other", "x")]
    found = dict(enrich.other_with_prefix(spark.createDataFrame(rows, "id long, text string, author string"), "id", "text", "author").collect())
    assert found[0] == "s1" and all(found[i] == "s0" for i in range(1, 50)) and 99 not in found


def test_containing(spark):
    texts = spark.createDataFrame([(1, "abcdefghijkl"), (2, "short"), (3, "xxabcdefghijyy"), (4, None)], "text_id long, t string")
    seeds = spark.createDataFrame([(7, "abcdefghij"), (8, "tiny"), (9, "abcdefghijkl")], "seed_id long, s string")
    assert sorted(map(tuple, enrich.containing(texts, seeds).collect())) == [(1, 7), (1, 9), (3, 7)]


def test_progressive_equals_fold(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.randrange(5), i, rng.choice(["", "a", "b", None]), rng.choice([None, "x", "y"]), rng.choice(list(history.RANK)), rng.random() < 0.2) for i in range(200)]
    df = spark.createDataFrame(rows, "post_id long, seq long, text string, author_name string, completeness string, is_sponsored boolean")
    want = {}
    for k, _, text, author, c, s in rows:
        t, a, r, sp, n = want.get(k, (None, None, 0, False, 0))
        want[k] = (text or t, author or a, max(r, history.RANK[c]), sp or s, n + 1)
    assert {r[0]: tuple(r[1:]) for r in history.progressive(df, "post_id", "seq").collect()} == want


def test_redaction_and_terms(spark):
    m = {"openApiKey": "s", "api_key": "", "apiKeyring": "k", "token": None}
    assert one(spark, m, export.redacted, "map<string,string>") == {"openApiKey": "[redacted]", "api_key": "", "apiKeyring": "k", "token": None}
    assert one(spark, "視頻和信息", review.replaced) == "影片和資訊"


def test_json_walk_bounds():
    deep = {"message": {"text": "long enough"}, "actors": [{"name": "n"}], "id": 1}
    for _ in range(29):
        deep = {"x": deep}
    assert len(ingest.posts_in(deep)) == 1
    assert ingest.posts_in({"x": {"x": deep}}) == []
    assert ingest.visible_text("<p>a</p><script>b</script><nav>c</nav><div aria-hidden=true>d</div>e") == "a\ne"


def test_ndjson_drops_bad_lines(spark):
    df = spark.createDataFrame([(1, '{"a":1}\n\nbroken\n{"a":2}'), (2, None), (3, "")], "id long, body string")
    assert sorted((r["id"], r["line"]) for r in ingest.ndjson(df).select("id", "line").collect()) == [(1, 0), (1, 3)]
