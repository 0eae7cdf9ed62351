"""Text functions, feeds, providers, streams."""

import random
import re

from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import text as T
from factloom.sources import feeds, providers
from factloom.streaming import status


def value(spark, f, *args):
    return spark.range(1).select(f(*(F.lit(a) for a in args)).alias("x")).first().x


def test_text(spark):
    v = lambda f, *a: value(spark, f, *a)
    assert v(T.decode_entities, "a &amp;lt; &#233;&#x1F600; &#bad &quot;") == 'a < é😀 &#bad "'
    assert v(T.decode_entities, "&#0;&#xD800;&#9999999;&#xFFFFFF;&#65;") == "\ufffd" * 4 + "A"
    assert v(T.clean_rss, "x <IMG src=1> (Image credit: me) ") == "x"
    assert v(T.word_count, "<b>one</b> two") == 2 and v(T.word_count, " ") is None
    assert v(T.sentences, "A b. C? D") == ["A b.", "C?", "D"]
    assert v(T.clean_content, "a\n\n\n\nb <!-- corpus-watermark:1 -->") == "a\n\nb"
    assert v(T.normalised, "Héllo,  World!") == "hllo world"
    assert v(T.word_jaccard, "a b", "b c") == 1 / 3 and v(T.word_jaccard, "", "a") == 0
    assert v(T.scope_tokens, "The cat, and the hat of it") == ["cat", "hat"]
    assert v(T.domain, "https://WWW.Example.COM/x") == "example.com" and v(T.domain, "no url") is None
    assert v(lambda u: T.evidence_tier(u, F.lit(None).cast("string")), "https://a.b.bbc.co.uk/1") == "T4" and v(T.web_tier, "https://notreuters.com") == "T4" and v(T.web_tier, "https://uk.reuters.com/") == "T2"
    assert [v(T.claim_risk, x) for x in ("The king is dead", "a mass shooting", "it is illegal", "nice day")] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    assert v(T.is_attribution, "He SAID so") and not v(T.is_attribution, "saidx")
    assert v(T.is_event, "missile hits Kyiv") and not v(T.is_event, "missile hits kyiv")
    assert v(T.entity, " U.S. ") == "united states" and v(T.entity, "People's Republic of China") == "china"
    assert v(T.geo, "Atlantis / Paris") == "FR-PAR" and v(T.geo, "Nowhere") == "nowhere" and spark.range(1).select(T.geo(F.lit(None).cast("string")).alias("x")).first().x == "unknown"
    assert v(T.policy_domain, "Tax and labor") == "fiscal_policy" and v(T.policy_domain, "OTHER") is None
    assert v(T.canonical_key, "", "A  b!") == "no-url::a b" and v(T.clean_json, '```json\n{"a":1}\n```') == '{"a":1}'
    assert v(T.html_text, "<script>x</script><p>a&amp;b</p> c") == "a&b c" and v(T.xml_escape, "<'&>") == "&lt;&apos;&amp;&gt;"
    assert v(T.quote_matches, "The big red fox ran", "big Red  fox") and v(T.quote_matches, "a b c d e", "a c d e") and not v(T.quote_matches, "a b c", "c b a z")


def test_watermark_is_the_string_hash(spark):
    def plain(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return format(abs(h - (1 << 32) if h >= 1 << 31 else h), "08x")

    for text in ("hello", "é" * 100, ""):
        assert spark.range(1).select(T.watermark_hash(F.lit("c"), F.lit(3), F.lit(text)).alias("x")).first().x == plain(f"c:3:{text[:64]}")


def test_embedding_input(spark):
    r = spark.range(1).select(T.embedding_input(F.lit("p"), F.lit("mainstream"), T.corpus_tier(F.lit("mainstream")), F.lit(None).cast("string"), F.lit("c1"), F.lit("t")).alias("x")).first()
    assert r.x == "[publisher: p | category: mainstream | tier: tier_4 | corpus: c1]\nt"


RSS = """<rss><item><title><![CDATA[A &amp; B]]></title><guid>g1</guid><dc:creator>me</dc:creator><description>d</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>none</title></item></rss>"""
ATOM = """<feed><entry><title>t</title><link rel="self" href="http://s"/><link rel="alternate" href="http://a"/><author><name>n</name></author><updated>2024-01-01T00:00:00Z</updated><content>c</content></entry></feed>"""


def test_feeds(spark, tmp_path):
    item = value(spark, feeds.rss_items, RSS)
    assert [(i.title, i.link, i.author, i.description) for i in item] == [("A & B", "g1", "me", "d")]
    assert [(i.title, i.link, i.author, i.published) for i in value(spark, feeds.rss_items, ATOM)] == [("t", "http://a", "n", "2024-01-01T00:00:00Z")]
    assert value(spark, feeds.published_at, item[0].published).hour == 10 and value(spark, feeds.published_at, "soon") is None
    (tmp_path / "f.xml").write_bytes('<?xml version="1.0" encoding="ISO-8859-1"?><rss><item><title>é</title><link>l</link></item></rss>'.encode("latin-1"))
    assert feeds.read_feeds(spark, str(tmp_path)).first().title == "é"
    f = spark.createDataFrame([(1, True, None, 15), (2, True, "2024-01-01 00:00:00", 15), (3, True, "2024-01-01 00:59:00", None), (4, False, None, 1)], "id int, is_active boolean, last_polled_at string, polling_interval_minutes int").withColumn("last_polled_at", F.to_timestamp("last_polled_at"))
    assert [r.id for r in feeds.due(f, F.lit("2024-01-01 01:00:00").cast("timestamp")).collect()] == [1, 2]
    assert [(o.url, o.title) for o in value(spark, feeds.opml, '<outline title="T" xmlUrl="http://f?a&amp;b"/>')] == [("http://f?a&b", "T")]
    js = spark.createDataFrame([('{"items":[{"title":"t","published":0,"canonical":[{"href":"u"}],"origin":{"streamId":"feed/x"}},{"origin":{"streamId":"feed/z"}}]}',)], "json string")
    assert [(r.url, r.feed_id) for r in feeds.reader_items(js, spark.createDataFrame([(5, "x")], "id int, url string")).collect()] == [("u", 5)]


def test_providers(spark):
    assert value(spark, providers.valid_class, '```json\n{"classification":"context","sarcasm":true}```') == "OPINION_ANALYSIS" and value(spark, providers.valid_class, "rubbish") == "OTHER"
    assert tuple(value(spark, providers.valid_nli, '{"label":"maybe","confidence":7}')) == ("NEUTRAL", 1.0) and value(spark, providers.valid_nli, '{"label":"entailment","confidence":0}').confidence == 0.5
    assert [c.claim_text for c in value(spark, providers.valid_claims, '[{"claim_text":"short"},{"claim_text":"long enough claim"}]')] == ["long enough claim"]
    web = value(spark, providers.web_sources, '[{"url":"https://apnews.com/1","stance":"supports"},{"url":"https://apnews.com/1","stance":"contradicts"},{"url":""}]')
    assert [(w.url, w.nli_label, w.tier) for w in web] == [("https://apnews.com/1", "ENTAILMENT", "T2")]
    v = providers.hashed_vector("a few words here")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and providers.hashed_vector("") is None
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert sorted(r.u for r in providers.with_model(df, lambda xs: [x.upper() + "!" for x in xs], "t", "u").collect()) == ["!", "A!"]
    assert providers.prompt(["a {{X}}", "", "{{Y}}"], {"X": "1"}) == "a 1\n\n{{Y}}"


CHANGES = [(1, "pending", 1), (1, "pending", 2), (1, "verifying", 3), (1, "pending", 4), (2, "aggregated", 1), (2, "odd", 2), (2, "aggregated", 5)]


def test_status_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(CHANGES, "doc_id long, status string, seq long")
    want = sorted(map(tuple, status.status_jobs(df).collect()))
    assert ("VERACITY" in {w[1] for w in want}) and len(want) == 2 + 2 + 5 * 2
    df.write.parquet(str(tmp_path / "in"))
    stream = status.status_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_status_stream_is_exactly_once(spark, tmp_path):
    """Rows that come again, in the same batch or a later one, start nothing."""
    df = spark.createDataFrame(CHANGES, "doc_id long, status string, seq long")
    df.unionAll(df).coalesce(1).write.parquet(str(tmp_path / "in"))
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = status.status_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, status.status_jobs(df.dropDuplicates()).collect()))


def test_breaker_over_ranges_equals_a_plain_count(spark):
    """A stage with most rows spreads over ranges; streaks go on from one to the next."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "z", None]), i, rng.random() < 0.9) for i in range(3000)]
    want, streak = {}, {}
    for stage, seq, failed in rows:
        streak[stage] = streak.get(stage, 0) + 1 if failed else 0
        want[seq] = (streak[stage], failed and streak[stage] >= 5)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = {r.seq: (r.streak, r.pauses) for r in status.breaker(spark.createDataFrame(rows, "stage string, seq long, failed boolean").repartition(7)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == want


def test_charsets_as_the_web_reads_them():
    for text, name, codec in (("é“x”€", "ISO-8859-1", "cp1252"), ("é“x”", "Windows-1252", "cp1252"), ("日本語", "Shift_JIS", "shift_jis"), ("Привет", "koi8-r", "koi8-r"), ("aé", "no-such-charset", "cp1252"), ("日本", "utf-16", "utf-16-le")):
        assert feeds.as_text(text.encode(codec), name) == text
    assert feeds.as_text(b"\xef\xbb\xbfa\xff", "utf-8") == "a\ufffd"


def test_feeds_in_the_wild():
    wild = '<rss xmlns:x="u"><channel><title>all</title><item rdf:about="1"><title>A &nbsp; <b>b</b><br></title><link/><guid isPermaLink="true">\n http://g </guid><description>open <p> end</description></item><!-- <item><link>no</link></item> --><item><link>http://2</link>'
    assert [(i["link"], i["title"], i["description"]) for i in feeds.items(wild)] == [("http://g", "A &nbsp; <b>b</b><br>", "open <p> end")]
    assert feeds.items("no feed at all") == [] and feeds.items("") == []


def test_runner_breaker_and_reaper(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    rows = [("EXTRACT", False, "a", "a", False, 3), ("EXTRACT", False, "a", "a", False, 2), ("X", False, "a", "b", False, 0), ("X", True, "a", "a", True, 0), ("X", False, "a", "a", True, 0)]
    jobs = spark.createDataFrame(rows, "stage string, paused boolean, expected_status string, document_status string, ok boolean, attempt int").withColumn("paused_until", F.lit(None).cast("timestamp"))
    assert [(r.metric, r.action) for r in status.next_state(jobs, now).collect()] == [("failed", "dead_letter"), ("failed", "retry"), ("skipped", "done"), ("deferred", "requeue"), ("ok", "done")]
    m = spark.createDataFrame([("s", i, i != 3) for i in range(10)], "stage string, seq int, failed boolean")
    assert [(r.seq, r.streak) for r in status.breaker(m).where("pauses").orderBy("seq").collect()] == [(8, 5), (9, 6)]
    dead, left = status.poisoned(spark.createDataFrame([(1, 10), (2, 3)], "id int, attempts int"))
    assert [r.id for r in dead.collect()] == [1] and [r.id for r in left.collect()] == [2]


def test_addresses_of_an_answer_are_listed_once(spark):
    """Before, the list was made anew for each source of an answer: nested in the filter's condition."""
    from pyspark.sql import functions as F

    from factloom.sources import providers

    df = spark.createDataFrame([("[]",)], "a string")
    plan = df.select(providers.web_sources(F.col("a")).alias("x"))._jdf.queryExecution().analyzed().toString()
    condition = plan.split("filter(", 1)[1]
    assert "transform(" not in condition.split("lambdafunction", 2)[1]
    assert [x.url for x in df.select(providers.web_sources(F.lit('[{"url":"u"},{"url":"v"},{"url":"u"},{}]')).alias("x")).first().x] == ["u", "v"]


def test_patterns_of_risk_equal_plain_ones(spark):
    """Whatever the case, on texts made of the patterns' own words; a pattern is tried only on texts with a word it needs (before, on all)."""
    rng = random.Random(11)
    words = sorted({w for p in K.NEEDED_WORDS for w in re.findall(r"[a-z]{2,}", p)} | {"a", "coup d'état", "$5", "$1,500", "investigation", "warden", "said."})
    texts = [" ".join(rng.sample(words, rng.randint(1, 6))) for _ in range(1500)]
    texts += [t + " " + rng.choice(words) for t in (
        "died a king", "the pope is dead", "nuclear strike", "declaration of war", "war declared", "coup d'état", "government overthrown", "martial law declared", "state of emergency",
        "terror attack", "mass casualties", "ethnic cleansing", "war crime", "invaded a country", "embargo announced", "arrested ceo", "senator indicted", "bank failure", "pandemic declared",
        "unlawful", "legally required", "law requires", "under investigation", "being investigated", "probe", "millions of dollars", "an $5 billion", "x$1,500 million", "told", "according to",
        "in a press conference", "in a tweet", "quoted as saying",
    ) for _ in range(3)]
    texts = ["".join(rng.choice((c.upper(), c)) if c.isascii() else c for c in t) for t in texts]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(T.any_of(F.col("t"), (p,)).alias(f"p{i}") for i, p in enumerate(K.NEEDED_WORDS))).collect()
    for i, p in enumerate(K.NEEDED_WORDS):
        want = [bool(re.search(p, r.t, re.I | re.A)) for r in got]
        assert [r[f"p{i}"] for r in got] == want and any(want), p
    assert "contains" in str(T.any_of(F.col("t"), K.ATTRIBUTION)).lower()


def test_vectors_of_a_batch_equal_those_one_by_one(spark):
    texts = ["one two two", "", None, "  ", "Three ONE été", "", "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r.i: r.embedding for r in providers.with_embedding(rows, "t").collect()}
    assert got == {i: providers.hashed_vector(t or "") for i, t in enumerate(texts)} and got[1] is None and len(got[6]) == 64
