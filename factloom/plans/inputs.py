"""What comes in: feeds, readers, dates, places, texts made ready for segments and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import text as T
from factloom.operators import tables
from factloom.plans.registry import query
from factloom.session import table
from factloom.sources import feeds

#: White space in SQL patterns, and a text without it at both ends.
_WS = "[\\t-\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
_TRIM = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_NB = " "


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _pick(n: Column, values: list[str | None]) -> Column:
    """The value of a number's remainder."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (n % len(values) + 1).cast("int"))


def _picked(n: str, values: list[str | None]) -> str:
    shown = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{shown}])[{n} % {len(values)} + 1]"


@query("""select page_id, case when page_id % 2 = 0 then 'P & ' || page_id else 'T ' || page_id end as title, case when page_id % 2 = 0 then url else 'http://alt/' || page_id end as link,
 case when page_id % 2 = 0 then 'Mon, 01 Jan 2024 10:00:00 GMT' else '2024-01-01T00:00:00Z' end as published, case when page_id % 2 = 0 then 'a' || page_id % 7 else 'n' || page_id % 5 end as author, case when page_id % 2 = 0 then '<b>d</b> & e' else 'c' end as description
 from pages where url is not null""")
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as feeds over several lines, RSS and Atom by turns, and read back; an item without a link has no row."""
    p, i = table(spark, d, "pages").where("url is not null"), F.col("page_id")
    rss = _text("<rss>\n<channel><title>all</title>\n<item>\n <title>" + _NB + "P &amp;#38; ", i, "\n</title>\n <link>\n ", F.col("url"), _NB + "\n</link><dc:creator>\n</dc:creator><author> a", i % 7, "</author>",
                "<pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description> <![CDATA[<b>d</b> & e]]>\n</description></item><item><title>none</title><link>\n" + _NB + "</link></item></channel></rss>")
    atom = _text("<feed><link rel='self' href='http://feed'/>\n<entry><title type=\"text\">T ", i, "</title><link rel=\"self\" href=\"http://self\"/>\n<link href='http://alt/", i, "' rel=\"alternate\" />",
                 "<author>\n<name> n", i % 5, "\n</name></author><updated>2024-01-01T00:00:00Z</updated><summary>\n</summary><content>c</content></entry></feed>")
    xml = F.when(i % 2 == 0, rss).otherwise(atom)
    return p.select("page_id", F.explode(feeds.rss_items(xml)).alias("i")).select("page_id", "i.*")


@query("""select page_id, case page_id % 6 when 0 then '<?xml version="1.0" encoding="ISO-8859-1"?>é ' when 1 then '<?xml version="1.0" ENCODING=''utf-8''?>é ' when 2 then '<item encoding="ISO-8859-1">é ' when 3 then '“é” ' when 4 then '日本 ' else '� ' end || page_id as text from pages""")
def feed_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Charset by content type, then prolog, then UTF-8; an encoding elsewhere does not count, bad bytes are replaced."""
    i = F.col("page_id") % 6
    latin, utf = (lambda s, c=c: F.encode(F.lit(s), c) for c in ("ISO-8859-1", "UTF-8"))
    body = (
        F.when(i == 0, latin('<?xml version="1.0" encoding="ISO-8859-1"?>é ')).when(i == 1, utf("<?xml version=\"1.0\" ENCODING='utf-8'?>é ")).when(i == 2, utf('<item encoding="ISO-8859-1">é '))
        .when(i == 3, F.concat(F.unhex(F.lit("93")), latin("é"), F.unhex(F.lit("9420")))).when(i == 4, F.unhex(F.lit("93FA967B20"))).otherwise(F.unhex(F.lit("FF20")))
    )
    kind = F.when(i == 3, "text/xml; charset=windows-1252").when(i == 4, "text/xml;charset=Shift_JIS")
    content = F.concat(body, F.encode(F.col("page_id").cast("string"), "UTF-8"))
    return table(spark, d, "pages").select("page_id", feeds.decoded(content, kind).alias("text"))


_NOW = "2024-01-30 12:00:00"


@query(f"""with f as (select user_id as id, user_id % 7 <> 0 as is_active, case when user_id % 5 <> 0 then max(ts) filter (ts < timestamp '{_NOW}') end as last, user_id * 37 % 2000 as minutes from events group by user_id)
 select id, strftime(last, '%Y-%m-%d %H:%M:%S') as last from f where is_active and (last is null or epoch(timestamp '{_NOW}') - floor(epoch(last)) >= 60 * coalesce(nullif(minutes, 0), 15)) order by f.last nulls first, id limit 10""")
def due_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Users as feeds, last polled when they were last seen."""
    u = F.col("user_id")
    seen = F.max(F.when(F.col("ts") < F.lit(_NOW).cast("timestamp"), F.col("ts").cast("timestamp")))
    f = table(spark, d, "events").groupBy("user_id").agg(seen.alias("seen")).select(u.alias("id"), (u % 7 != 0).alias("is_active"), F.when(u % 5 != 0, F.col("seen")).alias("last_polled_at"), (u * 37 % 2000).alias("polling_interval_minutes"))
    return feeds.due(f, F.lit(_NOW).cast("timestamp")).select("id", F.date_format("last_polled_at", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("select user_id as feed_id, event_id::varchar as link from (select *, row_number() over (partition by user_id order by ts desc, event_id::varchar) as n from events) where n <= 10")
def newest_items(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("feed_id"), F.col("event_id").cast("string").alias("link"), F.col("ts").alias("published"))
    return feeds.newest_of_each(e).select("feed_id", "link")


@query("""select page_id % 7 as feed_id, case when page_id % 5 = 0 then 'Untitled' else 'T & ' || page_id end as title, url, nullif(page_id, 0) * 60 as published from pages
 where page_id % 7 < 5 and page_id % 9 <> 0 and url <> '' and not starts_with(url, 'https://m.')""")
def reader_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a reader's JSON; of unknown feeds, without an address, or collected already: no row."""
    p, i = table(spark, d, "pages"), F.col("page_id")
    href = F.array(F.struct(F.col("url").alias("href")))
    item = F.struct(
        F.when(i % 5 != 0, _text("T &amp; ", i)).alias("title"), (i * 60).alias("published"), F.when((i % 4 != 0) & (i % 9 != 0), href).alias("canonical"), F.when((i % 4 == 0) & (i % 9 != 0), href).alias("alternate"),
        F.struct(_text("feed/https://f/", i % 7, ".xml").alias("streamId")).alias("origin"),
    )
    known = spark.range(5).select("id", _text("https://f/", F.col("id"), ".xml").alias("url"))
    got = feeds.reader_items(p.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("json")), known)
    collected = p.where("startswith(url, 'https://m.')").select("url")
    return got.join(collected, "url", "left_anti").select("feed_id", "title", "url", F.unix_timestamp("published_at").alias("published"))


@query("select page_id, 'http://f?a&b=' || page_id as url, 'T \"' || page_id || '\"' as title from pages union all select page_id, 'http://g' as url, 'second' as title from pages")
def opml_feeds(spark: SparkSession, d: str) -> DataFrame:
    xml = _text('<opml><body>\n<outline text="folder">\n<outline title="T &quot;', F.col("page_id"), '&quot;" type="rss" xmlUrl="http://f?a&amp;b=', F.col("page_id"), '"/>\n<outline text="second" xmlUrl="http://g"/></outline></body></opml>')
    return table(spark, d, "pages").select("page_id", F.explode(feeds.opml(xml)).alias("o")).select("page_id", "o.*")


@query("select o_orderkey, case when o_orderkey % 4 < 3 then strftime(o_orderdate + to_seconds(o_orderkey % 86400 - case when o_orderkey % 4 = 2 then 7200 else 0 end), '%Y-%m-%d %H:%M:%S') end as at from orders")
def feed_dates(spark: SparkSession, d: str) -> DataFrame:
    """RFC 822 and ISO dates; what is neither is null."""
    n, at = F.col("o_orderkey") % 4, F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400)
    text = F.when(n == 0, _text(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), " GMT")).when(n == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 2, _text(F.date_format(at, "dd MMM yyyy HH:mm:ss"), " +0200")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(feeds.published_at(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"""select doc_id, md5({_TRIM("regexp_replace(regexp_replace('" + _NB + "<IMG src=x>' || text || ' (image CREDIT: me) <img>' || chr(10), '(?i)<img[^>]*>', '', 'g'), '(?i)[(]image credit:[^)]*[)]', '', 'g')")}) as digest from documents""")
def rss_cleaning(spark: SparkSession, d: str) -> DataFrame:
    dirty = _text(_NB + "<IMG src=x>", F.col("text"), " (image CREDIT: me) <img>\n")
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_rss(dirty).cast("binary")).alias("digest"))


@query(f"""with x as (select doc_id, text, text || repeat(chr(10), 4) || '<!--' || chr(10) || ' corpus-watermark:a' || doc_id || '-->' || chr(10) || 'end{_NB}' as dirty from documents)
 select doc_id, md5({_TRIM(f"regexp_replace(regexp_replace(dirty, '<!--{_WS}*corpus-watermark:[^>]*-->', '', 'g'), chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")}) as digest, md5(text) as bare,
 len(list_filter(regexp_split_to_array(dirty, '{_WS}+'), lambda w: w <> '')) as words from x""")
def corpus_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Watermarks with any white space before their name, runs of empty lines, no-break spaces at the end."""
    dirty = _text(F.col("text"), "\n\n\n\n<!--\n corpus-watermark:a", F.col("doc_id"), "-->\nend" + _NB)
    marked = _text(F.col("text"), "\n\n<!-- corpus-watermark:0f-->")
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_content(dirty).cast("binary")).alias("digest"), F.md5(T.strip_watermark(marked).cast("binary")).alias("bare"), F.size(T.words(dirty)).cast("long").alias("words"))


_CATEGORIES = ["mainstream", "partisan", "fringe", "reference", "wire", "other"]
_TIERS = ["tier_4", "tier_4", "tier_5", "tier_3", "tier_2", "tier_5"]


@query(f"""select doc_id, md5(concat_ws(' | ', '[publisher: ' || source, 'category: ' || {_picked("doc_id", _CATEGORIES)}, 'tier: ' || {_picked("doc_id", _TIERS)}, case when doc_id % 3 > 0 then 'date: 2024-01-0' || doc_id % 3 end, 'corpus: ' || doc_id || ']') || chr(10) || text) as digest from documents""")
def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    i, category = F.col("doc_id"), _pick(F.col("doc_id"), _CATEGORIES)
    date = F.when(i % 3 > 0, _text("2024-01-0", i % 3))
    made = T.embedding_input(F.col("source"), category, T.corpus_tier(category), date, i.cast("string"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(made.cast("binary")).alias("digest"))


_ABC, _CAPS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_EVEN = lambda c: _TRIM(f"regexp_replace(lower({c}), '{_WS}+', ' ', 'g')")


@query(f"""with w as (select conv_id, turn, text, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') as w from conversations),
 q as (select conv_id, turn, text, case turn % 4 when 0 then substr(text, 5, 30) when 1 then translate(array_to_string(w[2:5], '  '), '{_ABC}', '{_CAPS}') when 2 then array_to_string([w[1], w[3], w[4], w[6], w[8]], ' ') else array_to_string(list_concat(w[1:3], ['zzz', 'yyy']), ' ') end as quote from w),
 n as (select *, {_EVEN("text")} as s, {_EVEN("quote")} as low from q), p as (select *, string_split(s, ' ') as seg, list_filter(string_split(low, ' '), lambda x: x <> '') as sought from n),
 f as (select *, list_reduce(list_prepend(struct_pack(i := 0::bigint, n := 0::bigint, w := ''), list_transform(sought, lambda x: struct_pack(i := 0::bigint, n := 0::bigint, w := x))),
  lambda a, x: struct_pack(i := case when list_position(seg[a.i + 1:], x.w) > 0 then a.i + list_position(seg[a.i + 1:], x.w) else len(seg) end::bigint, n := (a.n + case when list_position(seg[a.i + 1:], x.w) > 0 then 1 else 0 end)::bigint, w := '')) as r from p)
 select conv_id, turn, contains(text, quote) or contains(s, low) or (len(sought) >= 3 and r.n >= 0.8 * len(sought)) as found from f""")
def quote_matches(spark: SparkSession, d: str) -> DataFrame:
    """Quotes cut from each turn: as it stands, in other case and spacing, with words left out, with words that aren't there."""
    w, n = T.words(F.col("text")), F.col("turn") % 4
    some = F.array(*(F.get(w, F.lit(k)) for k in (0, 2, 3, 5, 7)))
    quote = (
        F.when(n == 0, F.substring("text", 5, 30)).when(n == 1, F.translate(F.array_join(F.slice(w, 2, 4), "  "), _ABC, _CAPS)).when(n == 2, F.array_join(some, " "))
        .otherwise(F.array_join(F.concat(F.slice(w, 1, 3), F.array(F.lit("zzz"), F.lit("yyy"))), " "))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", T.quote_matches(F.col("text"), quote).alias("found"))


_NAMED = ["Immigration law", "TAX and budget", "regulatory", "Abortion debate", "Police and crime", "MILITARY aid", "union worker", "Climate", "Executive order", "antitrust", "sports", None]
_POLICY = "case " + " ".join(f"when regexp_matches(lower(c), '{'|'.join(parts)}') then '{name}'" for name, parts in K.POLICY_WORDS) + " end"
_DIMENSION = "coalesce(case p " + " ".join(f"when '{k}' then '{v}'" for k, v in K.DIMENSIONS.items()) + " end, 'general')"


@query(f"""with c as (select item_id, text, {_picked("item_id", _NAMED)} as c from benchmark), p as (select *, {_POLICY} as p from c)
 select item_id, p as domain, {_DIMENSION} as dimension, list_has_any(['that', 'zz', 'thenyy'], regexp_split_to_array(lower(text), '[^0-9A-Za-z_]+')) as hit from p""")
def policy_maps(spark: SparkSession, d: str) -> DataFrame:
    domain = T.policy_domain(_pick(F.col("item_id"), _NAMED))
    hit = T.keyword_overlap(F.array(F.lit("That zz"), F.lit("thenyy")), F.col("text"))
    return table(spark, d, "benchmark").select("item_id", domain.alias("domain"), T.dimension(domain).alias("dimension"), hit.alias("hit"))


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(f"""with x as (select doc_id, {_TRIM("regexp_replace('<!-- a' || chr(10) || 'b --> ' || text, '(?s)<!--.*?-->', '', 'g')")} as bare, text from documents)
 select doc_id, md5(substr(bare, 1, 180)) as excerpt, '<meta property="og:title" content="&lt;' || doc_id || '&gt;"/><meta property="og:description" content="' || {_ESCAPED.format("substr(text, 1, 160)")} || '"/><meta property="og:url" content="https://site.test/d/' || doc_id || '"/>' as card from x""")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts, and the cards that sharing shows."""
    i, text = F.col("doc_id"), F.col("text")
    card = T.share_card(_text("<", i, ">"), text, _text("https://site.test/d/", i))
    return table(spark, d, "documents").select("doc_id", F.md5(T.excerpt(_text("<!-- a\nb --> ", text)).cast("binary")).alias("excerpt"), card.alias("card"))


_PLACES = ["London!", "[Paris]", "Kyiv;", "Washington, D.C.", "Atlantis / Tokyo", " New  York ", "", "Nowhere (North)", "U.S.", None, "berlin & rome", "gaza:", " Iran ", "uk/france"]
_GEO = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in K.GEO_CODES.items()) + "}"


@query(f"""with p as (select page_id, {_picked("page_id", _PLACES)} as p from pages), c as (select page_id, regexp_replace(regexp_replace({_TRIM("lower(p)")}, '[.,;:!?"''()\\[\\]{{}}]', '', 'g'), '{_WS}+', ' ', 'g') as c from p)
 select page_id, coalesce(map_extract({_GEO}, c)[1], list_filter(list_transform(regexp_split_to_array(c, '[,/&]+'), lambda x: map_extract({_GEO}, trim(x, ' '))[1]), lambda x: x is not null)[1], nullif(c, ''), 'unknown') as code from c""")
def geo_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.geo(_pick(F.col("page_id"), _PLACES)).alias("code"))


@query("""select 'from 1996' as asked, count(*) as n from orders where o_orderdate >= timestamp '1996-01-01' union all select 'from 1996, F', count(*) from orders where o_orderdate >= timestamp '1996-01-01' and o_orderstatus = 'F'
 union all select 'all', count(*) from orders""")
def optional_filter(spark: SparkSession, d: str) -> DataFrame:
    """The same question with and without its parameters."""
    o = table(spark, d, "orders")
    asked = {"from 1996": ("1996-01-01", None), "from 1996, F": ("1996-01-01", "F"), "all": (None, None)}
    parts = [tables.where_given(o, ("o_orderdate", ">=", since), ("o_orderstatus", "=", status)).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n") for name, (since, status) in asked.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
