"""Text queries over `documents`, `pages`, `benchmark` and `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import text as T
from factloom.operators import chunking, events
from factloom.plans.registry import query
from factloom.session import table
from factloom.sources import feeds


@query("select doc_id, lang from documents where contains(lower(text), 'the and') order by doc_id desc limit 50")
def claim_search(spark: SparkSession, d: str) -> DataFrame:
    """Newest 50 whose text has the phrase in any case."""
    return table(spark, d, "documents").where(F.col("text").ilike("%the and%")).orderBy(F.desc("doc_id")).limit(50).select("doc_id", "lang")


@query("select doc_id from documents where contains(lower(source), 'src1') or contains(lower(coalesce(lang, '')), 'fr')")
def contains_any(spark: SparkSession, d: str) -> DataFrame:
    hit = F.contains(F.lower("source"), F.lit("src1")) | F.contains(F.lower(F.coalesce("lang", F.lit(""))), F.lit("fr"))
    return table(spark, d, "documents").where(hit).select("doc_id")


_WORDS = "len(list_filter(string_split_regex({}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))"


@query(f"select doc_id, nullif({_WORDS.format("regexp_replace(text, '<[^>]*>', ' ', 'g')")}, 0) as words, cast(ceil({_WORDS.format('text')} * 1.33) as bigint) as tokens from documents")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.estimated_tokens(F.col("text")).cast("long").alias("tokens"))


_NAMED = "replace(replace(replace(replace(replace({}, '&apos;', ''''), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
_TEXT = "trim(regexp_replace(" + _NAMED.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"


@query(f"select page_id, md5({_TEXT}) as digest, cast(length({_TEXT}) as bigint) as length, length({_TEXT}) >= 200 as ok from pages")
def clean_html(spark: SparkSession, d: str) -> DataFrame:
    p = feeds.pages_text(table(spark, d, "pages"))
    return p.select("page_id", F.md5(F.col("content").cast("binary")).alias("digest"), F.length("content").cast("long").alias("length"), "ok")


def _numeric(column: str, pattern: str, code: str) -> str:
    """SQL that decodes the numeric references of a column; code gives the number of the part p."""
    known = f"case when {code} between 1 and 55295 or {code} between 57344 and 1114111 then chr(({code})::int) else chr(65533) end"
    part = f"case when regexp_matches(p, '{pattern}') then {known} || regexp_replace(p, '{pattern}', '') else '&#' || p end"
    return f"list_reduce(list_prepend(string_split({column}, '&#')[1], list_transform(string_split({column}, '&#')[2:], lambda p: {part})), lambda a, x: a || x)"


_DECIMAL = _numeric("named", "^[0-9]{1,7};", "coalesce(try_cast(regexp_extract(p, '^([0-9]{1,7});', 1) as bigint), 0)")
_HEX = _numeric("decimal", "^[xX][0-9a-fA-F]{1,6};", "coalesce(try_cast('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]{1,6});', 1) as bigint), 0)")


@query(f"with n as (select page_id, {_NAMED.format('html')} as named from pages), d as (select page_id, {_DECIMAL} as decimal from n) select page_id, md5({_HEX}) as digest from d")
def decode_entities(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.md5(T.decode_entities(F.col("html")).cast("binary")).alias("digest"))


@query("select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(57344), 'g'), chr(57344)), lambda x: trim(x, ' ') <> ''))::int as sentences from documents")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query()
def chunk_segments(spark: SparkSession, d: str) -> DataFrame:
    return chunking.segments(table(spark, d, "documents"))


@query("""with s as (select item_id, item_id || ':0:' || substr(text, 1, 64) as s from benchmark), h as (select item_id, list_reduce(list_prepend(0::bigint, list_transform(string_split(s, ''), lambda c: unicode(c)::bigint)), lambda a, x: (a * 31 + x) % 4294967296) as h from s)
 select item_id, lpad(lower(printf('%x', abs(case when h >= 2147483648 then h - 4294967296 else h end))), 8, '0') as mark from h""")
def watermark_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.watermark_hash(F.col("item_id").cast("string"), F.lit(0), F.col("text")).alias("mark"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"
_IN = lambda names: "(" + " or ".join(f"host = '{n}' or ends_with(host, '.{n}')" for n in names) + ")"


@query(f"with h as (select page_id, {_HOST} as host from pages) select page_id, host, case when {_IN(K.OFFICIAL_DOMAINS)} then 'T1' when {_IN(K.WIRE_DOMAINS)} then 'T2' when {_IN(K.REFERENCE_DOMAINS)} then 'T3' when {_IN(K.MAINSTREAM_DOMAINS)} then 'T4' else 'T5' end as tier from h")
def host_and_tier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.domain(F.col("url")).alias("host"), T.evidence_tier(F.col("url"), F.lit(None).cast("string")).alias("tier"))


_ANY = lambda patterns: "(" + " or ".join("regexp_matches(text, '(?i)" + p.replace("'", "''") + "')" for p in patterns) + ")"


@query(f"select item_id, case when {_ANY(K.CRITICAL_RISK)} then 'CRITICAL' when {_ANY(K.HIGH_RISK)} then 'HIGH' when {_ANY(K.MEDIUM_RISK)} then 'MEDIUM' else 'LOW' end as risk from benchmark")
def claim_risk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.claim_risk(F.col("text")).alias("risk"))


@query(f"select conv_id, turn, {_ANY(K.ATTRIBUTION)} as attribution from conversations")
def attribution(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_attribution(F.col("text")).alias("attribution"))


_ENTITY = "trim(regexp_replace(regexp_replace(trim(lower(w)), '[.,;:!?\"''()\\[\\]{}]', '', 'g'), '\\s+', ' ', 'g'))"
_ALIAS = "case e " + " ".join(f"when '{a}' then '{b}'" for a, b in K.ENTITY_ALIASES.items()) + " else e end"


@query(f"""with w as (select conv_id, turn * 100000 + i as pos, w from (select conv_id, turn, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as w, generate_subscripts(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), 1) as i from conversations)),
 n as (select conv_id, pos, {_ALIAS} as entity from (select conv_id, pos, {_ENTITY} as e from w)), c as (select conv_id, entity, count(*) as n, min(pos) as pos from n where length(entity) >= 2 group by all),
 r as (select *, row_number() over (partition by conv_id order by n desc, pos, entity) as k from c) select conv_id, string_agg(entity, ',' order by entity) as entities from r where k <= 5 group by conv_id""")
def entity_topn(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), "turn", F.posexplode(T.words(F.col("text"))).alias("i", "name"))
    top = events.top_entities(words.select("document_id", "name", (F.col("turn") * 100000 + F.col("i")).alias("position")))
    return top.select(F.col("document_id").alias("conv_id"), F.array_join("entities", ",").alias("entities"))


@query("select conv_id, turn, replace(replace(replace(replace(replace(substr(text, 1, 160), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as summary from conversations")
def share_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.xml_escape(F.substring("text", 1, 160)).alias("summary"))


@query("select page_id, 'P & ' || page_id as title, nullif(trim(url, ' '), '') as link from pages where url is not null")
def rss_parse(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as one feed each and read back."""
    p = table(spark, d, "pages")
    xml = F.concat(F.lit("<rss><channel><item><title>"), F.format_string("P &amp; %d", "page_id"), F.lit("</title><link><![CDATA["), "url", F.lit("]]></link></item></channel></rss>"))
    return p.select("page_id", F.explode(feeds.rss_items(xml)).alias("i")).select("page_id", "i.title", "i.link")
