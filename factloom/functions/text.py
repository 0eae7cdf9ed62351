"""Text functions, Column to Column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import constants as C

WATERMARK = r"\n\n<!-- corpus-watermark:[^>]+-->"
#: White space as feeds and pages have it: Unicode's, no-break spaces and byte order marks included. Written so that letters are
#: told apart by two comparisons.
SPACES = r"\t-\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
#: The same characters one by one.
_SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def replaced(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def clean_rss(c: Column) -> Column:
    """Drop images and image credits."""
    return trimmed(replaced(replaced(c, r"(?i)<img[^>]*>"), r"(?i)\(Image credit:[^)]*\)"))


def _references(c: Column, pattern: str, base: int) -> Column:
    parts = F.split(c, "&#")

    def decoded(p: Column) -> Column:
        digits = F.ltrim(F.regexp_extract(p, pattern, 1), F.lit("0"))
        code = F.when(F.length(digits) < 8, F.conv(digits, base, 10).cast("long"))
        known = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), code).otherwise(F.lit(0xFFFD))  # no character has another
        char = F.decode(F.unhex(F.lpad(F.hex(known), 8, "0")), "UTF-32")
        return F.when(p.rlike(pattern), F.concat(char, replaced(p, pattern))).otherwise(F.concat(F.lit("&#"), p))

    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), decoded), ""))


def decode_named_entities(c: Column) -> Column:
    """In this order, so that a twice escaped < comes out whole."""
    for name, char in (("&apos;", "'"), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def decode_entities(c: Column) -> Column:
    """Named, then decimal, then hexadecimal references of any length; those of no character become U+FFFD."""
    return _references(_references(decode_named_entities(c), r"^([0-9]+);", 10), r"^[xX]([0-9a-fA-F]+);", 16)


def strip_tags(c: Column) -> Column:
    return replaced(c, r"<[^>]*>", " ")


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"[{SPACES}]+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """Words outside tags; null for none."""
    return F.nullif(F.size(words(strip_tags(c))).cast("long"), F.lit(0).cast("long"))


def clean_content(c: Column) -> Column:
    return trimmed(replaced(replaced(c, rf"<!--[{SPACES}]*corpus-watermark:[^>]*-->"), r"\n{3,}", "\n\n"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, rf"(?<=[.!?])[{SPACES}]+"), trimmed), lambda s: s != "")


def estimated_tokens(c: Column) -> Column:
    return F.ceil(F.size(words(c)) * F.lit(C.TOKENS_A_WORD))


def watermark_hash(corpus: Column, position: Column, text: Column) -> Column:
    """32-bit rolling hash (h * 31 + code) of corpus:position:first 64 characters, absolute, as 8 hex digits."""
    source = F.concat_ws(":", corpus, position.cast("string"), F.substring(text, 1, 64))
    h = F.aggregate(F.filter(F.split(source, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda a, x: F.pmod(a * 31 + F.ascii(x), F.lit(1 << 32)))
    return F.lpad(F.lower(F.hex(F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)))), 8, "0")


def embedding_input(publisher: Column, category: Column, tier: Column, date: Column, corpus: Column, text: Column) -> Column:
    part = lambda name, c: F.concat(F.lit(name + ": "), c)  # noqa: E731  null where c is
    head = F.concat_ws(" | ", part("[publisher", publisher), part("category", category), part("tier", tier), part("date", date), F.concat(F.lit("corpus: "), corpus, F.lit("]")))
    return F.concat(head, F.lit("\n"), text)


def corpus_tier(category: Column) -> Column:
    return F.when(category.isin("mainstream", "partisan"), "tier_4").when(category == "reference", "tier_3").when(category == "wire", "tier_2").otherwise("tier_5")


def strip_watermark(c: Column) -> Column:
    return replaced(c, WATERMARK)


def normalised(c: Column) -> Column:
    return F.trim(replaced(replaced(F.lower(c), r"[^\w\s]"), r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""

    def shared(s: Column) -> Column:
        union = F.size(F.array_union(s["a"], s["b"]))
        return F.when(union > 0, F.size(F.array_intersect(s["a"], s["b"])) / union).otherwise(F.lit(0.0))

    return once(F.struct(a.alias("a"), b.alias("b")), shared)


def word_jaccard(a: Column, b: Column) -> Column:
    """0 where either text has no words. Each text is made even once."""

    def shared(t: Column) -> Column:
        sets = F.struct(*(F.array_distinct(F.split(t[i], " ")).alias(x) for i, x in enumerate("ab")))
        sized = lambda s: once(F.size(F.array_intersect(s["a"], s["b"])), lambda n: n / (F.size(s["a"]) + F.size(s["b"]) - n))
        return F.when((t[0] == "") | (t[1] == ""), F.lit(0.0)).otherwise(F.coalesce(once(sets, sized), F.lit(0.0)))

    return once(F.array(normalised(a), normalised(b)), shared)


def canonical_key(url: Column, text: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(url, F.lit("")), F.lit("no-url")), F.lit("::"), F.substring(normalised(text), 1, 200))


def scope_tokens(c: Column) -> Column:
    tokens = F.split(replaced(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_except(F.filter(tokens, lambda t: F.length(t) >= 3), F.array(*map(F.lit, C.STOP_WORDS)))


def domain(url: Column) -> Column:
    return replaced(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value worked out once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _parents(url: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(domain(url), r"\.")
    return once(labels, lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), ".")))


def _among(parents: Column, domains: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parents, F.array(*map(F.lit, domains)))


def evidence_tier(url: Column, category: Column) -> Column:
    tiers = (("T1", C.OFFICIAL_DOMAINS), ("T2", C.WIRE_DOMAINS), ("T3", C.REFERENCE_DOMAINS), ("T4", C.MAINSTREAM_DOMAINS))
    by_host = once(_parents(url), lambda x: F.coalesce(*(F.when(_among(x, domains), tier) for tier, domains in tiers)))
    return F.coalesce(by_host, F.when(category == "reference", "T3").when(category == "mainstream", "T4").otherwise("T5"))


def web_tier(url: Column) -> Column:
    tiers = (("T1", C.OFFICIAL_DOMAINS), ("T2", C.WIRE_DOMAINS), ("T3", C.REFERENCE_DOMAINS))
    return once(_parents(url), lambda x: F.coalesce(*(F.when(_among(x, domains), tier) for tier, domains in tiers), F.lit("T4")))


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a pattern fits, whatever the case. One is only tried on texts with a word that its matches need."""
    low, found = F.lower(c), F.lit(False)
    for p in patterns:
        held = [F.contains(low, F.lit(w)) for w in C.NEEDED_WORDS[p].split()]
        found = found | (reduce(or_, held) & c.rlike("(?i)" + p))
    return found


def claim_risk(c: Column) -> Column:
    return F.when(any_of(c, C.CRITICAL_RISK), "CRITICAL").when(any_of(c, C.HIGH_RISK), "HIGH").when(any_of(c, C.MEDIUM_RISK), "MEDIUM").otherwise("LOW")


def is_attribution(c: Column) -> Column:
    return any_of(c, C.ATTRIBUTION)


def is_legal(c: Column) -> Column:
    return c.rlike("(?i)" + C.LEGAL_CLAIM)


def is_event(c: Column) -> Column:
    return c.rlike("(?i)" + C.EVENT_CLAIM) & c.rlike(C.PROPER_NOUN)


def _named(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def _clean_name(c: Column) -> Column:
    return replaced(replaced(trimmed(F.lower(c)), r"""[.,;:!?"'()\[\]{}]"""), rf"[{SPACES}]+", " ")


def entity(c: Column) -> Column:
    clean = F.trim(_clean_name(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.try_element_at(_named(C.ENTITY_ALIASES), clean), clean)


def geo(c: Column) -> Column:
    """Code of a place: the whole name, else the first of its parts that is known, else the cleaned name."""
    clean = _clean_name(c)
    codes = _named(C.GEO_CODES)
    parts = F.filter(F.transform(F.split(clean, r"[,/&]+"), lambda p: F.try_element_at(codes, F.trim(p))), lambda p: p.isNotNull())
    return F.coalesce(F.try_element_at(codes, clean), F.get(parts, F.lit(0)), F.nullif(clean, F.lit("")), F.lit("unknown"))


def keyword_overlap(keywords: Column, text: Column) -> Column:
    parts = F.flatten(F.transform(keywords, lambda k: F.split(F.lower(k), r"\s+")))
    return F.arrays_overlap(parts, F.split(F.lower(text), r"\W+"))


def policy_domain(classification: Column) -> Column:
    low, out = F.lower(classification), None
    for name, parts in C.POLICY_WORDS:
        hit = low.rlike("|".join(parts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def dimension(policy: Column) -> Column:
    return F.coalesce(F.try_element_at(_named(C.DIMENSIONS), policy), F.lit("general"))


def excerpt(c: Column) -> Column:
    return F.substring(trimmed(replaced(c, r"(?s)<!--.*?-->")), 1, 180)


def xml_escape(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def share_card(title: Column, description: Column, url: Column) -> Column:
    """The meta elements that a shared link is shown by; of the description its first 160 characters."""
    meta = lambda name, c: F.concat(F.lit(f'<meta property="og:{name}" content="'), xml_escape(c), F.lit('"/>'))
    return F.concat(meta("title", title), meta("description", F.substring(description, 1, 160)), meta("url", url))


def clean_json(c: Column) -> Column:
    """What a model wrote between code fences."""
    fenced = c.contains("```")  # most answers have none, and patterns cost
    return F.when(fenced, trimmed(replaced(replaced(trimmed(c), rf"^```(?:json)?[{SPACES}]*"), rf"[{SPACES}]*```$"))).otherwise(trimmed(c))


def html_text(c: Column) -> Column:
    """Readable text of a page: without scripts, styles and tags, entities decoded, white space collapsed."""
    bare = replaced(replaced(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<!--.*?-->", " ")
    return F.trim(replaced(decode_named_entities(strip_tags(bare)), r"\s+", " "))


def quote_matches(segment: Column, quote: Column) -> Column:
    """A quote is in a segment as it stands, or with case and white space made equal, or for at least 80 % of its (three or
    more) words in order; a word that isn't found uses up the rest of the segment."""
    even = lambda c: trimmed(replaced(F.lower(c), rf"[{SPACES}]+", " "))
    seg, low = even(segment), even(quote)
    sought, rest = words(low), F.split(seg, " ")

    def next_word(state: Column, w: Column) -> Column:
        at = F.array_position(F.slice(rest, state["used"] + 1, F.size(rest)), w).cast("int")
        return F.struct(F.when(at > 0, state["used"] + at).otherwise(F.size(rest)).alias("used"), (state["found"] + (at > 0).cast("int")).alias("found"))

    found = F.aggregate(sought, F.struct(F.lit(0).alias("used"), F.lit(0).alias("found")), next_word)["found"]
    return F.contains(segment, quote) | F.contains(seg, low) | ((F.size(sought) >= 3) & (found >= 0.8 * F.size(sought)))
