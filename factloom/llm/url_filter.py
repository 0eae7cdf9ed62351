"""Operator 5: URL filter. Rules by host and path first, else logistic regression on hashed character n-grams.

DataFrame functions only. Features are the 3- and 4-grams of host and path between marks, hashed by a polynomial of their
code points; a URL's score is the sum of their weights over the root of their number, plus a bias. The weights come from a
small labelled URL table (at most MAX_LABELLED rows) by gradient descent with momentum and a ridge. It runs in the dual, one
coefficient for each labelled URL on their Gram matrix, inside one expression; the weights are then summed from the coefficients.

Defined results: a null URL or one without "://" has empty host and path, fits no rule and gets the verdict of the bias and
the marks alone; repeated rows and page_ids each get a row; a null page_id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SLOTS, BASE, SIZES = 4096, 131, (3, 4)
BIAS_SLOT = SLOTS
STEPS, RATE, MOMENTUM, RIDGE = 150, 2.0, 0.9, 0.0006
MAX_LABELLED = 400
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Parts of the packaged table. Names to block are a topic and a lure, names to allow a subject and a place or invented; what
#: stands before and after a name, its end and its path come from the same lists in both classes, so that names decide.
_BAD = ("casino", "poker", "slots", "bets", "betting", "jackpot", "lottery", "roulette", "viagra", "cialis", "pills", "pharmacy", "steroids", "xxx", "porn", "adult", "sexcams", "escorts", "hookup", "warez", "keygen", "cracked", "torrents", "replica", "fakewatches", "payday", "loans", "forex", "airdrop", "spam", "backlinks", "followers", "clicks", "adserver", "tracker", "prizes", "winner", "giveaway", "phishing", "malware", "verifyaccount", "securelogin", "walletrecover")
_LURES = ("free", "best", "cheap", "win", "bonus", "hot", "top", "get", "buy", "instant", "vip", "real", "live", "easy", "mega", "super", "farm", "promo", "deal", "now")
_GOOD = ("library", "university", "museum", "weather", "journal", "research", "council", "hospital", "school", "history", "science", "garden", "recipes", "travel", "maps", "news", "times", "tribune", "herald", "docs", "developer", "code", "wiki", "archive", "parliament", "health", "climate", "energy", "transport", "railway", "football", "chess", "music", "theatre", "film", "books", "language", "medicine", "court", "ocean")
_PLACES = ("national", "city", "open", "central", "north", "london", "berlin", "paris", "madrid", "tokyo", "state", "royal", "public", "digital", "world", "local", "my", "the", "our", "daily")
_ONSETS, _VOWELS, _CODAS = ("b", "th", "r", "st", "l", "m", "k", "wh", "n", "v", "sh", "d", "g", "t", "p"), ("a", "e", "o", "i", "u", "ou", "ea"), ("n", "r", "", "s", "ng", "l", "nd", "", "t", "th", "sh")
_BEFORE = ("www.", "", "m.", "blog.", "")
_ENDS = ("com", "org", "net", "example.com", "example.org", "example.net", "info", "de", "co.uk", "io", "biz", "eu", "online")
_PATHS = ("/", "/en/1234.html", "/de/912/", "/fr/5821", "/es/77", "/about", "/post/1", "/news/2019/05", "/index.html", "/article/88?page=2", "/user/profile", "/download/report.pdf", "/shop/books", "/login", "", "/register-now", "/offer/12", "/search?q=win")


def _invented(i: int) -> str:
    """A name of two or three syllables."""
    places = [(i * (k + 3) + k * 7, k) for k in range(2 + i % 2)]
    return "".join(_ONSETS[j % len(_ONSETS)] + _VOWELS[(j // 3 + k) % len(_VOWELS)] + _CODAS[j // 2 % len(_CODAS)] for j, k in places)


def labelled_rows(first: int = 0, n: int = 130) -> list[tuple[str, int]]:
    """The packaged table of invented URLs, 1 to block, 0 to allow: threes first, first + 1, ... of a rule that goes through the
    parts in strides, so that names differ. Threes from 1000 on are kept for tests."""

    def url(name: str, i: int) -> str:
        return f"http{'s' * (i % 3 > 0)}://{_BEFORE[i % len(_BEFORE)]}{name}.{_ENDS[(i * 5 + i // 13) % len(_ENDS)]}{_PATHS[(i * 7 + i // 18) % len(_PATHS)]}"

    rows = []
    for i in range(first, first + n):
        a, b = _BAD[i * 7 % len(_BAD)], _LURES[(i * 3 + i // 20) % len(_LURES)]
        rows.append((url((f"{b}-{a}", f"{a}-{b}", f"{a}{b}", f"{b}{a}")[i // 2 % 4], i), 1))
        a, b = _GOOD[i * 7 % len(_GOOD)], _PLACES[(i * 3 + i // 20) % len(_PLACES)]
        rows.append((url((f"{b}-{a}", f"{a}-{b}", f"{b}{a}", a)[i // 2 % 4], i), 0))
        rows.append((url(_invented(i), i), 0))
    return rows


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first "://"; empty without one."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict), null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [(v, h + p, ((host == h) | host.endswith("." + h)) & path.startswith(p)) for v, h, p in ordered]
    none = F.lit(None).cast("string")
    return F.coalesce(*(F.when(c, F.lit(name)) for _, name, c in fits), none), F.coalesce(*(F.when(c, F.lit(v)) for v, _, c in fits), none)


def _places(n: int) -> Column:
    """Where n-grams start."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size("codes"), F.lit(1))), lambda i: i <= F.size("codes") - (n - 1))


def _slot(n: int) -> Callable[[Column], Column]:
    def slot(i: Column) -> Column:
        h = F.lit(n).cast("long")
        for j in range(n):
            h = F.pmod(h * F.lit(BASE) + F.element_at("codes", (i + j).cast("int")), F.lit(SLOTS * 1_000_003))
        return F.pmod(h, F.lit(SLOTS)).cast("int")

    return slot


def with_grams(df: DataFrame) -> DataFrame:
    """df (with host and path) and grams: the slots of all n-grams, repeats included."""
    df = df.withColumn("codes", F.transform(F.split(F.concat(F.lit("^"), "host", F.lit("|"), "path", F.lit("$")), ""), lambda c: F.ascii(c).cast("long")))
    made = [F.transform(_places(n), _slot(n)) for n in SIZES]
    return df.withColumn("grams", F.concat(*made)).drop("codes")


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights by slot and bias from (url, y). At most MAX_LABELLED rows are taken, those of smallest hash; null labels are none."""
    rows = labelled.where("url is not null and y in (0, 1)").groupBy("url").agg(F.max("y").cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("url"), "url").limit(MAX_LABELLED)
    rows = rows.select(F.xxhash64("url").alias("id"), "y", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    grams = with_grams(rows).select("id", "y", F.explode("grams").alias("g"), (1 / F.sqrt(F.size("grams").cast("double"))).alias("x"))
    grams = grams.groupBy("id", "y", "g").agg(F.sum("x").alias("x"))
    grams = grams.unionAll(rows.select("id", "y", F.lit(BIAS_SLOT), F.lit(1.0)))  # every two rows share it
    left, right = grams.select(F.col("id").alias("a"), "y", "g", F.col("x").alias("xa")), grams.select(F.col("id").alias("b"), "g", F.col("x").alias("xb"))
    gram_matrix = left.join(right, "g").groupBy("a", "y", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("k"))
    lines = gram_matrix.groupBy("a", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "k"))), lambda s: s["k"]).alias("k"))
    one = lines.agg(F.sort_array(F.collect_list(F.struct("a", "y", "k"))).alias("rows"))
    zeros = F.transform("rows", lambda r: F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("was")))

    def step(alpha: Column, _: Column) -> Column:
        def moved(r: Column, i: Column) -> Column:
            z = F.aggregate(F.zip_with(r["k"], alpha, lambda k, x: k * x["a"]), F.lit(0.0), lambda s, v: s + v)
            own = F.element_at(alpha, i + 1)
            down = F.lit(RATE) / F.greatest(F.size(alpha), F.lit(1)) * (1 / (1 + F.exp(-z)) - r["y"])
            return F.struct((own["a"] * (1 - RATE * RIDGE) + F.lit(MOMENTUM) * (own["a"] - own["was"]) - down).alias("a"), own["a"].alias("was"))

        return F.transform("rows", moved)

    solved = one.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zeros, step).alias("alpha"))
    alpha = solved.select(F.explode(F.zip_with("rows", "alpha", lambda r, a: F.struct(r["a"].alias("id"), a["a"].alias("a")))).alias("s")).select("s.id", "s.a")
    found = alpha.join(grams, "id").groupBy("g").agg(F.sum(F.col("a") * F.col("x")).alias("w")).collect()  # at most SLOTS rows
    weights = [0.0] * (SLOTS + 1)
    for r in found:
        weights[r.g] = round(r.w, 9)
    return weights[:SLOTS], weights[BIAS_SLOT]


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """One row for each page: host, path, the rule that fits, and the verdict."""
    spark = pages.sparkSession
    weights, bias = train(spark.createDataFrame(labelled_rows(), "url string, y int") if labelled is None else labelled)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    table = F.array(*(F.lit(w) for w in weights))
    total = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.element_at(table, g + 1))
    score = F.lit(bias) + total / F.sqrt(F.greatest(F.size("grams"), F.lit(1)).cast("double"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    return with_grams(ruled).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score >= 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def oracle() -> str:
    """SQL that trains on the same table, step by step, and judges with what it has learnt."""
    values = ", ".join(f"('{u}', {y})" for u, y in labelled_rows())
    grams = []
    for n in SIZES:
        h = str(n)
        for j in range(n):
            h = f"(({h} * {BASE} + codes[i + {j}]) % {SLOTS * 1_000_003})"
        grams.append(f"list_transform(range(1, len(codes) - {n - 2}), lambda i: ({h} % {SLOTS})::int)")
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [(v, h + p, f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))") for v, h, p in ordered]
    rule = "case " + " ".join(f"when {c} then '{n}'" for _, n, c in fits) + " end"
    verdict = "case " + " ".join(f"when {c} then '{v}'" for v, _, c in fits) + " end"
    return f"""
with recursive urls as (select page_id, url, null::int as y from pages union all select null, url, max(y) from (values {values}) t(url, y) group by url),
cut as (select *, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from urls),
parts as (select *, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from cut),
coded as (select *, list_transform(string_split('^' || host || '|' || path || '$', ''), lambda c: unicode(c)::bigint) as codes from parts),
graded as (select *, list_concat({", ".join(grams)}) as g from coded),
learnt as (select row_number() over (order by url) as id, y::double as y, g from graded where y is not null),
x as (select id, slot, count(*) / sqrt(any_value(n)) as x from (select id, len(g) as n, unnest(g) as slot from learnt) group by id, slot union all select id, {BIAS_SLOT}, 1.0 from learnt),
k as (select a.id as a, b.id as b, sum(a.x * b.x)::double as k from x a join x b using (slot) group by all),
lines as (select id, any_value(y) as y, list(k order by b) as k from learnt join k on a = id group by id),
one as (select list(y order by id) as y, list(k order by id) as k, count(*) as n from lines),
steps as (select 0 as i, list_transform(y, lambda v: 0::double) as alpha, list_transform(y, lambda v: 0::double) as was from one
 union all select i + 1, list_transform(range(1, n + 1), lambda j: alpha[j] * {1 - RATE * RIDGE} + {MOMENTUM} * (alpha[j] - was[j]) - {RATE} / n * (1 / (1 + exp(-list_dot_product(k[j], alpha))) - y[j])), alpha from steps, one where i < {STEPS}),
found as (select slot, round(sum(alpha[id] * x), 9)::double as w from x, steps where i = {STEPS} group by slot),
weights as (select list(coalesce(w, 0) order by range) as w, (select w from found where slot = {BIAS_SLOT}) as bias from range({SLOTS}) left join found on slot = range)
select page_id, host, path, {rule} as rule, coalesce({verdict}, case when bias + coalesce(list_sum(list_transform(g, lambda s: w[s + 1])), 0) / sqrt(greatest(len(g), 1)) >= 0 then 'block' else 'allow' end) as verdict from graded, weights where y is null"""
