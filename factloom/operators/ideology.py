"""Propositions of segments, stances, and ability estimates of documents."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import constants as K
from factloom.functions import scores as S
from factloom.functions import text as T
from factloom.operators.evidence import top_k
from factloom.operators.vectors import unit
from factloom.session import ship

#: Segments and propositions that meet in one task.
BLOCK = 4096


def match_propositions(segments: DataFrame, bank: DataFrame) -> DataFrame:
    """(document_id, segment_id, proposition_id, sim, adjusted): six best propositions a segment above their bound, of the eight
    best segments a document. segments: document_id, segment_id, position_index, text, token_count, classification,
    embedding; bank: proposition_id, domain, keywords, embedding. Segments and bank meet in blocks by a matrix product; a task
    returns six rows a segment."""
    ship(segments.sparkSession)
    usable = segments.where(F.coalesce("token_count", F.lit(0)) >= K.STANCE_MIN_TOKENS).where("embedding is not null and segment_id is not null")
    doubles = F.col("embedding").cast("array<double>").alias("embedding")
    mine = usable.select("segment_id", T.policy_domain(F.col("classification")).alias("domain"), F.array_distinct(F.split(F.lower("text"), r"\W+")).alias("words"), doubles)
    theirs = bank.where("embedding is not null").select("proposition_id", "domain", F.flatten(F.transform("keywords", lambda k: F.split(F.lower(k), r"\s+"))).alias("words"), doubles)
    few, many = max(1, math.ceil(theirs.count() / BLOCK)), max(1, math.ceil(usable.count() / BLOCK))
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = mine.withColumn("j", each(few)).select(F.struct(deal("segment_id", many).alias("i"), "j").alias("at"), "segment_id", "domain", "words", "embedding")
    right = theirs.withColumn("i", each(many)).select(F.struct("i", deal("proposition_id", few).alias("j")).alias("at"), "proposition_id", "domain", "words", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in mine.select("segment_id").schema.fields + theirs.select("proposition_id").schema.fields}
    met = left.groupBy("at").cogroup(right.groupBy("at")).applyInArrow(_meet, f"segment_id {kinds['segment_id']}, proposition_id {kinds['proposition_id']}, sim double, adjusted double")
    rows = top_k(met, ["segment_id"], [F.desc("adjusted"), F.col("proposition_id")], K.PROP_TOP).join(usable.select("segment_id", "document_id", "position_index"), "segment_id")
    best = rows.groupBy("document_id", "segment_id", "position_index").agg(F.max("adjusted").alias("best"))
    chosen = top_k(best, ["document_id"], [F.desc(F.floor(F.col("best") * 1000)), F.col("position_index"), F.col("segment_id")], K.PROP_SEGMENTS)
    return rows.join(chosen.select("segment_id"), "segment_id", "left_semi").select("document_id", "segment_id", "proposition_id", "sim", "adjusted")


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best propositions of each segment in two blocks that meet."""
    out: list[tuple] = []
    if left.num_rows and right.num_rows:
        right = right.sort_by("proposition_id")  # of equals the smaller id goes first
        names, domains = right["proposition_id"].to_pylist(), np.array([x or "" for x in right["domain"].to_pylist()])
        unknown = np.array([x is None for x in right["domain"].to_pylist()])
        has: dict[str, list[int]] = {}
        for j, words in enumerate(right["words"].to_pylist()):
            for w in words or ():
                has.setdefault(w, []).append(j)
        v = unit(right["embedding"])
        for s in range(0, left.num_rows, 512):
            part = left.slice(s, 512)
            sim = np.round(unit(part["embedding"]) @ v.T, 9)
            hit = np.zeros(sim.shape, bool)
            for i, words in enumerate(part["words"].to_pylist()):
                hit[i, [j for w in words or () for j in has.get(w, ())]] = True
            other = np.array([[d is not None and not u and d != x for x, u in zip(domains, unknown, strict=True)] if d is not None else [False] * len(names) for d in part["domain"].to_pylist()]).reshape(sim.shape)
            adjusted = np.round(sim - K.CROSS_DOMAIN * other + K.KEYWORD_BOOST * hit, 9)
            usable = np.where(adjusted >= np.where(hit, K.PROP_SIM_KEYWORD, K.PROP_SIM_PLAIN), adjusted, -np.inf)
            ids = part["segment_id"].to_pylist()
            for i, order in enumerate(np.argsort(-usable, axis=1, kind="stable")[:, : K.PROP_TOP]):
                out += [(ids[i], names[j], float(sim[i, j]), float(adjusted[i, j])) for j in order if usable[i, j] > -np.inf]
    cols = list(zip(*out, strict=True)) if out else [()] * 4
    kinds = [left.schema.field("segment_id").type, right.schema.field("proposition_id").type, pa.float64(), pa.float64()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("segment_id", "proposition_id", "sim", "adjusted"), cols, kinds, strict=True)})


def usable_stances(stances: DataFrame, bank: DataFrame) -> DataFrame:
    """Stances that vote: known propositions, confidence of at least .50, PRO or ANTI, quote found."""
    clear = (F.col("confidence") >= K.STANCE_CLEAR) & F.coalesce("quote_ok", F.lit(True))
    kept = stances.where(F.col("confidence") >= K.STANCE_LEAST).withColumn("stance", F.when(clear, F.col("stance")).otherwise("UNCLEAR"))
    return kept.join(bank.select("proposition_id", "domain", "liberal_is_pro", "difficulty_b"), "proposition_id").where(F.col("stance").isin("PRO", "ANTI"))


def cap_domains(votes: DataFrame, key: str = "document_id") -> DataFrame:
    """Where a document's votes have two or more domains, none keeps over 40 % of them (at least one): the least sure go first,
    of equals the earliest. votes: key, idx, domain, confidence."""
    named = votes.withColumn("domain", F.coalesce("domain", F.lit("unknown")))
    all_ = Window.partitionBy(key)
    sizes = named.withColumn("_n", F.count("*").over(all_)).withColumn("_domains", F.size(F.collect_set("domain").over(all_)))
    order = Window.partitionBy(key, "domain").orderBy(F.desc("confidence"), F.desc("idx"))
    cap = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(K.DOMAIN_CAP)))
    return sizes.withColumn("_nth", F.row_number().over(order)).where((F.col("_domains") < 2) | (F.col("_nth") <= cap)).drop("_n", "_domains", "_nth")


def vote(stance: Column, liberal_is_pro: Column) -> Column:
    return ((stance == "PRO") == liberal_is_pro).cast("double")


def estimate(votes: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, score, theta_raw, se, n_propositions): one ability a document from votes (proposition_id, y, b); null under two
    propositions. Votes of equal difficulty are counted before they meet, so a document's row is as wide as the bank has
    difficulties, however many votes it has."""
    level = votes.groupBy(key, "b").agg(F.sum("y").alias("y"), F.count("*").alias("n"), F.min("proposition_id").alias("first"), F.max("proposition_id").alias("last"))
    several = F.min("first") != F.max("last")  # IRT_MIN_STANCES is two
    rows = level.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("b", "y", "n"))).alias("votes"), F.sum("n").alias("n_propositions"), F.coalesce(several, F.lit(False)).alias("several"))
    rows = rows.withColumn("m", F.when(F.col("several"), S.map_ability(F.col("votes"))))
    theta, h = F.col("m.theta"), F.when(F.col("several"), F.least(F.col("m.h"), F.lit(K.IRT_FLOOR)))
    return rows.select(key, S.round4(F.tanh(theta / 2)).alias("score"), S.round4(theta).alias("theta_raw"), S.round4(F.sqrt(-1 / h)).alias("se"), "n_propositions")


#: SQL for estimate(): a recursive step for each Newton step. Needs votes (key, axis, proposition_id, y, b).
ESTIMATE_SQL = f"""levels as (select key, axis, b, sum(y) as y, count(*) as n from votes group by all),
 sizes as (select key, axis, count(*) as n_propositions, count(distinct proposition_id) >= {K.IRT_MIN_STANCES} as several from votes group by all),
 steps as (select key, axis, 0::double as theta, 0::double as h, 0 as it, false as done from sizes where several
  union all select key, axis, theta - delta, h, it + 1, abs(delta) < {K.IRT_TOL} from (select *, greatest(-{K.IRT_MAX_STEP}, least({K.IRT_MAX_STEP}, g / least(h, {K.IRT_FLOOR}))) as delta from
   (select s.key, s.axis, s.theta, s.it, sum(y - n / (1 + exp(b - s.theta))) - s.theta as g, -sum(n / (1 + exp(b - s.theta)) * (1 - 1 / (1 + exp(b - s.theta)))) - 1 as h
    from steps s join levels l on l.key = s.key and l.axis = s.axis where not s.done and s.it < {K.IRT_STEPS} group by s.key, s.axis, s.theta, s.it))),
 ends as (select key, axis, arg_max(theta, it) as theta, arg_max(h, it) as h from steps group by key, axis),
 estimates as (select key, axis, floor(tanh(theta / 2) * 10000 + 0.5) / 10000 as score, floor(theta * 10000 + 0.5) / 10000 as theta_raw, floor(sqrt(-1 / case when h < {K.IRT_FLOOR} then h when h >= {K.IRT_FLOOR} then {K.IRT_FLOOR} end) * 10000 + 0.5) / 10000 as se, n_propositions
  from sizes left join ends using (key, axis))"""


def axes(votes: DataFrame, key: str = "document_id") -> DataFrame:
    """Overall, economic and social displays (tenfold score, 2 places); an axis with under two propositions takes the overall."""
    dim = T.dimension(F.col("domain"))
    overall = estimate(votes, key).select(key, "score", "se", "n_propositions")
    part = lambda name, dims: estimate(votes.where(dim.isin(*dims)), key).select(key, F.col("score").alias(name))
    rows = overall.join(part("e", ("economic",)), key, "left").join(part("s", ("social", "executive")), key, "left")
    show = lambda c: F.floor(c * 1000 + 0.5) / 100
    return rows.select(key, "score", "se", "n_propositions", show(F.coalesce("e", "score")).alias("economic"), show(F.coalesce("s", "score")).alias("social"))


def proxy(stances: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, n, score, raw): the older measure, the signed share of confidence and tanh of 1.5 times it; null under two stances
    that are sure enough and for or against. stances: key, stance, confidence, liberal_is_pro."""
    votes = stances.where(F.col("stance").isin("PRO", "ANTI") & (F.col("confidence") >= K.STANCE_LEAST))
    sign = F.when((F.col("stance") == "PRO") == F.col("liberal_is_pro"), F.col("confidence")).otherwise(-F.col("confidence"))
    raw = F.when(F.col("n") >= K.IRT_MIN_STANCES, F.col("signed") / F.nullif("sure", F.lit(0.0)))
    sums = votes.groupBy(key).agg(F.count("*").alias("n"), F.sum(sign).alias("signed"), F.sum("confidence").alias("sure"))
    return sums.select(key, "n", S.round4(F.tanh(1.5 * raw)).alias("score"), S.round4(raw).alias("raw"))


VERBS = ("expand public programmes for", "lower public spending on", "leave to local authorities", "set national standards for", "fund independent reviews of")


def seed_bank(spark) -> DataFrame:
    """A neutral bank of our own: five statements for each policy domain, made from a rule."""
    rows = []
    for domain, words in K.POLICY_WORDS:
        topic = domain.replace("_", " ")
        rows += [(f"{domain}-{n}", "economic" if K.DIMENSIONS[domain] == "economic" else "social", K.DIMENSIONS[domain], domain, f"The state should {v} {topic}", list(words), n in (0, 3, 4), 1.0, 0.0, "active") for n, v in enumerate(VERBS)]
    return spark.createDataFrame(rows, "proposition_id string, axis string, dimension string, domain string, text string, keywords array<string>, liberal_is_pro boolean, discrimination_a double, difficulty_b double, status string")


def seeded(bank: DataFrame) -> DataFrame:
    """The bank, or where it has fewer rows than the seed, the bank with the seed's propositions that it lacks."""
    seed = seed_bank(bank.sparkSession)
    if bank.limit(K.SEED_ROWS).count() >= K.SEED_ROWS:
        return bank
    return bank.unionByName(seed.join(bank.select("proposition_id"), "proposition_id", "left_anti"), allowMissingColumns=True)
