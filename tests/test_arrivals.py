"""Events in the order of arrival, against one document after another."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from factloom import constants as K
from factloom.operators import arrivals

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / n), 9) if n else 0.0


def one_by_one(docs, known):
    """Every document against all events so far; no blocks, no reach but the rule's own."""
    import hashlib

    events = [dict(zip(("event_id", "key", "kind", "geo", "bucket", "entities", "centroid", "n"), (str(e[0]), *e[1:4], e[4].timestamp(), *e[5:]), strict=True)) for e in known]
    out = {}
    for doc_id, at, kind, geo, entities, vec in sorted((d for d in docs if d[1]), key=lambda d: (d[1], d[0])):
        bucket = at.replace(hour=at.hour // 6 * 6, minute=0, second=0, microsecond=0)
        key = hashlib.sha256("|".join([kind, geo, bucket.strftime("%Y-%m-%dT%H:%M:%S.000Z"), ",".join(sorted(entities))]).encode()).hexdigest()
        same = sorted((e for e in events if e["key"] == key), key=lambda e: e["event_id"])
        if same:
            same[0]["n"] += 1
            out[doc_id] = (same[0]["event_id"], "exact")
            continue
        near = []
        for e in events if vec is not None else []:
            if e["centroid"] is not None and abs(e["bucket"] - at.timestamp()) <= K.EVENT_HOURS * 3600 and (s := cosine(vec, e["centroid"])) > K.EVENT_KNN_SIM:
                near.append((-s, e["event_id"], e))
        scored = []
        for s, name, e in sorted(near, key=lambda x: x[:2])[: K.EVENT_KNN]:
            a, b = set(entities), set(e["entities"])
            shared = len(a & b) / len(a | b) if a | b else 0.0
            kinds = 1.0 if e["kind"] == kind else 0.5 if "OTHER" not in (kind, e["kind"]) else 0.0
            scored.append((-(K.EVENT_SIM * -s + K.EVENT_JACCARD * shared + K.EVENT_GEO * (e["geo"] == geo) + K.EVENT_TYPE * kinds), s, name, shared, e))
        best = min(scored, key=lambda x: x[:3]) if scored else None
        if best and -best[0] >= K.EVENT_ACCEPT and best[3] >= K.EVENT_MIN_JACCARD:
            e = best[4]
            e["centroid"] = [(a * e["n"] + b) / (e["n"] + 1) for a, b in zip(e["centroid"], vec, strict=True)]
            e["n"] += 1
            out[doc_id] = (e["event_id"], "crosswalk")
        else:
            events.append({"event_id": key, "key": key, "kind": kind, "geo": geo, "bucket": bucket.timestamp(), "entities": entities, "centroid": vec, "n": 1})
            out[doc_id] = (key, "new")
    return out, {e["event_id"]: e for e in events}


def story(seed, n, hours, step):
    """Documents of a few drifting subjects; ties in time, null vectors, gaps."""
    rng = np.random.default_rng(seed)
    subjects = rng.normal(size=(6, 8))
    docs, at = [], START
    for i in range(n):
        at = at + timedelta(seconds=int(rng.integers(0, step))) + (timedelta(hours=hours) if rng.random() < 0.02 else timedelta(0))
        k = int(rng.integers(0, 6))
        subjects[k] += rng.normal(size=8) * 0.25
        vec = None if rng.random() < 0.05 else (subjects[k] + rng.normal(size=8) * 0.6).tolist()
        names = sorted({f"s{k}", *(f"n{j}" for j in rng.integers(0, 4, int(rng.integers(0, 3))))}) if rng.random() < 0.95 else []
        docs.append((i, at, ["POLICY", "OTHER", "CONFLICT"][k % 3], ["US", "FR"][k % 2], names, vec))
    return docs


@pytest.mark.parametrize(("seed", "n", "hours", "step"), [(1, 250, 200, 9000), (2, 250, 30, 30_000), (3, 120, 500, 600)])
def test_equals_one_by_one(spark, seed, n, hours, step):
    docs = story(seed, n, hours, step)
    rng = random.Random(seed)
    known = [(900 + i, None, d[2], d[3], d[1].replace(hour=d[1].hour // 6 * 6, minute=0, second=0, microsecond=0) + timedelta(hours=6 * rng.randint(-9, 9)), d[4], d[5], rng.randint(1, 5)) for i, d in enumerate(rng.sample(docs, 12))]
    want, events = one_by_one(docs, known)
    random.Random(9).shuffle(docs)
    d = spark.createDataFrame([*docs, (9999, None, "POLICY", "US", [], None)], "doc_id long, at timestamp, event_type string, geo string, entities array<string>, vec array<double>")
    k = spark.createDataFrame(known, "event_id long, event_key string, event_type string, geo string, bucket timestamp, entities array<string>, centroid array<double>, document_count int")
    found, after = arrivals.resolve_arrivals(d.repartition(3), k)
    got = {r.doc_id: (r.event_id, r.how) for r in found.collect()}
    assert got == want and len(Counter(h for _, h in got.values())) == 3
    states = {r.event_id: r for r in after.collect()}
    met = {e for e, _ in want.values()}
    assert met <= set(states) <= set(events)
    for name, r in states.items():
        assert r.n == events[name]["n"] and (r.centroid is None) == (events[name]["centroid"] is None)
        assert r.centroid is None or np.allclose(r.centroid, events[name]["centroid"])


def test_without_documents_or_events(spark):
    none = spark.createDataFrame([], "doc_id long, at timestamp, event_type string, geo string, entities array<string>, vec array<double>")
    found, after = arrivals.resolve_arrivals(none)
    assert found.collect() == [] and after.collect() == []
