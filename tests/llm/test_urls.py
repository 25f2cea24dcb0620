"""URL parsing, fixed rules and mined rules against plain Python."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm.url_rules import UrlRule, judge, mine, parts_of, tokens, with_host_and_path

RULES = [UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/")]
ODD = [None, "", "no scheme/x", "http://", "HTTP://WWW.Example.COM/en/x", "http://xexample.com/en/", "http://example.com", "http://example.com?x=/en/", "http://a.net/es/1#f", "http://a.net/es", "x://b://c.net/fr/?q", "http://É.com/É", "http://example.com/en/\nmore?x\ny", "http://net/fr/", "://com/"]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


def fixed(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def pages(spark):
    rng = random.Random(2)
    urls = list(ODD)
    for k in range(400):
        urls.append(f"https://{rng.choice(['m', 'www', 'spam'])}.{rng.choice(['aa', 'bb', 'cc'])}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'es', 'fr'])}/{k}{rng.choice(['', '?x=1', '#t', '.html'])}")
    urls += urls[:30]
    rows = list(enumerate(urls)) + [(None, urls[-1])]
    return rows, spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as tokens", "3 as id").repartition(3)


def test_hosts_and_rules(spark):
    rows, df = pages(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = []
    for k, url in rows:
        host, path = parsed(url)
        rule = fixed(host, path)
        want.append((k, host, path, rule and rule.host + rule.path, rule.verdict if rule else "allow", None))
    assert sorted(map(tuple, judge(df, labels, RULES).collect()), key=str) == sorted(want, key=str)
    assert judge(df.limit(0), labels, RULES).count() == 0


def test_mined_rules(spark):
    rows, df = pages(spark)
    rng = random.Random(3)
    bad = lambda url: url is not None and ("spam" in url and "/fr/" in url or ".cc." in url and ".org" in url)
    labels = spark.createDataFrame([(k, int(not bad(u)), 0) for k, u in rows if k is not None and rng.random() < 0.8] + [(None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    urls = with_host_and_path(df.select(F.col("page_id").alias("id"), "url")).select("id", tokens().alias("tokens"))
    sets = {r["id"]: frozenset(r["tokens"]) for r in urls.where("id IS NOT NULL").collect()}
    judged = {r["doc_id"]: r["quality"] == 0 for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None}
    frequent, with_bad = Counter(), Counter()
    for k, is_bad in judged.items():
        for n in range(1, len(sets[k]) + 1):
            for c in itertools.combinations(sorted(sets[k]), n):
                frequent[c] += 1
                with_bad[c] += is_bad
    least = max(0.002 * len(judged), 8)
    want = {c: with_bad[c] / n for c, n in frequent.items() if with_bad[c] >= least and with_bad[c] / n >= 0.9}
    got = mine(urls, labels, 0.002, 8, 0.9, "quality = 0", "id", "doc_id").collect()
    # a rule's every choice of tokens is one of the brute ones, and each brute one holds such a choice
    choices = {c: r["confidence"] for r in got for c in (tuple(sorted(x)) for x in itertools.product(*r["needs"]))}
    assert want and all(round(want[c], 9) == round(x, 9) for c, x in choices.items())
    assert [w for w in want if not any(set(c) <= set(w) for c in choices)] == []
    assert all(r["anchors"] in r["needs"] for r in got)
    found = {(r["page_id"], r["verdict"], r["rule"]) for r in judge(df, labels, RULES, min_count=8, min_confidence=0.9, bad="quality = 0").collect()}
    for k, url in rows:
        if k is None:
            continue
        rule = fixed(*parsed(url))
        match = any(set(c) <= sets[k] for c in want)
        assert (k, rule.verdict if rule else "block" if match else "allow", rule and rule.host + rule.path) in found
    assert any(v == "block" and r is None for _, v, r in found)


def test_many_query_keys_are_mined_in_bounded_time(spark):
    rng = random.Random(4)
    keys = [f"k{k}" for k in range(20)]
    rows = []
    for k in range(300):  # one url shape; some keys stand always together, the others nearly
        own = [x for j, x in enumerate(keys) if j < 10 or rng.random() < 0.95]
        rows.append((k, f"http://h{k % 3}.org/{'buy' if k % 4 == 0 else 'read'}/{k}?" + "&".join(f"{x}=1" for x in own)))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, int(not ("/buy/" in u and "//h0" in u)), 0) for k, u in rows], "doc_id long, quality int, toxic int")
    began = time.perf_counter()
    got = {r["page_id"]: r["verdict"] for r in judge(pages, labels, [], min_confidence=0.95).collect()}
    assert time.perf_counter() - began < 20
    assert got == {k: "block" if "/buy/" in u and "//h0" in u else "allow" for k, u in rows}


def test_every_token_of_a_url_counts(spark):
    rng = random.Random(6)
    rows = []
    for k in range(400):
        own = {j for j in range(30) if rng.random() < 0.8}
        rows.append((k, own, not {3, 17, 29} <= own or rng.random() < 0.05))
    urls = spark.createDataFrame([(k, [f"key:{j:02}" for j in own]) for k, own, _ in rows], "id long, tokens array<string>")
    labels = spark.createDataFrame([(k, int(good)) for k, _, good in rows], "doc_id long, quality int")
    has, bad = np.array([[j in own for j in range(30)] for _, own, _ in rows]), np.array([not good for *_, good in rows])
    want = {}
    for n in (1, 2, 3):
        for c in itertools.combinations(range(30), n):
            hit = has[:, c].all(1)
            if (hit & bad).sum() >= 20 and (hit & bad).sum() / hit.sum() >= 0.9:
                want[tuple(f"key:{j:02}" for j in c)] = (hit & bad).sum() / hit.sum()
    began = time.perf_counter()
    got = mine(urls, labels, 0.002, 20, 0.9, "quality = 0", "id", "doc_id").collect()
    assert time.perf_counter() - began < 30
    assert ("key:03", "key:17", "key:29") in want
    assert {tuple(sorted(sum(r["needs"], []))): round(r["confidence"], 9) for r in got} == {c: round(x, 9) for c, x in want.items()}


def test_parts_hold_every_choice(spark):
    for n in (0, 1, 3, 8, 9, 10, 17):
        df = spark.createDataFrame([([f"t{j}" for j in range(n)],)], "items array<string>")
        parts = [set(r["items"]) for r in parts_of(df, "items", 3, 2).collect()]
        assert all(len(p) <= 6 for p in parts) and len(parts) == len({frozenset(p) for p in parts})
        assert all(any(set(c) <= p for p in parts) for c in itertools.combinations([f"t{j}" for j in range(n)], min(3, n)))
