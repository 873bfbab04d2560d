"""URL filters, centroid clustering and periodic runs: brute-force versions,
and nulls, empty and very long rows, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hard_rows import HARD_ROWS, LONG

from lcspark.llm import centroids, periodic, urlfilter
from lcspark.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- URL filters -------------------------------------------------------------
URLS = [None, "", "no scheme.com/en/", "http://", "http:///en/", "HTTPS://WWW.Example.COM/en/x?y=://z", "x://a.b.com",
        "http://example.com/en/1", "http://EXAMPLE.com/EN/1", "http://notexample.com/en/", "http://a.www.example.com/en/",
        "http://com/", "http://.com/", "http://sub.net/es/#t", "http://net/fr/", "http://net/fr", "http://x.net?/es/",
        "http://u@h.net:80/es/", "http://spam-farm.org/", "http://m.spam-farm.org", "http://xspam-farm.org/",
        "http://ex.org/xmlrpc.php", "http://ex.org/xmlrpc.php?", "http://ex.org/checkout/a/b/payment",
        "http://ex.org/checkout/a/payments", "http://münchen.de/.git/\n", "http://ads-track.org/" + "p/" * 30_000,
        "http://a.b.com", "http://net/fr/", "ftp://x.org/a://b.com/wp-admin/"]


def slow_judgement(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host, tail = re.match(r"([^/?#]*)(.*)\Z", rest, re.S).groups()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    path = re.match("[^?#]*", tail)[0]
    fit = [r for r in rules if re.search(urlfilter.rule_regex(r.pattern).replace(r"\z", r"\Z"), host + tail)]
    if not fit:
        return host, path, None, "allow"
    best = min(fit, key=lambda r: (-r.tier, -len(r.pattern), r.verdict, r.name))
    return host, path, best.name, best.verdict


EXTRA_RULES = [urlfilter.Rule("any-php", "*.php", "block"), urlfilter.Rule("start", "|com/", "allow", 2),
               urlfilter.Rule("tie-b", "||net/fr|", "block", 1), urlfilter.Rule("tie-a", "||net/fr^", "allow", 1),
               urlfilter.Rule("sep", "^fr^", "block")]


@pytest.mark.parametrize("inline_rules", [urlfilter.INLINE_RULES, 0])
def test_urls_against_every_rule(spark, inline_rules):
    rules = [urlfilter.host_rule(p, v, 1) for p, v in q.HOST_RULES] + urlfilter.DEFAULT_RULES + EXTRA_RULES
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(URLS)] * 2
    df = spark.createDataFrame(rows, "id bigint, url string, host string, token string, group_size string")
    got = urlfilter.judge(df, rules, inline_rules=inline_rules)
    assert got.columns == ["id", "url", "token", "group_size", "host", "path", "rule", "rule_tier", "verdict"]
    back = got.collect()
    assert len(back) == len(rows)
    for r in back:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow_judgement(URLS[r["id"]], rules), URLS[r["id"]]
        assert (r["token"], r["group_size"]) == ("y", "z")
    assert urlfilter.judge(df.limit(0), rules, inline_rules=inline_rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(df, [], default="block").collect()} == {"block"}


def test_rule_tokens_are_whole():
    assert urlfilter.rule_tokens("||spam-farm.") == ["farm", "spam"]
    assert urlfilter.rule_tokens("casino") == [] and urlfilter.rule_tokens("*/x*y/Zed^") == ["zed"]
    assert urlfilter.rule_tokens("|a.b|") == ["a", "b"] and urlfilter.rule_tokens("/ads") == []


def test_rarest_token_files_the_rule(spark):
    df = spark.createDataFrame([("http://a.com/x/rare/",)] + [(f"http://b.com/x/{i}",) for i in range(5)], "url string")
    found = urlfilter._rarest(df, [urlfilter.Rule("r", "||com/x/rare/", "block"), urlfilter.Rule("s", "free", "block")], "url")
    assert found == {"||com/x/rare/": "rare", "free": ""}


def test_urls_need_no_shuffle_or_python(spark, sf_small):
    plan = q.QUERIES["op11_url_filters"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "MapIn" not in plan


# -- centroid clustering -------------------------------------------------------
def slow_clusters(ids, vectors, clusters, rounds, seed=2):
    v = [list(map(int, x)) for x in vectors]
    order = sorted(range(len(v)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), v[i]))
    c = [v[i] for i in order[:clusters]]

    def nearest():
        far = [[sum((a - b) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
        return [(f.index(min(f)), min(f)) for f in far]
    for _ in range(rounds):
        mine = nearest()
        for k in range(len(c)):
            own = [x for x, (j, _) in zip(v, mine) if j == k]
            if own:
                c[k] = [sum(col) // len(own) for col in zip(*own)]
    return nearest(), c


def check_clusters(spark, rows, dimensions, clusters, rounds=5):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<float>, cluster string, id string")
    got = centroids.cluster(df, clusters, rounds, dimensions).collect()
    kept = [(i, np.clip(np.floor(np.array(e, np.float32).astype(float) * 256), -2.0 ** 27, 2.0 ** 27)) for i, e in rows
            if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    want, c = slow_clusters([i for i, _ in kept], [e for _, e in kept], clusters, rounds)
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    inertia = {k: sum(d for j, d in want if j == k) for k in range(len(c))}
    assert sorted((r["id"] or 0, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == \
        sorted((i or 0, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (j, d) in zip(kept, want))


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(i % 4, 0.3, 6)]) for i in range(300)]
    check_clusters(spark, rows, 6, 7)


def test_clusters_of_hard_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]),
            (7, [0.5, -0.001]), (7, [0.5, -0.001]), (7, [-0.5, 2.0]), (None, [0.0, 0.0]), (None, [0.25, 0.0]),
            (8, [3e38, -3e38]), (9, [-3e38, 3e38]), (10, [1e-30, -1e-30]), (11, [100.0, 100.0])]
    for clusters in (1, 3, 40):
        check_clusters(spark, rows, 2, clusters)
    check_clusters(spark, rows[:3], 2, 4)
    check_clusters(spark, [], 2, 4)


def test_distance_tables():
    rng = np.random.default_rng(5)
    for most in (3, 300, 1 << 27):
        block, c = rng.integers(-most, most + 1, (3000, 5)), rng.integers(-most, most + 1, (4, 5))
        want = ((block[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        assert (centroids.distances(block.astype(np.int32), c) == want).all()


def test_clusters_do_not_depend_on_partitions(spark, sf_small):
    df = q.table(spark, sf_small, "embeddings")
    one, many = (centroids.cluster(df.repartition(n), rounds=2).toPandas().sort_values("id").drop(columns="centroid")
                 for n in (1, 17))
    pd.testing.assert_frame_equal(one.reset_index(drop=True), many.reset_index(drop=True))


# -- periodic runs ---------------------------------------------------------------
def slow_runs(x):
    """By comparing the text with itself at every distance."""
    found = {}
    for period in range(1, len(x) // 3 + 1):
        same = [a == b for a, b in zip(x, x[period:])] + [False]
        start = 0
        for i, s in enumerate(same):
            if not s:
                length = i - start + period
                if i > start and length >= max(24, 3 * period):
                    found.setdefault((start, length), period)
                start = i + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def repetitive(rng, n, letters, plants):
    x = rng.integers(0, letters, n)
    for _ in range(plants):
        a = int(rng.integers(0, max(1, n - 24)))
        length = int(rng.integers(1, n - a + 1))
        p = int(rng.integers(1, length // 3 + 2))
        x[a:a + length] = x[a + np.arange(length) % p]
    return x


def test_transform_and_distances():
    rng = np.random.default_rng(1)
    x = rng.integers(0, periodic.PRIME, (3, 16)).astype(np.uint64)
    root = pow(periodic.GENERATOR, (periodic.PRIME - 1) // 16, periodic.PRIME)
    want = [[sum(int(v) * pow(root, i * k, periodic.PRIME) for i, v in enumerate(row)) % periodic.PRIME for k in range(16)] for row in x]
    assert periodic.transform(x).tolist() == want
    assert (periodic.transform(periodic.transform(x), inverse=True) == x * np.uint64(16) % np.uint64(periodic.PRIME)).all()
    assert pow(root, 8, periodic.PRIME) == periodic.PRIME - 1
    for block in (8, 32):
        x = rng.integers(0, int((periodic.PRIME / block) ** 0.5), (6, block)).astype(np.uint64)
        flat = [int(v) for v in x.ravel()]
        for first in (0, 1):
            want = [[sum((flat[j * block + i] - flat[(j + first) * block + s + i]) ** 2 for i in range(block))
                     for s in range(block)] for j in range(4)]
            assert periodic.block_distances(x, block, first).tolist() == want


def test_runs_against_brute_force():
    rng = np.random.default_rng(2)
    texts = [repetitive(rng, int(rng.integers(1, 300)), int(rng.integers(1, 6)), int(rng.integers(0, 5))) for _ in range(300)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    texts += [np.array(fib[-1]), np.zeros(700, int), np.arange(900) % 7, np.arange(500), np.zeros(0, int), np.zeros(24, int),
              np.zeros(23, int), np.arange(24) % 8, np.arange(26) % 9, np.arange(27) % 9]
    assert periodic.find_runs(texts) == [slow_runs(t.tolist()) for t in texts]


def test_runs_when_numbers_clash(monkeypatch):
    """Words that get equal numbers at a scale only cost a comparison."""
    monkeypatch.setattr(periodic, "mix", lambda h: h & np.uint64(1))
    rng = np.random.default_rng(4)
    texts = [repetitive(rng, 200, 6, 2) for _ in range(40)]
    assert periodic.find_runs(texts) == [slow_runs(t.tolist()) for t in texts]


def test_long_periods_in_long_texts():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1000, 200_000)
    x[500:180_500] = x[500 + np.arange(180_000) % 50_021]
    (run,) = periodic.find_runs([x])[0]
    assert run[2] == 50_021 and run[0] <= 500 and run[0] + run[1] >= 180_500
    assert periodic.find_runs([np.zeros(150_000, int)]) == [[(0, 150_000, 1)]]


def test_runs_of_hard_rows(spark, hard, none):
    df = hard.withColumnRenamed("slot", "runs").withColumnRenamed("node", "collapsed")
    got = periodic.with_runs(df).collect()
    assert len(got) == len(HARD_ROWS)
    for r in got:
        words = WORD.findall(r["text"] or "")
        want = [(0, 40_000, 2)] if r["text"] == LONG else []
        assert [tuple(x) for x in r["runs"]] == want and r["n_words"] == len(words)
        assert r["collapsed"] == " ".join(words[:2] if want else words)
    assert periodic.with_runs(none).count() == 0


def test_most_periodic(spark):
    runs = "array<struct<start:bigint,length:bigint,period:bigint>>"
    rows = [([],), (None,), ([(5, 24, 3), (1, 30, 4), (2, 48, 6), (2, 8, 1)],), ([(1, 100_000_001, 3), (9, 100_000_000, 3)],)]
    df = spark.createDataFrame(rows, f"runs {runs}")
    assert [r[0] and tuple(r[0]) for r in df.select(periodic.most_periodic(df["runs"])).collect()] == \
        [None, None, (2, 8, 1), (1, 100_000_001, 3)]


def test_op13_against_brute_force(spark, sf_small, docs_small):
    got = q.QUERIES["op13_periodic_runs"](spark, sf_small).toPandas().set_index("doc_id")
    assert len(got) == len(docs_small)
    seen = 0
    for doc, text in zip(docs_small.doc_id, docs_small.text):
        words, row = WORD.findall(text or ""), got.loc[doc]
        h, n = zlib.crc32(str(doc).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 3000:
            continue                                       # too slow here; long texts have tests of their own
        runs = slow_runs(words)
        gone = {i for s, length, period in runs for i in range(s + period, s + length)}
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        if runs:
            s, m, p = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (s, m, p, 1000 * m // p)
            seen += 1
        else:
            assert row[["start", "length", "period", "exponent_milli"]].isna().all()
    assert seen >= 5
