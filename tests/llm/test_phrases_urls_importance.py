"""Collocations, URL filters and resampling against brute-force versions, with nulls, empties, long texts, ties, repeats and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from halyard.llm import importance, phrases, url_filter
from halyard.llm.url_filter import Reputation, Rule

DOCS = "doc_id long, text string, lang string, id long, n long, phrase string, f long, slot long, words int, host string, rank int"
EXTRA = (1, 2, "x", 3, 4, 5, "h", 6)


def rows_of(texts):
    return [(i, t, lang, *EXTRA) for i, (t, lang) in enumerate(texts)]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    words = ["aa", "b", "cc", "dé", "E", "ff\x00", "g\u2028g"]
    out = []
    for i in range(120):
        t = "".join(rnd.choice(words) + rnd.choice(["  ", " ", "\t", ". ", ",", "\n", "\r", " ", " "]) for _ in range(rnd.randint(0, 60)))
        out.append((t, rnd.choice(["en", "en", "fr", None])))
    out += [(None, "en"), ("", "fr"), (" .;! ", None), ("b " * 4000, "en"), ("B cc b " * 300, "xx"), *[out[0]] * 3]
    return out


def brute_collocations(texts, least, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for t, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if a >= least}
        found = []
        for p, a in often.items():
            if len(p) == 1 or any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, cut = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("slots,block", [(1 << 26, 1 << 22), (1 << 15, 700)])
def test_collocations(spark, corpus, monkeypatch, slots, block):
    monkeypatch.setattr(phrases, "BLOCK", block)
    df = spark.createDataFrame(rows_of(corpus), DOCS).repartition(3)
    for least, top in ((5, 2000), (8, 7)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, top=top, slots=slots, parts=4).collect())
        assert got == brute_collocations(corpus, least, top)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_do_not_overflow(spark):
    """2^62 * 1000 / 3 needs more than 64 bits."""
    df = spark.range(1).select(F.lit(2**53).alias("n"), F.lit(2**52).alias("a"), F.lit(2**52 + 1).alias("l"), F.lit(2**52 + 3).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    got = df.select(F.call_function("div", (F.lit(1000) * F.col("n")).cast("decimal(19,0)") * wide("a"), wide("l") * wide("r"))).first()[0]
    assert got == 1000 * 2**53 * 2**52 // ((2**52 + 1) * (2**52 + 3))


def test_lists_hold_every_position(spark, corpus):
    """The inverted lists give back the texts' words in order, with a gap between pieces."""
    import numpy as np

    df = spark.createDataFrame(rows_of(corpus), DOCS).coalesce(1)
    for r in phrases.inverted_lists(df).collect():
        at = np.cumsum(np.frombuffer(r.positions, np.int32), dtype=np.int32)
        placed = dict(zip(at.tolist(), [w for w, k in zip(r.words, r.lengths) for _ in range(k)], strict=True))
        text = "\n".join(lower(t) for t, lang in corpus if (lang or "und") == r.lang)
        assert [placed[i] for i in sorted(placed)] == re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", text)


RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]
URLS = [
    ("http://A.example.NET/en/1?x=/", "a.example.net", "/en/1", "example.net/en/"),
    ("https://example.net/fr/1", "example.net", "/fr/1", "net/"),
    ("https://badexample.net/en/", "badexample.net", "/en/", "net/"),
    ("http://net", "net", "", None),
    ("http://net/", "net", "/", "net/"),
    ("http://x.example.com/de/2#/fr/", "x.example.com", "/de/2", "example.com/de/"),
    ("http://x.example.com/de", "x.example.com", "/de", None),
    ("http://y.org/fr/://z/", "y.org", "/fr/://z/", "org/fr/"),
    ("no scheme.net/", "", "", None),
    (None, "", "", None),
    ("", "", "", None),
    ("a\n://É.org?q://b", "É.org", "", None),
    ("http://bad.example.com/en/7", "bad.example.com", "/en/7", None),
    ("http://" + "l" * 100_000 + ".com/" + "p" * 100_000, "l" * 100_000 + ".com", "/" + "p" * 100_000, None),
]


def brute_shares(hosts, prior):
    """(n, bad) by host -> posterior bound by host."""

    def level(groups):
        rho_up = sum((b - n * m) ** 2 / (m * (1 - m)) - n for n, b, m, _ in groups.values())
        rho_down = sum(n * (n - 1) for n, _, _, _ in groups.values())
        rho = rho_up / rho_down if rho_down else 0
        s = min(max(1 / rho - 1, prior.weakest), prior.strongest) if rho > 0 else prior.strongest
        own = {g: 1 / (1 / (s + 1) + 1 / (k + 1)) - 1 for g, (_, _, _, k) in groups.items()}
        return {g: ((b + own[g] * m) / (n + own[g]), n + own[g]) for g, (n, b, m, _) in groups.items()}

    def above(host):
        p = host.split(".")
        two = ".".join(p[-2:])
        return (".".join(p[-3:]), two) if two in prior.suffixes else (two, p[-1])

    def summed(keys):
        out = collections.defaultdict(lambda: [0, 0])
        for h, (n, b) in hosts.items():
            out[keys(h)][0] += n
            out[keys(h)][1] += b
        return out

    total = sum(n for n, _ in hosts.values()) + 1
    mean = (sum(b for _, b in hosts.values()) + 0.5) / total
    suffixes = level({g: (n, b, mean, total) for g, (n, b) in summed(lambda h: above(h)[1]).items()})
    domains = level({g: (n, b, *suffixes[g[1]]) for g, (n, b) in summed(above).items()})
    shares = level({h: (n, b, *domains[above(h)]) for h, (n, b) in hosts.items()})
    return {h: m - prior.z * math.sqrt(m * (1 - m) / (k + 1)) for h, (m, k) in shares.items()}


def test_rules_hosts_and_paths(spark):
    df = spark.createDataFrame([(i, u[0], "x", 1, "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, n long, key string")
    none = spark.createDataFrame([], "key long, bad boolean")
    got = {r.page_id: r for r in url_filter.filter_urls(df, none, F.lit(None).cast("long"), RULES).collect()}
    assert len(got) == len(URLS)
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == ("block" if rule in ("net/", "example.com/de/") else "allow")
    assert url_filter.filter_urls(df.limit(0), none, F.lit(None).cast("long"), RULES).count() == 0


def test_longest_rule_wins_whatever_the_order():
    from itertools import permutations

    for rules in permutations(RULES):
        assert str(url_filter.matching_rule(F.lit("a"), F.lit("b"), list(rules))) == str(url_filter.matching_rule(F.lit("a"), F.lit("b"), RULES))


def test_reputation(spark):
    """Hosts with records of their own, hosts that a bad domain convicts, hosts of few pages that stay, a host with a third of all pages."""
    rnd = random.Random(2)
    urls, bad = [], {}
    for h, pages, share in (("big.site.com", 900, 0.1), ("evil.com", 200, 0.9), ("a.spam.co.uk", 60, 0.8), ("b.spam.co.uk", 60, 0.9), ("new.spam.co.uk", 1, 0), ("one.org", 1, 1), ("fair.org", 300, 0.05), ("www.fair.org", 40, 0.1), ("odd", 3, 0.5)):
        for _ in range(pages):
            urls.append((len(urls), f"http://{h}/p"))
            if rnd.random() < 0.7:
                bad[urls[-1][0]] = rnd.random() < share
    urls += [(5, urls[5][1])] * 2 + [(None, "http://evil.com/q")]  # repeated and null keys
    df = spark.createDataFrame(urls, "page_id long, url string")
    marks = [(k, v) for k, v in bad.items()] + [(7, None), (None, True), (urls[3][0], False)]
    outcomes = spark.createDataFrame(marks, "key long, bad boolean")
    for prior in (Reputation(), Reputation(limit=0.6, z=1.0)):
        rows = url_filter.filter_urls(df, outcomes, F.col("page_id"), [], prior=prior).collect()
        hosts = collections.defaultdict(lambda: [0, 0])
        for i, u in urls:
            h = hosts[u[7:].split("/")[0]]
            known = bad.get(i, False if i == 3 else None) if i is not None else None
            h[0] += known is not None
            h[1] += bool(known)
        want = brute_shares(hosts, prior)
        assert len(rows) == len(urls)
        for r in rows:
            assert (r.n_labelled, r.n_bad) == tuple(hosts[r.host]) and r.bound == pytest.approx(want[r.host], abs=1e-9)
            assert r.verdict == ("block" if want[r.host] > prior.limit else "allow")
    verdicts = {r.host: r.verdict for r in url_filter.filter_urls(df, outcomes, F.col("page_id"), []).collect()}
    assert verdicts["evil.com"] == verdicts["a.spam.co.uk"] == "block" and verdicts["big.site.com"] == verdicts["fair.org"] == verdicts["one.org"] == "allow"


def brute_features(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_draw(docs, target):
    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(brute_features(x)[1])
    for x in target:
        t.update(brute_features(x)[1])
    of_s, of_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for i, x in docs:
        n, f = brute_features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * of_s / ((s[b] + 1) * of_t))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    may = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = {id(r): k for k, r in enumerate(may[: 5 * len(may) // 100], 1)}
    return sorted([(str(r[0]), *r[1:4], ranks.get(id(r))) for r in out], key=str)


def test_resampling(spark, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 300)
    rnd = random.Random(9)
    words = ["Alpha", "béta", "g4", "x", "ZÉ", "delta" * 30]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice(" -,\n_") for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(300)] + [(300, None), (301, ""), (302, "one"), (303, "one two"), (304, "--"), (305, text(5000)), (None, text(30)), (306, "w" * 5000)]
    docs += [(7, docs[7][1])] * 3
    target = [text(40) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in docs], "doc_id long, text string, id long, bucket string, rank long, place long").repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, aim)
    assert sorted([(str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()], key=str) == brute_draw(docs, target)
    assert importance.resample(df.limit(0), aim).count() == 0
    assert importance.resample(df, aim.limit(0)).count() == len(docs)


def test_ring_states_do_not_depend_on_slices():
    words = [f"w{i}".encode() for i in range(20)]
    for cuts in ([0, 20], [0, 1, 2, 3, 20], [0, 5, 5, 11, 20]):
        ring = importance.CrcRing(4)
        found = sorted(x for a, b in zip(cuts, cuts[1:]) for level in ring.feed(words[a:b]) for x in level)
        assert found == sorted(zlib.crc32(b" ".join(words[i : i + k])) for k in range(1, 5) for i in range(20 - k + 1))
