"""Each corpus operator against a brute-force version, on small fixtures with nulls, empties, repeats, long texts and extra columns."""

import collections
import concurrent.futures
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from halyard.llm import html_extract, language_id, media, minhash, mixing, nbsvm, packing, quality_rules, registry, sharding, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, salt string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=160):
    rnd = random.Random(seed)
    words = ["alpha", "be", "gamma", "délta", "eps", "zeta", "Eta", "thêta", "iota"]
    passage = " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(40))
    rows = []
    for i in range(n):
        t = " ".join(rnd.choice(words) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 80)))
        if i % 4 == 0:
            a, b = sorted((rnd.randint(0, len(passage)), rnd.randint(0, len(passage))))
            t += " " + passage[a:b] + "\nline two\nline two\n" + t[:40]
        if i % 10 == 7:
            t = rows[i - 3][1] or ""
        if i % 10 == 9:
            w = (rows[i - 2][1] or "").split(" ")
            w[len(w) // 2 :] = ["changed", *w[len(w) // 2 + 1 :]]
            t = " ".join(w)
        t = {11: None, 12: "", 13: " \n ", 14: "one two", 15: "x " * 3000, 16: "ONE two"}.get(i, t)
        rows.append((i, t, None if i % 9 == 0 else "en", None if i % 8 == 0 else f"s{i % 3}", None, 1, 2, "x"))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts():
    return {r[0]: r[1] for r in corpus()}


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def test_quality_rules(docs, empty):
    got = quality_rules.repetition_quality(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert tuple(r)[1:7] == brute_quality(texts()[r.doc_id])
        assert not (r.base_failed and r.kept)
    assert quality_rules.repetition_quality(empty).count() == 0


def components(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_groups(rows, size):
    sets = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(linked, sets)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, empty, size):
    got = minhash.near_duplicates(docs, params=minhash.NearDupParams(shingle=size)).collect()
    want = brute_groups(texts(), size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_chain(spark):
    """Neighbours are linked, ends are not: the chain is one component only if no link is lost."""
    words = [f"w{i}" for i in range(400)]
    rows = {i: " ".join(words[8 * i : 8 * i + 120]) for i in range(20)} | {100 + i: " ".join(words[:60] + [f"x{i}_{k}" for k in range(20)]) for i in range(30)}
    got = minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), params=minhash.NearDupParams(shingle=4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, 4)


def test_components(spark, tmp_path):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 50)]
    ids = {x for e in edges for x in e}
    want = {i: c for i, c in components(edges, ids).items() if i != c}
    scratch = minhash.Scratch(spark, "t")
    got = minhash.connected_components(spark.createDataFrame(edges, "a long, b long"), scratch)
    assert {r.id: r.component for r in got.collect()} == want


def brute_pieces(rows, capacity=1024):
    lib = packing.encoder(packing.default_vocab()).library
    out = {}
    for i, t in rows.items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[i, p] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    return out


def assert_gapless(rows, capacity=1024):
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing(docs, empty):
    got = packing.pack(docs, rows_per_rank_group=50).collect()
    want = brute_pieces(texts())
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    n = assert_gapless(got)
    assert n <= 1.02 * -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(empty).count() == 0


def test_packing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c")] * 300 + [(None, "x")] * 5, "doc_id long, text string")
    got = packing.pack(df).collect()
    assert len(got) == 305
    assert_gapless(got)


def test_packing_spreads_equal_rows(spark, monkeypatch):
    """A flood of null ids with empty texts is ranked in many groups, not in one."""
    sizes = []
    save = packing.Scratch.save
    monkeypatch.setattr(packing.Scratch, "save", lambda self, df, name: sizes.append(save(self, df, name)) or sizes[-1])
    got = packing.pack(spark.createDataFrame([(None, "")] * 3000, "doc_id long, text string").repartition(5), rows_per_rank_group=100).collect()
    assert_gapless(got)
    pieces = sizes[0].withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "number"), F.lit(30)))
    assert pieces.groupBy("salt").count().agg(F.max("count")).first()[0] < 200


def test_tokens_equal_the_library(spark, small):
    enc = packing.encoder(packing.default_vocab())
    odd = ["a  b", "a \n b", " lead", "trail ", "tab\t x", "it's don't  'll", "é ñ x", "a b", "x\x1cy z", "<|endoftext|> a", "日本 語", "1 2  3", "\n\n", "a\r\n b"]
    for t in odd + pq.read_table(f"{small}/documents.parquet").column("text").to_pylist():
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.library.encode(t, add_special_tokens=False).ids


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {bins.index(b) for b in bins}:
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_dominance_reduction_keeps_the_optimum():
    rng = np.random.default_rng(0)
    for _ in range(300):
        c = int(rng.integers(5, 30))
        items = rng.integers(1, c + 1, int(rng.integers(1, 10)))
        fixed, left = packing.dominance_reduction(np.bincount(items, minlength=c + 1), c)
        rest = np.repeat(np.arange(c + 1), left).tolist()
        assert sum(m for _, m in fixed) + (fewest(rest, c) if rest else 0) == fewest(items.tolist(), c)


def test_passages(docs, empty):
    for most in (4096, 12, 2):
        scratch = suffix_dedup.Scratch(docs.sparkSession, "t")
        src, ranges = suffix_dedup.earlier_passages(docs, "doc_id", "text", scratch, most=most)
        masks = {r.rid: r.cut for r in ranges.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("cut")).collect()}
        got = {r.id: masks.get(r.rid, []) for r in src.collect()}
        want = brute_masks(texts())
        for i, t in texts().items():
            m = np.zeros(len((t or "").encode()), bool)
            for s, e in got[i]:
                m[s:e] = True
            assert (m == want[i]).all()
    out = suffix_dedup.repeated_passages(docs).collect()
    for r in out:
        b, m = np.frombuffer((texts()[r.doc_id] or "").encode(), np.uint8), brute_masks(texts())[r.doc_id]
        assert (r.n_bytes, r.n_removed) == (len(b), int(m.sum())) and r.kept_sha256 == hashlib.sha256(b[~m].tobytes()).hexdigest()
        assert r.n_spans == int((np.diff(np.r_[0, m.astype(int)]) == 1).sum())
    assert suffix_dedup.repeated_passages(empty).count() == 0


def brute_masks(rows):
    first, out = {}, {}
    for i, t in sorted(rows.items()):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in rows.items():
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                m[p : p + 50] = True
        out[i] = m
    return out


def test_maximal_repeats_have_all_occurrences():
    rnd = random.Random(4)
    base = bytes(rnd.choice(b"ab") for _ in range(300))
    strings = [base[rnd.randint(0, 100) :][: rnd.randint(55, 84)] for _ in range(40)]
    array = suffix_dedup.EnhancedSuffixArray(strings)
    first, last, length = array.maximal_repeats()
    groups = {}
    for a, b, n in zip(first, last, length, strict=True):
        s = strings[array.string[a]][array.offset[a] :][:n]
        groups[s] = {(int(array.string[k]), int(array.offset[k])) for k in range(a, b + 1)}
    for s, places in groups.items():
        assert places == {(i, p) for i, t in enumerate(strings) for p in range(len(t) - len(s) + 1) if t[p : p + len(s)] == s}
        lefts = {strings[i][p - 1] if p else -1 - i for i, p in places}
        assert len(lefts) > 1
    windows = collections.Counter(t[p : p + 50] for t in strings for p in range(len(t) - 49))
    for w, n in windows.items():
        assert n < 2 or any(w in s for s in groups)


def test_cut_texts_stay_text(spark):
    t = "é" * 60
    df = spark.createDataFrame([(1, "x" + t, "k"), (2, t + "y", "k"), (None, t, "k"), (3, None, "k")], "doc_id long, text string, row string")
    got = {r.doc_id: (r.text, r.row) for r in suffix_dedup.drop_repeated_passages(df).collect()}
    assert got == {1: ("x" + t, "k"), 2: ("y", "k"), None: (t, "k"), 3: (None, "k")}


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(corpus())
    sizes = collections.Counter()
    for i, t, _, s, *_ in corpus():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        capped = {s for s in open_ if left * weight[s] / w >= 3 * sizes[s]}
        for s in capped or open_:
            target[s] = 3 * sizes[s] if capped else left * weight[s] / w
        open_ -= capped or set(open_)
    source = {r[0]: r[3] for r in corpus()}
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.size == len(WORD.findall(texts()[r.doc_id] or "")) and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(r.size for r in got if source[r.doc_id] == s)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "s")] * 10 + [(2, "c", None)] * 4, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == 14 and len({(r.doc_id, r.row) for r in got}) == 14
    assert all(r.taken <= 3 * r.size for r in got)


def test_language_id(spark, small, empty):
    d = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit_language_filter(d.where(~language_id.held_out("doc_id")))
    got = language_id.identify_languages(d, model).join(d.select("doc_id", "lang"), "doc_id").where(language_id.held_out("doc_id")).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... ²"), (4, "the")], "doc_id long, text string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(odd, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] in model.languages
    assert [r.doc_id for r in language_id.accept_languages(odd, model).collect()] == [4]
    assert language_id.fit_language_filter(empty).languages == ()
    assert language_id.identify_languages(odd, language_id.fit_language_filter(empty)).where("lang_pred <> 'und'").count() == 0


def test_language_filter_holds_all_of_its_ngrams():
    rng = np.random.default_rng(2)
    texts_ = ["".join(rng.choice(list("abcdefgh "), 200)) for _ in range(4)]
    masks = np.zeros((1 << 12, 1), np.uint8)
    for k, t in enumerate(texts_):
        for s in language_id.slots_of(language_id.byte_ngrams([t], 5)[0], 3, 12):
            masks[s, 0] |= 1 << k
    f = language_id.LanguageFilter(("a", "b", "c", "d"), masks, 5, 3)
    counts, total = f.counts(texts_)
    assert (np.diag(counts) == total).all() and f.predict(texts_, f.false_rates())[0] == ["a", "b", "c", "d"]


def test_classifier(spark, small, empty):
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = nbsvm.train_quality(d, lab)
    got = nbsvm.score_quality(d, model).join(lab, "doc_id").where(nbsvm.held_out("doc_id")).collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in nbsvm.score_quality(odd, model).collect()}
    assert s[1] == s[2] and all(0 <= x <= 1 for x in s.values())
    none = nbsvm.train_quality(d, lab.limit(0))
    assert {r.score for r in nbsvm.score_quality(odd, none).collect()} == {0.5}
    assert nbsvm.score_quality(empty, none).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(20, 6, replace=False)) for _ in range(60)]
    y = np.array([int(r.sum() > 57) for r in rows])
    ratios = rng.normal(1, 0.3, 20)
    w, b = nbsvm.dual_coordinate_descent(rows, y, ratios, (1.0, 1.0), epochs=3000, tol=1e-9)

    def primal(w, b):
        m = [(1 if t else -1) * (float(w[x] @ (ratios[x] / np.linalg.norm(ratios[x]))) + b) for x, t in zip(rows, y, strict=True)]
        return 0.5 * (w @ w + b * b) + sum(max(0, 1 - z) for z in m)

    best = primal(w, b)
    for _ in range(300):
        assert primal(w + rng.normal(0, 0.05, 20), b + rng.normal(0, 0.05)) >= best - 1e-6


def test_media(docs, empty):
    got = media.document_media(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        b = (texts()[r.doc_id] or "").encode()
        payload = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        png = media.encode_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(b), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest())
        assert media.decode_png(png).tobytes() == payload
    assert media.document_media(empty).count() == 0


def test_sequences_keep_positions_and_captions():
    html = '<p>one</p><figure><img src="media:sha256/aa"><figcaption>cap &amp; a</figcaption></figure><p>two<img alt="b" src="media:sha256/bb"> three</p><script>x<p></script>'
    got = [(x["pos"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in media.parse_sequence(html)]
    assert got == [(0, "text", "one", None), (1, "media", "aa", "cap & a"), (2, "text", "two", None), (3, "media", "bb", "b"), (4, "text", "three", None)]
    assert media.parse_sequence(None) == []


def test_unresolved_references_keep_their_place(spark):
    pages = spark.createDataFrame([(1, '<img src="media:sha256/no" alt="c">'), (2, None)], "page_id long, html string")
    feats = media.media_features(spark.createDataFrame([], "digest string, media binary"))
    got = media.resolve_media(media.interleaved_sequences(pages, "page_id", "html"), feats, "page_id").collect()
    assert [(r.page_id, r.pos, r.caption, r.feature) for r in got] == [(1, 0, "c", None)]


def test_language_of_short_texts_and_unlearned_scripts(spark):
    langs = {"de": "der Hund und die Katze sind da", "en": "the dog and a cat are in of re", "fr": "le chien et la souris à été de"}
    train = spark.createDataFrame([(i, t, x) for x, t in langs.items() for i in range(5)], "doc_id long, text string, lang string")
    model = language_id.fit_language_filter(train)
    odd = [(1, "Re."), (2, "A."), (3, "été"), (4, "щука вышла на берег реки и долго смотрела на город " * 40), (5, "魚は水の中を泳ぐ"), (6, "the cat"), (7, "of")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(docs, model).collect()}
    assert {k: got[k][0] for k in (1, 2, 3, 6, 7)} == {1: "en", 2: "en", 3: "fr", 6: "en", 7: "en"} and all(got[k][1] > 0 for k in (1, 2, 3, 6, 7))
    assert got[4] == got[5] == ("de", 0.0)
    assert sorted(r.doc_id for r in language_id.accept_languages(docs, model).collect()) == [1, 2, 3, 6, 7]


def test_html(spark, small):
    got = html_extract.extract_main_text(spark.read.parquet(f"{small}/pages.parquet")).collect()
    html = dict(zip(*(pq.read_table(f"{small}/pages.parquet").column(c).to_pylist() for c in ("page_id", "html")), strict=True))
    from html import unescape

    for r in got:
        a = html[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = re.sub(r"<[^>]*>", " ", re.sub(r"</?(p|h1)>", "\n\n", a)).split("\n\n")
        assert r.text == "\n".join(b for b in (" ".join(unescape(x).split()) for x in blocks) if b) and r.n_chars == len(r.text)


def test_html_layouts(spark):
    body = "".join(f"<p>Sentence number {i} of the story goes on and on.</p>" for i in range(6))
    want = "\n".join(f"Sentence number {i} of the story goes on and on." for i in range(6))
    page = lambda main: f'<html><head><title>t</title></head><body><header><h1>Site</h1></header><div id="menu"><a href="/">Home</a></div><div class="post-12">{main}</div><aside>side</aside><div class="comments"><p>A reader comments here.</p></div><form>mail <input></form><footer>foot</footer></body></html>'
    rows = [(i, "http://h.example/x", page(body)) for i in range(5)]
    rows += [(5, "http://h.example/y", page("<p>Short.</p>")), (6, None, None), (7, "nonsense", ""), (8, "http://h.example/z", "<p>loose &lt;text&gt;</p><p>cut <b")]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [want] * 5 and got[5] == "Short." and got[6] == got[7] == "" and got[8] == "loose <text>\ncut"


def test_html_keeps_whole_articles(spark):
    long = lambda k: f"Part {k} has a body that far outweighs the heading and the lead of the page. " * 6
    lines = lambda *x: "\n".join(y.strip() for y in x)
    page = lambda main: f'<html><body><nav><a href="/">Home</a></nav>{main}<div class="x9"><ul><li><a href="/1">One other</a></li></ul></div><footer>foot</footer></body></html>'
    head = "<h1>Heading</h1><p>The lead.</p>"
    parts = [f"<section><p>{long(k)}</p></section>" for k in range(3)]
    want = lines("Heading", "The lead.", *(long(k) for k in range(3)))
    nested = [
        f"<article>{head}{''.join(parts)}</article>",
        f'<article>{head}<div class="text"><p>{long(0)}</p><p>{long(1)}</p><p>{long(2)}</p></div></article>',
        f"<article>{head}<ul>{''.join(f'<li>{long(k)}</li>' for k in range(3))}</ul></article>",
        f"<main><h1>Heading</h1><article><p>The lead.</p>{''.join(parts)}</article></main>",
        f'<div class="q1">{head}<div class="ad">Buy.</div>{"".join(parts)}</div>',
        f'<div class="story"><div><h1>Heading</h1></div><nav>jump</nav><div><p>The lead.</p></div>{"".join(parts)}</div>',
    ]
    rows = [(10 * k + i, f"http://h{k}.example/{i}", page(m)) for k, m in enumerate(nested) for i in range(3)]
    # a host with two templates: on its pages of the second one, the first one's container holds a teaser only
    first = f'<div class="box"><p>{long(0)}</p><p>{long(1)}</p></div>'
    second = f'<div class="box"><p>Teaser.</p></div><div class="z"><p>{long(2)}</p></div>'
    rows += [(100 + i, "http://t.example/x", page(first)) for i in range(5)] + [(110, "http://t.example/y", page(second))]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(len(nested)):
        assert [got[10 * k + i] for i in range(3)] == [want] * 3, nested[k]
    assert got[100] == lines(long(0), long(1)) and got[110] == lines("Teaser.", long(2))


def test_sharding(spark, docs, empty, tmp_path):
    tiering = sharding.Tiering(target_bytes=12_000, base_bytes=1_000, least_run=3, arrival_rows=20)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), tiering)
    store.append(docs)
    before = store.version()
    old = {r.path for r in store.manifest(before).collect()}
    assert len(old) >= 6
    store.append(docs.where("doc_id < 40"))
    store.append(empty)
    after = sharding.compact_fully(store)
    assert after > before and store.compact() is None
    live = store.manifest().collect()
    assert sum(r.rows for r in live) == len(corpus()) + 40 and len(live) < len(old)
    assert all(r.bytes <= 2 * tiering.target_bytes for r in live)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(store.read()) == rows(docs.union(docs.where("doc_id < 40"))) and rows(store.read(before)) == rows(docs)
    schema = docs.schema
    with pytest.raises(sharding.VersionConflict):
        store._commit(before, store.manifest(before), schema)
    assert store.version() == after
    store.vacuum()
    assert rows(store.read()) == rows(docs.union(docs.where("doc_id < 40")))
    none = sharding.ShardStore(spark, str(tmp_path / "n"), tiering)
    none.append(empty)
    assert none.read().count() == 0 and none.compact() is None


def test_queries_are_named_by_number():
    assert [re.match(r"op(\d+)_", n)[1] for n in registry.queries()] == [str(n) for n in range(1, 14)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_sql(spark, small, name):
    from oracle import assert_same, connect

    assert_same(registry.queries()[name](spark, small), connect(small), registry.oracle_sql()[name])


def test_near_duplicates_that_share_one_shingle(spark):
    """2,000 open documents of as many components have one shingle in common: they are not compared with each other."""
    rows = {}
    for i in range(1000):
        own = [f"p{i}_{k}" for k in range(40)]
        rows[2 * i] = " ".join(["all", "of", "us", "say", *own])
        rows[2 * i + 1] = " ".join(["all", "of", "us", "say", *own[:28], *(f"q{i}_{k}" for k in range(12))])  # similar, but not enough
    rows[5000] = rows[7] + " end"
    got = minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), params=minhash.NearDupParams(shingle=4)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in rows} | {5000: 7}


def test_rows_without_near_duplicates(spark):
    base = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(5, base, "a", 1), (5, base, "a", 1), (5, base, "b", 2), (5, other, "a", 3), (7, base + " end", "a", 4), (8, other, "c", 5), (None, base, "a", 6), (None, base, "a", 6), (9, "", "a", 7), (9, "", "a", 7), (3, None, "a", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, row long")
    got = sorted(map(tuple, minhash.drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, base, "a", 1), (5, other, "a", 3), (None, base, "a", 6), (None, base, "a", 6), (9, "", "a", 7), (9, "", "a", 7), (3, None, "a", 8)], key=str)
    assert minhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_shards_after_a_torn_commit(spark, docs, tmp_path):
    """A writer that dies while it commits leaves nothing that is read, and nothing that stands in the way of the next one."""
    store = sharding.ShardStore(spark, str(tmp_path / "t"))
    store.append(docs)
    (tmp_path / "t" / "versions" / ".dead.tmp").write_bytes(b'{"manif')
    store.spark.range(3).write.parquet(f"{store.root}/shards/dead")
    assert store.version() == 1 and store.read().count() == len(corpus())
    store.append(docs.limit(5))
    assert store.version() == 2 and store.read().count() == len(corpus()) + 5
    assert store.vacuum() == 0 and store.vacuum(grace_seconds=-60) >= 1
    assert not list((tmp_path / "t" / "versions").glob(".dead.tmp")) and store.read().count() == len(corpus()) + 5


def test_shards_of_two_writers(spark, docs, tmp_path):
    """Appends and a compaction at the same time: no arrival is lost."""
    tiering = sharding.Tiering(target_bytes=12_000, base_bytes=1_000, least_run=3, arrival_rows=20)
    root = str(tmp_path / "c")
    sharding.ShardStore(spark, root, tiering).append(docs)
    works = [lambda k=k: sharding.ShardStore(spark, root, tiering).append(docs.where(f"doc_id % 3 = {k}")) for k in range(3)]
    works.append(lambda: sharding.ShardStore(spark, root, tiering).compact())
    with concurrent.futures.ThreadPoolExecutor(4) as pool:
        for done in [pool.submit(w) for w in works]:
            done.result()
    store = sharding.ShardStore(spark, root, tiering)
    sharding.compact_fully(store)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(store.read()) == rows(docs.union(docs))
    store.append(docs.select("doc_id", F.lit(1.5).alias("extra")))
    assert store.read().where("extra = 1.5 and text is null").count() == len(corpus()) and store.read().where("extra is null").count() == 2 * len(corpus())
    with pytest.raises(ValueError):
        store.append(docs.select(F.lit("x").alias("doc_id")))


def test_passages_around_one_frequent_anchor(spark):
    """One phrase of 60 bytes, and one of 49, stand in 5,200 documents, each time among other words."""
    rnd = random.Random(8)
    odd = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrase, short = odd(60), odd(49)
    rows = {i: f"{odd(40)}{phrase if i % 2 else short}{odd(40)}" for i in range(5200)}
    rows[5201] = odd(10) + rows[17][20:90] + odd(10)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(6)
    want = brute_masks(rows)
    for most in (4096, 600):
        src, ranges = suffix_dedup.earlier_passages(df, "doc_id", "text", suffix_dedup.Scratch(spark, "t"), most=most)
        got = {i: np.zeros(len(t), bool) for i, t in rows.items()}
        for r in ranges.join(src.select("rid", "id"), "rid").collect():
            got[r.id][r.start : r.end] = True
        assert all((got[i] == want[i]).all() for i in rows)
    marks = suffix_dedup._frequent_anchors(df.select("text"), 600, 1 << 20)
    assert marks.packed.any()
    everywhere = [suffix_dedup._frequent_anchors(df.repartition(n).select("text"), 600, 1 << 20).packed.tobytes() for n in (1, 6)]
    assert everywhere[0] == everywhere[1] == marks.packed.tobytes()


def brute_windows(rows):
    """Masks by sets of windows: few different ones in repetitive texts."""
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        m, own = np.zeros(len(t) + 1, int), set()
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            own.add(w)
            if w in seen:
                m[p] += 1
                m[p + 50] -= 1
        seen |= own
        out[i] = np.cumsum(m)[:-1] > 0
    return out


@pytest.mark.parametrize("most", [4096, 3])
def test_repetitive_passages(spark, most):
    """Runs of one character, short periods, spaces, a repeated line: few records whatever their length, and equal to brute force."""
    odd = random.Random(5)
    noise = lambda n: "".join(odd.choice("klmnopqrst") for _ in range(n))
    line = noise(70) + "\n"
    rows = {1: "x" + "A" * 30_000 + "y" + "abc" * 5_000 + " " * 9_000 + line * 200, 2: noise(60) + "A" * 200 + noise(5) + "abc" * 60 + " " * 70 + noise(9), 3: "A" * 49 + "b" + " " * 5_000 + line * 3, 4: ("=" * 30 + noise(3)) * 40 + "A" * 80}
    rows |= {5 + i: noise(20) + " " * (50 + 7 * i) + noise(20) for i in range(30)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    scratch = suffix_dedup.Scratch(spark, "t")
    src, ranges = suffix_dedup.earlier_passages(df, "doc_id", "text", scratch, most=most)
    got = {i: np.zeros(len(t), bool) for i, t in rows.items()}
    for r in ranges.join(src.select("rid", "id"), "rid").collect():
        got[r.id][r.start : r.end] = True
    want = brute_windows(rows)
    assert all((got[i] == want[i]).all() for i in rows)
    assert spark.read.parquet(scratch.path("contexts")).count() < (5_000 if most == 4096 else 10_000)  # of some 60,000 places


def test_shards_where_the_scan_can_not_be_set(spark, docs, tmp_path, monkeypatch):
    """With a session that holds small scan tasks, merges end and make files of the target size all the same."""
    tiering = sharding.Tiering(target_bytes=12_000, base_bytes=1_000, least_run=3, arrival_rows=10)
    store = sharding.ShardStore(spark, str(tmp_path / "h"), tiering)
    held = type(spark.conf).set
    monkeypatch.setattr(type(spark.conf), "set", lambda self, key, value: held(self, key, "2000" if key.endswith("maxPartitionBytes") else value))
    store.append(docs)
    before = store.manifest().count()
    sharding.compact_fully(store)
    live = store.manifest().collect()
    assert len(live) < before / 3 and store.compact() is None
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))


def brute_features(text, bits):
    """The classifier's features of a text, one at a time."""
    k, full = int(nbsvm._K), (1 << 64) - 1
    out = set()
    for n in (2, 3, 4):
        for i in range(len(text) - n + 1):
            code = int.from_bytes(text[i : i + n], "little")
            out.add(((code + n) * k & full) >> (64 - bits))
    words = text.split()
    codes = [nbsvm._WORD_CODES[w] for w in words]
    mix = lambda x: int(nbsvm.mix64(np.array([x & full], np.uint64))[0])
    pairs = [mix(3 * a + b) for a, b in itertools.pairwise(codes)]
    doubled = int(10 * np.mean([a == b for a, b in itertools.pairwise(words)])) if pairs else 0
    fresh = int(10 * len(set(pairs)) / len(pairs)) if pairs else 10
    marks = [mix(x) for x in (*range(1, doubled + 1), *range(101 + fresh, 111))] if words else []
    return out | {x >> (64 - bits) for x in (*codes, *pairs, *marks)}


def test_classifier_features_ratios_and_scores_equal_brute_force():
    rnd = random.Random(5)
    texts_ = [" ".join(rnd.choice(["ab", "cde", "f", "é", "ab"]) for _ in range(rnd.randint(1, 9))).encode() for _ in range(30)] + [b" ", b"x", b"word " * 3000]
    bits = 12
    rows = [nbsvm.features_of(t, bits) for t in texts_]
    for t, x in zip(texts_, rows, strict=True):
        assert x.tolist() == sorted(brute_features(t, bits))
    y = np.array([len(t) % 2 for t in texts_])
    ratios = nbsvm.log_count_ratios(rows, y, bits)
    for f in range(0, 1 << bits, 37):
        share = [(1 + sum(f in set(x.tolist()) for x, c in zip(rows, y, strict=True) if c == k)) / ((1 << bits) + sum(len(x) for x, c in zip(rows, y, strict=True) if c == k)) for k in (1, 0)]
        assert abs(ratios[f] - np.log(share[0] / share[1])) < 1e-9
    model = nbsvm.fit_nbsvm(rows, y, bits)
    for t, s in zip(texts_, model.scores(texts_), strict=True):
        x = sorted(brute_features(t, bits))
        norm = sum(model.ratios[f] ** 2 for f in x) ** 0.5 or 1.0
        z = model.slope * (sum(model.weights[f] for f in x) / norm + model.bias) + model.offset
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9


def test_classifier_bound_holds_for_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 3 + 1, f"text {i} {'good' if i % 2 else 'bad'}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (6, 1)], "doc_id long, quality int")
    seen = []
    fit = nbsvm.fit_nbsvm
    monkeypatch.setattr(nbsvm, "fit_nbsvm", lambda rows, *a: seen.append(len(rows)) or fit(rows, *a))
    nbsvm.train_quality(docs.union(docs), labels, fit_rows=50)
    assert seen == [50]


def test_language_counts_equal_brute_force(spark):
    """Counts by language and the filters' masks against plain sets; filters may only let more through, at the rate they state."""
    rnd = random.Random(6)
    alphabet = {"aa": "abcde", "bb": "defgh", "cc": "ghijk"}
    rows = [(i, " ".join("".join(rnd.choice(alphabet[lang]) for _ in range(rnd.randint(2, 9))) for _ in range(60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    model = language_id.fit_language_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=16)
    grams = lambda t: [b[i : i + 5] for b in [b" " + t.encode() + b" "] for i in range(len(b) - 4)]
    times = {lang: collections.Counter(g for _, t, x in rows if x == lang for g in grams(t)) for lang in alphabet}
    total = {lang: sum(len(t.encode()) for _, t, x in rows if x == lang) for lang in alphabet}
    rate = lambda g, lang: times[lang][g] / total[lang] if times[lang][g] >= 3 else 0.0
    holds = {lang: {g for g in times[lang] if rate(g, lang) >= 0.3 * max(rate(g, x) for x in alphabet) > 0} for lang in alphabet}
    texts_ = [t for _, t, _ in rows]
    counts, n = model.counts(texts_)
    rates = model.false_rates()
    over = 0
    for k, t in enumerate(texts_):
        assert n[k] == len(grams(t))
        for j, lang in enumerate(model.languages):
            want = sum(g in holds[lang] for g in grams(t))
            assert counts[k, j] >= want
            over += counts[k, j] - want
    assert over <= 3 * rates.max() * n.sum() * 3 + 10
    assert model.predict(texts_, rates)[0] == [x for _, _, x in rows]
