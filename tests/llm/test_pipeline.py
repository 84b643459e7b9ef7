"""The pipeline's stages, each on what the one before kept, against brute force."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from test_ops_small import WORD, assert_gapless, brute_groups, brute_masks, brute_pieces


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(10_001, None, "en", "src0", None), (10_002, "", None, None, 0), (None, "le petit mot", "fr", None, 12)], docs.schema)
    docs, out = docs.unionByName(odd), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, small).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert 4 <= len(stages) <= 5
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_language_id_drops_what_is_in_no_language(stages):
    before, after = stages[0]
    assert set(texts(before)) - set(texts(after)) == {10_001, 10_002}


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    rows = {k: v for k, v in texts(before).items() if k is not None}
    want = {k for k, (_, c) in brute_groups(rows, 5).items() if k == c}
    assert set(texts(after)) == want | ({None} & set(texts(before)))


def test_passages_are_cut(stages):
    before, after = stages[2]
    got, rows = texts(after), {k: v for k, v in texts(before).items() if k is not None}
    masks = brute_masks(rows)
    for k, t in rows.items():
        b = np.frombuffer(t.encode(), np.uint8)
        if len(t) == len(b):  # no character of several bytes at a cut
            assert got[k].encode() == b[~masks[k]].tobytes()


def test_mix_repeats_whole_documents(stages):
    before, after = stages[3]
    have, got = texts(before), collections.Counter((r.doc_id, r.text) for r in after.collect())
    assert all(have[k] == t and n <= 3 for (k, t), n in got.items())
    total = sum(len(WORD.findall(t or "")) for t in have.values())
    assert abs(sum(n * len(WORD.findall(t or "")) for (_, t), n in got.items()) - total) <= 0.1 * total


def test_all_that_is_mixed_is_packed(stages):
    before, after = stages[4]
    rows = after.collect()
    pieces = brute_pieces(texts(before))
    times = collections.Counter(r.doc_id for r in before.collect())
    assert collections.Counter((r.doc_id, r.piece) for r in rows) == {(k, p): times[k] for k, p in pieces}
    assert_gapless(rows)


ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k):
    return " ".join(f"w{k}x{i}" for i in range(60))


def test_texts_that_share_an_id_stay_apart(spark, small):
    rows = [(5, 1, "a"), (5, 2, "b"), (5, 1, "a"), (5, 1, "c"), (3, 1, "a"), (7, 2, "a"), (8, 3, "a"), (9, 4, "a"), (9, 5, "a"), (None, 6, "a"), (None, 6, "a")]
    docs = spark.createDataFrame([(i, prose(k), "en", s, None) for i, k, s in rows], ROWS).repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, small).collect())
    want = [(3, 1), (5, 2), (8, 3), (9, 4), (9, 5), (None, 6), (None, 6)]
    assert got == collections.Counter((i, prose(k)) for i, k in want)


def test_mix_keeps_rows_of_equal_id_and_size_by_source(spark, small):
    rows = [(i, f"{s} {k} word", "en", s, None) for i, k, s in [(None, 1, "a"), (None, 1, "b"), (None, 2, "b"), (None, 1, None), (4, 1, "a"), (4, 1, "b")]]
    docs = spark.createDataFrame(rows, ROWS).repartition(3)
    got = collections.Counter((r.doc_id, r.source, r.text) for r in corpus_pipeline.mix(spark, docs, small).collect())
    assert all(n <= 3 for n in got.values())
    have, want = collections.Counter(), collections.Counter()
    for (i, s, _), n in got.items():
        have[i, s] += n
    for r in corpus_pipeline.mixing.mix_sources(docs).collect():
        want[r.doc_id, r.source] += r.copies
    assert have == +want and {s for _, s in have} == {"a", "b", None}


def test_stages_take_odd_tables(spark, small):
    """Columns whose names the stages use themselves, null and repeated ids in two sources, and an empty table, through the whole chain."""
    names = "id size row copies h k group component number turn part draw used text_a html lo hi".split()
    schema = ROWS + "".join(f", {n} string" for n in names)
    rows = [(i, prose(k), "en", s, None, *names) for i, k, s in [(None, 1, "a"), (None, 1, "b"), (1, 2, "a"), (1, 2, "a"), (1, 3, "b"), (2, 2, None), (4, 5, "a")]]
    rows += [(None, "", "en", "a", 0, *names), (6, None, None, None, None, *names)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        some = not docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, small)
            if name != "packing":
                assert out.dtypes == docs.dtypes
                docs = spark.createDataFrame(out.collect(), docs.schema)
                assert all([r[n] for n in names] == names for r in docs.collect())
            else:
                assert (out.count() > 0) == some


def test_mix_takes_the_rows_that_it_counts(spark, small):
    rows = [(None, f"{a} {b} {c}", "en", s, None) for a in "xyz" for b in "uvw" for c in "rst" for s in ("a", "b")]
    docs = spark.createDataFrame(rows, ROWS).repartition(4)
    got = collections.Counter((r.source, r.text) for r in corpus_pipeline.mix(spark, docs, small).collect())
    plan = collections.Counter()
    for r in corpus_pipeline.mixing.mix_sources(docs).collect():
        plan[r.source] += r.copies
    have = collections.Counter()
    for (s, _), n in got.items():
        assert n <= 3
        have[s] += n
    assert have == plan
