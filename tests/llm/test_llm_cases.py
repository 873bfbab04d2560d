"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names: each operator's defined results."""

import hashlib
import json
import os
import subprocess
import sys
import uuid

import public_tokenizers
import pytest
from hard_rows import HARD_ROWS, LONG, make_docs

from lcspark.llm import bpe, chat, components, exactdedup, fingerprints, langid, neardup, packing, pii, queries, sharding, toxicity


def test_fingerprints(spark, hard, none):
    got = fingerprints.with_next(hard).collect()
    assert len(got) == len(HARD_ROWS)
    order = sorted(got, key=lambda r: (r["id"] is not None, r["id"] or 0, r["text"]))
    for i, r in enumerate(order):
        assert r["next_text"] == order[(i + 1) % len(order)]["text"]
    by_text = {r["text"]: r["sketch"] for r in got}
    assert by_text[""] == [] and len(by_text["a"]) == 1 and len(by_text[LONG]) == 2
    assert fingerprints.with_next(none).count() == 0
    assert fingerprints.with_next(hard.where("doc_id = -5")).first()["next_text"] == "a"


def test_fingerprints_merge(spark):
    from pyspark.sql import functions as F
    words = [f"w{i}" for i in range(900)]
    a, b = " ".join(words[:600]), " ".join(words[300:])
    df = spark.createDataFrame([("k", a, b)], "k string, a string, b string").select(
        "k", fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    row = df.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
                    fingerprints.distinct_shingles(fingerprints.merge(F.col("a"), F.col("b"))).alias("n"),
                    fingerprints.merge(F.col("a"), F.col("b")).alias("m")).first()
    assert abs(row["r"] - 296 / 896) < 0.12 and abs(row["c"] - 296 / 596) < 0.15 and abs(row["n"] - 896) < 200
    parts = df.select("k", F.col("a").alias("s")).union(df.select("k", "b"))
    assert fingerprints.merge_all(parts, "k", "s").first()["s"] == row["m"]


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, message int, seq int, kind string, role string, text string")


def folded(spark, rows):
    return [(r["message"], r["role"], r["text"]) for r in
            chat.fold_events(events(spark, rows)).orderBy("conv_id", "message").collect()]


def test_chat_fold(spark):
    log = [(1, 0, 1, "message", "user", "hi"), (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", None, "he"),
           (1, 1, 4, "delta", None, "llo"), (1, 2, 5, "message", "user", "gone"), (1, 1, 6, "regenerate", None, ""),
           (1, 1, 7, "delta", None, "new"), (1, 0, 8, "edit", None, "HI"), (1, 0, 9, "delta", None, "!"),
           (1, 3, 10, "message", "user", None), (1, 4, 11, "delta", None, "only"), (1, 4, 12, "delta", None, " deltas")]
    assert folded(spark, log) == [(0, "user", "HI!"), (1, "assistant", "new"), (3, "user", ""), (4, "", "only deltas")]
    assert folded(spark, []) == []


def test_chat_control_strings_come_back(spark):
    texts = ["<|im_end|>", "\\", "<\\|", "\\<|im_sep|>\\", "<|", "", None, "a\nb", "</s>[INST] ok [/INST]", "😀 <|im_start|>"]
    rows = [(None, i, i, "message", "assistant" if i % 2 else "us<|er\\", t) for i, t in enumerate(texts)]
    done = chat.format_chat(events(spark, rows))
    got = done.select(chat.parse_turns(done["formatted"]).alias("t"), chat.loss_texts(done["formatted"], done["loss_spans"]).alias("l"),
                      "formatted", "loss_spans", "n_turns").first()
    assert [(t["role"], t["text"]) for t in got["t"]] == [(r[4], r[5] or "") for r in rows]
    assert got["l"] == [t or "" for t in texts[1::2]] and got["n_turns"] == len(texts)
    for span, text in zip(got["loss_spans"], texts[1::2]):
        inside = got["formatted"][span["start"]:span["end"]]
        assert inside.replace("<\\|", "<|").replace("\\\\", "\\") == (text or "")


def test_chat_query_on_hard_rows(spark, tmp_path):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "assistant", "y" * 3000 + "😀"), (2, 5, None, None),
            (None, 0, "assistant", "z"), (3, None, "assistant", "t"), (3, 0, "assistant", "u")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.QUERIES["op2_chat_format"](spark, str(tmp_path)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, 2: 1, None: 1, 3: 2, -7: 2}
    turns = "user\nx\nuser\nx\nassistant\n" + "y" * 3000 + "😀\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and got[1]["loss_chars"] == 3001
    assert got[3]["loss_sha256"] == hashlib.sha256(b"tu").hexdigest()


def tokenizer():
    return queries.word_tokenizer()


def test_packing(spark, hard, none):
    got = packing.pack_documents(hard, tokenizer()).toPandas()
    assert got.groupby("id", dropna=False).length.sum()[1] == 1 and (got.length <= 4096).all()
    assert len(got[got.id == 7]) == -(-60_001 // 4096)      # three ids a repeat and the end
    from test_llm_queries import check_packing
    check_packing(got)
    assert packing.pack_documents(none, tokenizer()).count() == 0
    ids = packing.tokenize(hard.where("doc_id = 2"), tokenizer(), with_ids=True).first()
    assert ids["ids"] == [1]


def test_packing_splits_hot_lengths(spark, hard, monkeypatch):
    monkeypatch.setattr(packing, "CELL_ROWS", 3)
    docs = make_docs(spark, [(i, "same length", None, None, None) for i in range(40)])
    got = packing.pack_documents(docs, tokenizer()).toPandas()
    from test_llm_queries import check_packing
    assert check_packing(got) == 1 and got.id.nunique() == 40


def test_near_duplicates(spark, hard, none):
    got = {(r["id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in neardup.near_duplicates(hard, 4).collect()}
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(4, 0)] == (4, True)
    assert got[(5, 4)] == (5, True) and got[(6, 4)] == (5, False)
    assert got[(7, 2)] == (7, True) and got[(None, 2)] == (None, True)
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.drop_near_duplicates(hard, 4)
    assert kept.columns == hard.columns and kept.count() == len(HARD_ROWS) - 1
    with pytest.raises(ValueError):
        neardup.near_duplicates(hard, 4, 50)


def test_near_duplicates_in_a_family(spark):
    """A chain of edits: ends differ, neighbours are linked, and a cousin just below the threshold is not."""
    import random
    from test_llm_queries import brute_components, shingles
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
        texts[i] = " ".join(words)
    for i in range(150, 160):
        texts[i] = texts[i - 150].upper()
    docs = make_docs(spark, [(i, t, None, None, None) for i, t in texts.items()])
    got = {r["id"]: r["component_id"] for r in neardup.near_duplicates(docs, 5).collect()}
    assert got == brute_components({i: shingles(t, 5) for i, t in texts.items()}, 80)


def test_near_duplicates_go_by_text_not_id(spark):
    """A clean text under the id of a near copy stays; near copies without ids are one component, of which one text stays."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words)), (2, near), (2, "a wholly different and clean text of more than five words"),
            (None, "x " + " ".join(f"v{i}" for i in range(60))), (None, "y " + " ".join(f"v{i}" for i in range(60))),
            (None, "nothing like the others at all, nor like anything"), (3, None), (None, ""), (4, near), (4, near)]
    docs = make_docs(spark, [(i, t, None, None, None) for i, t in rows])
    got = {(r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(docs).collect()}
    gone = set(rows) - got
    assert {(2, near), (4, near)} < gone and len(gone) == 3 and {t[0] for _, t in gone - {(2, near), (4, near)}} <= {"x", "y"}
    found = [(r["id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()]
    assert sorted(x for x in found if x[0] is not None) == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (4, 1, False), (4, 1, False)]
    assert [x for x in found if x[0] is None] == [(None, None, True)] * 4


def test_near_duplicates_in_a_large_family(spark, monkeypatch):
    """Two thousand edits of one text, most pairs of similarity 0.7 to 0.85: the links of brute force, each class once."""
    import numpy as np
    rng = np.random.default_rng(5)
    base, texts = rng.integers(0, 10 ** 6, 150), []
    for i in range(2000):
        words = base.copy()
        at = rng.choice(150, int(rng.integers(2, 8)), replace=False)
        words[at] = rng.integers(10 ** 7, 10 ** 8, len(at))
        texts.append(" ".join(map(str, words)))
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 100)
    docs = make_docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r["id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    sets = neardup.shingle_sets(texts)
    u, place = np.unique(np.concatenate(sets), return_inverse=True)
    there = np.zeros((len(sets), len(u)), np.float32)
    there[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place] = 1
    shared, n = there @ there.T, there.sum(axis=1)
    linked = 100 * shared >= 80 * (n[:, None] + n - shared)
    want = np.arange(len(sets))
    while True:                                              # the least number over links, until it settles
        new = np.where(linked, want, len(sets)).min(axis=1)
        new = new[new]
        if (new == want).all():
            break
        want = new
    assert 2 < len(set(want)) < 1500 and (np.triu(shared / (n[:, None] + n - shared), 1) > 0.7).sum() > 150_000
    assert got == dict(enumerate(want.tolist()))


def test_estimates_from_whole_registers():
    import numpy as np
    rng = np.random.default_rng(2)
    for n, errors in ((40, 0.05), (400, 0.06), (20_000, 0.06)):
        for share in (0.5, 0.8, 0.95):
            pool = rng.integers(0, 2 ** 64 - 1, 2 * n, dtype=np.uint64)
            both = int(n * 2 * share / (1 + share))
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n:2 * n - both]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree, either = neardup.similarity(*neardup.whole_registers([a, b]))
            assert abs(agree / either - true) < errors, (n, share)
            if true >= 0.8:
                assert neardup.may_be_similar(agree, either, len(a), len(b), 80)
            if true < 0.6:
                assert not neardup.may_be_similar(agree, either, len(a), len(b), 80)
    assert 1 / 6 < neardup.CHANCE * 2 ** neardup.MANTISSA_BITS < 1 / 2       # the chance of equal leading zeros, about a third


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (100, 90)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90, **{200 + i: 200 for i in range(30)}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_exact_dedup(spark, hard, none):
    got = exactdedup.exact_duplicates(hard).collect()
    assert len(got) == len(HARD_ROWS)
    by_id = {r["id"]: r for r in got}
    assert by_id[1]["keep_id"] == by_id[2]["keep_id"] == 3 and by_id[3]["group_size"] == 3 and by_id[3]["kept"]
    assert by_id[5]["keep_id"] == 6 and not by_id[5]["kept"]
    assert by_id[8]["kept"] and by_id[8]["group_size"] == 2 and by_id[None]["kept"]
    kept = exactdedup.drop_duplicates(hard)
    assert kept.columns == hard.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == sorted([3, 4, 6, 7, 8, 9, 9, 0, 2 ** 62, -5])
    assert exactdedup.exact_duplicates(none).count() == 0


def test_exact_dedup_index_persists(spark):
    index = exactdedup.DigestIndex(spark, f"idx_{uuid.uuid4().hex[:8]}", buckets=4)
    try:
        first = make_docs(spark, [(1, "a", None, None, None), (2, "A", None, None, None), (3, "b", None, None, None)])
        second = make_docs(spark, [(4, "a", None, None, None), (5, "c", None, None, None), (6, "c", None, None, None)])
        assert {r["id"]: r["keep_id"] for r in index.add(first).collect()} == {1: 2, 2: 2, 3: 3}
        assert {r["id"]: r["keep_id"] for r in index.add(second).collect()} == {4: 2, 5: 6, 6: 6}
        assert index.read().count() == 3
        index.add(make_docs(spark, []))
        assert index.read().count() == 3
    finally:
        index.forget()


def test_exact_dedup_goes_through_the_index(spark, tmp_path):
    """Two batches of the operator on one stored index: the anti-join is a sort-merge whose index side isn't shuffled."""
    path = f"file://{tmp_path}/index"
    first = make_docs(spark, [(1, "a", None, None, None), (2, "A", None, None, None), (3, "b", None, None, None)])
    second = make_docs(spark, [(4, "a", None, None, None), (5, "c", None, None, None), (6, "C", None, None, None), (6, "C", None, None, None)])
    assert {r["id"]: r["keep_id"] for r in exactdedup.exact_duplicates(first, index_path=path).collect()} == {1: 2, 2: 2, 3: 3}
    assert {r["id"]: (r["keep_id"], r["kept"]) for r in exactdedup.exact_duplicates(second, index_path=path).collect()} == \
        {4: (2, False), 5: (6, False), 6: (6, True)}
    assert sorted(r["doc_id"] for r in exactdedup.drop_duplicates(second).collect()) == [4, 6]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")]
    index = exactdedup.DigestIndex(spark, "plan_index", path=path)
    try:
        groups = exactdedup.digests(second).groupBy("digest").count()
        plan = groups.join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "LeftAnti" in plan
        right = plan[plan.index("LeftAnti"):]
        assert "Bucketed: true" in right and right.count("Exchange") <= 1
    finally:
        index.forget()


def test_hot_groups_take_the_broadcast(spark, monkeypatch):
    from lcspark.llm import common
    monkeypatch.setattr(common, "HOT_PARTS", 4)
    rows = [(i, "hot" if i % 2 else f"t{i}", None, None, None) for i in range(60)]
    got = exactdedup.exact_duplicates(make_docs(spark, rows)).collect()
    assert len(got) == 60 and {r["keep_id"] for r in got if r["id"] % 2} == {59}
    assert all(r["keep_id"] == r["id"] for r in got if r["id"] % 2 == 0)


def test_pii(spark, hard, none):
    model = pii.train(hard)
    got = pii.find(hard, model)
    assert got.columns == [*[c for c in hard.columns if c not in ("pii_base", "pii_spans")], "pii_base", "pii_spans"]
    spans = [r["pii_spans"] for r in got.where("doc_id = 9 and text like 'mail%'").collect()][0]
    assert {s["kind"] for s in spans} >= {"email", "ip", "phone"}
    clean = pii.redact(hard, model)
    assert clean.columns == hard.columns and clean.where("doc_id = 1").first()["text"] is None
    assert "example.com" not in clean.where("doc_id = 9 and text like 'mail%'").first()["text"]
    assert clean.where("doc_id = 7").first()["text"] == LONG
    assert pii.find(none, pii.train(none)).count() == 0


def test_bpe(spark, hard, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks, pattern = bpe.read_ranks(path), public_tokenizers.PATTERN
    for r in bpe.decode(bpe.encode(hard, ranks, pattern), ranks, pattern).collect():
        assert r["decoded"].decode() == (r["text"] or "")
    assert bpe.encode(none, ranks, pattern).count() == 0


def test_language_id(spark, hard, none, sf_small):
    model = langid.train(spark.read.parquet(f"{sf_small}/documents.parquet"))
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["lang_score"], r["lang_spans"]) for r in langid.identify(hard, model).collect()}
    for key in ((1, None), (2, ""), (4, " \n\t ")):
        assert got[key] == ("und", 0.0, [])
    assert got[(7, LONG)][0] == "es" and got[(7, LONG)][1] == 1.0
    assert langid.identify(none, model).count() == 0
    nothing = langid.train(none)
    assert {r["lang_pred"] for r in langid.identify(hard, nothing).collect()} == {"und"}


def test_letters_make_words(spark, sf_small):
    """Emoji with variation selectors, keycaps and lone marks have no letter."""
    model = langid.train(spark.read.parquet(f"{sf_small}/documents.parquet"))
    texts = ["❤️", "1️⃣ 2", "\u0301", "12 \u0301\u0302 !", "e\u0301", "❤️ hello"]
    got = {r["text"]: r["lang_pred"] for r in langid.identify(make_docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), model).collect()}
    assert [t for t in texts if got[t] == "und"] == texts[:4]
    assert langid.label_texts(["❤️ hello"], model)[0][0][:2] == (3, 8)


def test_every_identity_sentence_counts():
    text = " ".join(f"The women number {i} spoke." for i in range(30)) + " Nothing here."
    assert len(toxicity.counterfactuals(text)) == 30
    assert toxicity.counterfactuals(text)[29][1] == "The men number 29 spoke."


def test_language_spans_of_mixed_texts():
    import numpy as np
    scripts = np.zeros((len(langid._STARTS), 3), np.float32)
    latin, cyrillic = list(langid.SCRIPT_STARTS).index("latin"), list(langid.SCRIPT_STARTS).index("cyrillic")
    scripts[latin, 2] = scripts[cyrillic, :2] = langid._FAR
    model = langid.LanguageModel(["aa", "bb", "ru"], np.zeros((langid.BUCKETS, 3), np.float32), scripts)
    text = "один два, three four"
    assert langid.label_texts([text, "12 !"], model) == [[(0, 8, "ru"), (10, 20, "aa")], []]


def test_toxicity(spark, hard, none):
    from pyspark.sql import functions as F
    texts = [(i, f"you {'idiot' if i % 2 else 'friend'} number {i}", None, None, None) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, None), (999, 1), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(make_docs(spark, texts), labels)
    got = {r["text"]: r["toxicity"] for r in toxicity.score(hard, model).collect()}
    assert all(0 <= x <= 1 for x in got.values()) and got[None] == got[""]
    mean = toxicity.score(make_docs(spark, texts), model).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("toxicity").alias("t"))
    by = {r["odd"]: r["t"] for r in mean.collect()}
    assert by[1] > 0.5 > by[0]
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(hard, toxicity.train(none, labels)).first()["toxicity"] < 1e-6


def test_sharding(spark, hard, none):
    got = sharding.assign_shards(hard, [1.0] * 4, [1.0] * 5).collect()
    assert len(got) == len(HARD_ROWS)
    for s in range(4):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
    assert {r["size"] for r in got if r["id"] == 1} == {8} and len({r["shard"] for r in got if r["id"] is None}) == 1
    assert sharding.assign_shards(none, [1.0, 1.0]).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(hard, [1.0, 0.0])


def test_shard_weights(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    counts = {r["shard"]: r["count"] for r in sharding.assign_shards(docs, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 0.7 < counts[1] / 4000 < 0.8


def test_pipeline_against_brute_force(spark, tmp_path, sf_small):
    import corpus_pipeline
    import pandas as pd
    from test_llm_queries import brute_components, lower_ascii, shingles
    docs = pd.read_parquet(f"{sf_small}/documents.parquet")[["doc_id", "text", "lang", "source", "n_chars"]]
    extra = pd.DataFrame([(10 ** 6, None, "en", "a", 0), (10 ** 6 + 1, "12 34 !!", None, "a", 8)], columns=docs.columns)
    pd.concat([docs, extra]).to_parquet(f"{tmp_path}/documents.parquet", index=False)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    keep = {}
    for d, t in zip(docs.doc_id, docs.text):
        keep[lower_ascii(t)] = max(d, keep.get(lower_ascii(t), d))
    left = {d: t for d, t in zip(docs.doc_id, docs.text) if keep[lower_ascii(t)] == d}
    roots = brute_components({d: shingles(t, 5) for d, t in left.items()}, 80)
    assert set(got.doc_id) == {d for d in left if roots[d] == d}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert out.columns == list(docs.columns)


def test_pipeline_stages_as_a_whole(spark, tmp_path):
    """Repeated and null ids, planted copies and mentions, further columns: each stage's rows, and the pieces of the last."""
    import zlib
    import corpus_pipeline
    from tokenizers import Tokenizer
    from lcspark.llm.common import staged
    words = [f"{w}{i}" for i in range(12) for w in ("lorem", "ipsum", "dolor", "amet", "elit")]
    long = " ".join(words)
    rows = [(1, long, "la"), (2, " ".join([*words[:-1], "other"]), "la"), (2, "The quick brown fox jumps over the lazy dog.", None),
            (None, "call me at +1 (743) 555-3824 or 743 555 3824, ann.lee@example.org", "en"), (None, "A short text without an id", "en"),
            (3, "a SHORT text without an id", "en"), (4, None, "en"), (5, "❤️ 12", "en"), (6, long.upper(), "la"), (7, long, "la")]
    docs = make_docs(spark, [(i, t, lang, "s", len(t or "")) for i, t, lang in rows])
    at, texts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = staged(stage(spark, at, str(tmp_path)), name)
        assert at.columns == docs.columns
        texts.append(sorted((r["doc_id"] or 0, r["text"]) for r in at.collect()))
    kept = [(i or 0, t) for i, t, _ in rows if t and "❤️" not in t]
    assert texts[0] == sorted(kept)
    gone = {(0, "A short text without an id"), (1, long), (6, long.upper())}
    assert texts[1] == sorted(set(kept) - gone)
    near = (7, long)
    assert texts[2] == sorted(set(kept) - gone - {near})
    last = {r["text"]: r for r in at.collect()}
    mention = next(t for t in last if t.startswith("call me"))
    assert "555" not in mention and "example.org" not in mention and mention.startswith("call me at [PHONE] or")
    assert all(r["n_chars"] == len(t) and r["lang"] and r["ids"] == "x" for t, r in last.items())
    t = Tokenizer.from_str(tokenizer())
    t.encode_special_tokens = True
    want = sorted(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*t.encode(s, add_special_tokens=False).ids, 1])) for s in last)
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert sorted(r["ids_crc32"] for r in pieces) == want
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_entry_without_the_subpackage(tmp_path):
    """The entry module works where the subpackage and the pipeline are gone."""
    import shutil
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/lcspark", f"{tmp_path}/lcspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    names, oracles = json.loads(out.stdout)
    assert len(names) > 100 and not [n for n in names if n.startswith("op") or n == "pipeline"] and set(oracles) <= set(names)
