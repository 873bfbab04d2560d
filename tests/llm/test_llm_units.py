"""Parts of the operators against plain versions of themselves."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lcspark.llm import bpe, langid, neardup, packing, pii, textvec, toxicity

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_base_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(t):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text("aB12345670..@@+- ()-é%_", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == slow_base_spans(text)


def test_base_spans_of_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "@" + "." * 1000) == []


@pytest.fixture(scope="module")
def crf():
    rows = [(4, ",".join(map(str, pii.shape_features("1 (743) 555-3824"))), 50),
            (3, ",".join(map(str, pii.shape_features("4524132264652876"))), 50),
            (0, ",".join(map(str, pii.shape_features("12345678"))), 50)]
    return pii.fit(rows)


def spans_of(text, crf):
    base, found = pii.find_spans(text, crf)
    assert set(base) <= set(found)
    return [(pii.KINDS[k], text[a:b], (a, k, b) in base) for a, k, b in found]


def test_similar_mentions_get_the_same_label(crf):
    far = " lorem" * 300
    got = spans_of("call +1 (743) 555-3824" + far + " 743-555-3824 and 7435553824", crf)
    assert got == [("phone", "+1 (743) 555-3824", True), ("phone", "743-555-3824", False), ("phone", "7435553824", False)]
    assert spans_of("order 12345678 of" + far + " 12345678", crf) == []


def test_numbers_that_run_together_are_found(crf):
    got = spans_of("x +1 (269) 555-3296 4524132264652876 y", crf)
    assert [(k, s) for k, s, _ in got] == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]


def test_many_repeats_make_a_linear_graph(crf):
    text = "+1 (743) 555-3824 " + "x 743-555-3824 " * 3000
    nodes = pii.mentions(text, pii.base_spans(text))
    chain, skip, near = pii.edges_of(nodes)
    assert len(nodes) == 3001 and len(skip) <= 2 * len(nodes) and len(chain) < len(nodes) and len(near) <= 2 * len(nodes)
    assert len(pii.find_spans(text, crf)[1]) == 3001


def test_beliefs_on_a_tree_are_exact():
    rng = np.random.default_rng(3)
    unary, edges = rng.normal(size=(4, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    pair = rng.normal(size=(3, 3, 3))
    joint = np.zeros((3,) * 4)
    for x in np.ndindex(*joint.shape):
        joint[x] = sum(unary[i, x[i]] for i in range(4)) + sum(pair[e, x[a], x[b]] for e, (a, b) in enumerate(edges))
    joint = np.exp(joint - joint.max())
    joint /= joint.sum()
    got = pii.beliefs(unary, edges, pair)
    for i in range(4):
        assert np.allclose(got[i], joint.sum(axis=tuple(j for j in range(4) if j != i)), atol=2e-2)


def test_local_parts_of_any_shape_are_found():
    far = " lorem" * 300
    seen = ["john.smith", "maria-keller", "bob", "jo", "ann_lee", "k.o-neil", "jsmith42", "12345678"]
    texts = [f"from {w}@example.org in room12 of code_7 with 50%" for w in seen for _ in range(20)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    rows = [tuple(r.values()) for b in pii._examples(iter([batch])) for r in b.to_pylist()]
    model = pii.fit(sorted(rows))
    for w in seen:
        text = f"{w}@example.org wrote{far} {w.upper()}, (_{w}_) and {w}. Not x{w} or {w}s"
        again = [text[m.start:m.end] for m in pii.mentions(text, pii.base_spans(text)) if m.label is None]
        assert again == [w.upper(), w, w]
        assert [s for k, s, is_base in spans_of(text, model) if k == "email" and not is_base] == again


def test_a_number_that_is_a_local_part_keeps_its_other_links():
    text = "+1 743 555 3824, 7435553824@example.org, 7435553824"
    nodes = pii.mentions(text, pii.base_spans(text))
    assert [(n.key, n.also) for n in nodes if n.label is None] == [("#5553824", "@7435553824")]
    assert pii.edges_of(nodes)[1:] == ([(0, 2), (1, 2)], [])


def test_variants_of_observed_mentions_are_found(sf_small):
    """Trained on the test documents: numbers without plus, with other marks or one digit wrong, and local parts bare or
    without dots, of mentions that their document shows in full, are found; documents without such mentions stay as they are."""
    import pandas as pd
    texts = pd.read_parquet(f"{sf_small.replace('0.001', '0.01')}/documents.parquet").text.fillna("").tolist()
    batch = pa.RecordBatch.from_pydict({"text": texts})
    model = pii.fit(sorted(tuple(r.values()) for b in pii._examples(iter([batch])) for r in b.to_pylist()))
    rng, hits, total = random.Random(8), 0, 0
    for _ in range(150):
        a, b, c = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)
        name = "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(4, 8)))
        local = rng.choice([name, f"{name}.smith", f"{name}{rng.randint(1, 99)}"])
        wrong = c + (1 if c % 10 < 9 else -1)
        for full, variant in ((f"+1 ({a}) {b}-{c}", f"{a} {b} {c}"), (f"+1 {a} {b} {c}", f"{a}-{b}-{c}"), (f"+1{a}{b}{c}", f"1{a}{b}{wrong}"),
                              (f"{local}@example.org", local), (f"{name}.jones@example.org", f"{name}jones")):
            text = f"ask {full}{' lorem ipsum' * rng.randint(1, 40)} or {variant} later"
            at = text.rindex(variant)
            hits += any(s[0] == at and s[2] == at + len(variant) for s in pii.find_spans(text, model)[1])
            total += 1
    assert hits >= 0.9 * total, hits / total
    for text in ("It was 1998-2004, room 12 of 345 6789 items, order 12345678.", "version 10 of code_7 with 50% off", "no numbers at all"):
        assert pii.find_spans(text, model) == ([], [])
    found = [pii.find_spans(t, model) for t in texts]
    assert sum(len(all_) - len(base) for base, all_ in found if not base) <= 0.01 * len(texts)


def test_similar_is_not_equal():
    text = "+1 743 555 3824, then 743 555 3825, 743 555 3824, ann.lee@x.org and annlee, ann.lee"
    nodes = pii.mentions(text, pii.base_spans(text))
    chain, skip, near = pii.edges_of(nodes)
    named = [text[n.start:n.end] for n in nodes]
    assert named == ["+1 743 555 3824", "743 555 3825", "743 555 3824", "ann.lee@x.org", "annlee", "ann.lee"]
    assert (0, 2) in skip and (3, 5) in skip and not {(0, 1), (3, 4)} & set(skip)
    assert (1, 2) in near and (3, 4) in near


def test_redaction_joins_overlaps():
    assert pii.redact_text("ab12cd34", [(0, 3, 4), (2, 2, 6)]) == "[PHONE]34"


@pytest.fixture(scope="module")
def codec():
    return bpe.BytePairCodec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_round_trip_and_ids(codec, encoding, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = codec.encode_texts([text])[0].tolist()
    assert ids == encoding.encode_ordinary(text) and codec.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text("aB \n\t.,'s1é\u00a0\x1c", max_size=30))
def test_bpe_white_space(codec, encoding, text):
    assert codec.encode_texts([text])[0].tolist() == encoding.encode_ordinary(text)


def test_bpe_long_pieces(codec, encoding):
    rng = random.Random(5)
    for text in ("a" * 700, "ab" * 900, "\n" * 600, "あいう" * 300, "".join(rng.choice("abcdefgh") for _ in range(3000)),
                 "the" * 400, "x" * bpe.LONG_PIECE, "y" * (bpe.LONG_PIECE + 1)):
        assert codec.encode_texts([text])[0].tolist() == encoding.encode_ordinary(text)


def test_bpe_small_cache(encoding):
    small = bpe.BytePairCodec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, 20)
    texts = [" ".join(f"word{i * j % 97}" for j in range(50)) for i in range(30)]
    for _ in range(2):
        assert [x.tolist() for x in small.encode_texts(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_warm_caches_meet_a_larger_slice(encoding):
    """Some chunks of a slice that exceeds the bound are known already, young or old."""
    from tokenizers import Tokenizer
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    whole = Tokenizer.from_str(definition)
    whole.encode_special_tokens = True
    small = bpe.BytePairCodec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, 20)
    tokenizer = packing.ChunkTokenizer(definition, 20)
    for first, last in ((0, 10), (0, 60), (50, 60), (5, 90), (0, 90), (80, 95)):
        texts = [" ".join(f"word{i}" for i in range(first, last)), f" x{first}"]
        assert [x.tolist() for x in small.encode_texts(texts)] == [encoding.encode_ordinary(t) for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.encode_texts(texts)] == \
            [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_unknown_id(codec):
    with pytest.raises(KeyError):
        codec.decode([10 ** 9])


def test_tokenizer_chunks_equal_whole_texts():
    from tokenizers import Tokenizer
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    whole = Tokenizer.from_str(definition)
    whole.encode_special_tokens = True
    texts = ["", " ", "\n\n a", "<|endoftext|> x", "a\x1cb\x85c\xa0d e", "ΟΔΟΣ İstanbul é ́x", "don't I'LL 12",
             "😀👍🏽 a😀", "x" * 3000, "A B  C", "a\tb\r\nc", "​ ‍", "﻿q", "'s 's'", "ǅ ß ẞ"]
    chunked = packing.ChunkTokenizer(definition, cache_chunks=10)
    for _ in range(2):
        for text, ids in zip(texts, chunked.encode_texts(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda cap: st.tuples(st.just(cap), st.lists(st.integers(0, 9), min_size=cap, max_size=cap))))
def test_packing_plan_is_valid(case):
    capacity, counts = case
    counts = np.array([0, *counts])
    plan, filled = packing.Plan(counts, capacity), {}
    for length in np.flatnonzero(counts):
        n = counts[length]
        for s, o in zip(*plan.locate(np.full(n, length), np.arange(n))):
            filled.setdefault(int(s), []).append((int(o), int(length)))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) == plan.bins
    # best fit leaves no two sequences that one could hold, but for what exact filling took apart
    assert plan.bins <= max(1, int(np.ceil(1.5 * (counts * np.arange(capacity + 1)).sum() / capacity)) + 1)


def test_exact_complements_fill_sequences():
    counts = np.zeros(101, int)
    counts[[60, 40, 50, 30, 20, 10]] = [3, 3, 2, 2, 2, 2]       # 60+40, 50+50, 50+30+20, ...
    plan = packing.Plan(counts, 100)
    assert plan.bins == int(np.ceil((counts * np.arange(101)).sum() / 100))


def test_registers_match_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    for size in (5, 40, 300, 3000):
        agree = []
        for _ in range(20):
            shared = rng.integers(0, 2 ** 63, int(size * 0.8), dtype=np.uint64)
            own = rng.integers(0, 2 ** 63, size - len(shared), dtype=np.uint64) * np.uint64(2)
            a = np.unique(textvec.mix(np.concatenate([shared, own])))
            b = np.unique(textvec.mix(shared))
            r = neardup.registers([a, b])
            agree.append((r[0] == r[1])[:neardup.REGISTERS].mean())
        assert abs(np.mean(agree) - 0.8) < 0.04


def test_earlier_band_counts_as_shared_only_if_its_key_is(spark, monkeypatch):
    """Band 0 agrees in its sketch field and not in its key: the pair meets in band 1, and once though it shares 72."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (1, 512)).astype(np.uint16)
    key_a = neardup.band_keys(a)
    for value in range(1 << 16):
        b = a.copy()
        b[0, 0] = value
        key_b = neardup.band_keys(b)
        field = [neardup.sketches(x, k)[0, 0] & 0xFFFFFFFF for x, k in ((a, key_a), (b, key_b))]
        if value != a[0, 0] and field[0] == field[1]:
            break
    assert key_a[0, 0] != key_b[0, 0] and (key_a[0, 1:] == key_b[0, 1:]).all()
    registers = neardup.whole_registers([np.arange(1, 100, dtype=np.uint64) << np.uint64(50)] * 2)
    reps = spark.createDataFrame([(n, 100, k[0].tolist(), neardup.sketches(x, k)[0].tolist())
                                  for n, x, k in ((1, a, key_a), (2, b, key_b))],
                                 "node long, n_shingles long, bands array<long>, sketch array<long>")
    whole = spark.createDataFrame([(1, registers[0].tolist()), (2, registers[1].tolist())], "node long, whole array<int>")
    members = reps.selectExpr("node", "posexplode(bands) AS (band, key)").selectExpr("key", "band", "node", "node AS root", "2L AS size")
    assert [tuple(r) for r in neardup._cross_candidates(members, reps, whole, 80, 146).collect()] == [(1, 2)]
    assert neardup._cross_candidates(members.where("band = 2"), reps, whole, 80, 2).count() == 0
    # the same from a group cut into blocks, each pair met in one task
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 1)
    assert [tuple(r) for r in neardup._cross_candidates(members, reps, whole, 80, 146).collect()] == [(1, 2)]


def test_shingle_sets_across_slices(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += ["", " \t\n", "Ä ä", "one two", "ONE two"]
    whole = neardup.shingle_sets(texts, 4)
    plain = [{tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if (w := t.lower().split()) else set() for t in texts[:-3]]
    assert [len(s) for s in whole[:-3]] == [len(s) for s in plain]
    assert (whole[-1] == whole[-2]).all()
    single = [neardup.shingle_sets([t], 4)[0] for t in texts]
    assert all((a == b).all() for a, b in zip(whole, single))


def test_constant_path_shortcut_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(300):
        scores = rng.normal(0, 3, (rng.integers(1, 40), 3)).astype(np.float32)
        scores[:, 0] += rng.random() * 3
        path = langid.viterbi([scores], 8.0)[0]

        def value(p):
            return sum(scores[i, x] for i, x in enumerate(p)) - 8 * sum(p[i] != p[i - 1] for i in range(1, len(p)))
        only = langid._one_language(scores, 8.0)
        assert only is None or value([only] * len(scores)) >= value(path) - 1e-3


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    blocks = [rng.normal(0, 3, (n, 2)).astype(np.float32) for n in (1, 3, 7)]
    for scores, path in zip(blocks, langid.viterbi(blocks, 2.0)):
        def value(p):
            return sum(scores[i, x] for i, x in enumerate(p)) - 2 * sum(p[i] != p[i - 1] for i in range(1, len(p)))
        best = max(value(p) for p in np.ndindex(*[2] * len(scores)))
        assert abs(value(path) - best) < 1e-4


def test_counterfactual_penalty_evens_identity_terms_out():
    rng = random.Random(7)
    common = ["alpha", "beta", "gamma", "delta"]
    texts, labels = [], []
    for _ in range(400):
        toxic = rng.random() < 0.5
        term = "women" if rng.random() < (0.9 if toxic else 0.1) else "men"
        insult = "idiot" if toxic and rng.random() < 0.7 else rng.choice(common)
        texts.append(" ".join([term, "are", insult, rng.choice(common)]))
        labels.append(float(toxic))
    lists = toxicity._rows(*toxicity.features(texts), len(texts))
    pairs = [p for t in texts for p in toxicity.counterfactuals(t)]
    before = toxicity._rows(*toxicity.features([p[0] for p in pairs]), len(pairs))
    after = toxicity._rows(*toxicity.features([p[1] for p in pairs]), len(pairs))
    gained = [sorted(set(y) - set(x)) for x, y in zip(before, after)]
    lost = [sorted(set(x) - set(y)) for x, y in zip(before, after)]
    plain = toxicity.fit(lists, np.array(labels), [], [])
    fair = toxicity.fit(lists, np.array(labels), gained, lost)

    def gap(model):
        women, men = toxicity.scores(["women are gamma", "men are gamma"], model)
        return abs(women - men)
    assert gap(fair) < 0.3 * gap(plain)
    assert toxicity.scores(["you idiot"], fair)[0] > 0.5


def test_ranks_file_is_read_whole():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert len(ranks) == 50256 and base64.b64decode(b"IQ==") in ranks
