"""Every query of the subpackage at sf0.001: against its DuckDB oracle, or a
brute-force version over whole texts."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from check_oracles import rows_of
from tokenizers import Tokenizer

import __spark_entry__ as entry
from lcspark.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def shingles(text, n, lower=lower_ascii):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_components(sets, percent):
    """id -> least id reachable over links."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                r, s = sorted((root(i), root(j)))
                parent[s] = r
    return {i: root(i) for i in ids}


def check_packing(rows, capacity=4096):
    """Gapless from 0 in every sequence, within capacity; returns the number of sequences."""
    places = defaultdict(list)
    for r in rows.itertuples():
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_matches_oracle(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    got, want = q.QUERIES[name](spark, sf_small).toPandas(), con.execute(q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_registers_all():
    names = [n for n in entry.queries() if n == "pipeline" or re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n != "pipeline") == list(range(1, 14))
    assert "pipeline" in names


def test_op1_fingerprints(spark, sf_small, docs_small):
    got = q.QUERIES["op1_fingerprints"](spark, sf_small).toPandas().set_index("doc_id")
    texts = docs_small.text.tolist()
    assert len(got) == len(texts)
    for i, (doc, text) in enumerate(zip(docs_small.doc_id, texts)):
        following, row, n = texts[(i + 1) % len(texts)], got.loc[doc], len(text)
        edited = text[:n - n // 2] + following[:n // 2]
        assert row.n_chars == n and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = shingles(text, 5, str.lower)
        assert abs(row.near_edited - jaccard(own, shingles(edited, 5, str.lower))) < 0.15
        assert abs(row.near_next - jaccard(own, shingles(following, 5, str.lower))) < 0.15
        assert abs(row.n_shingles_estimate - len(own)) <= 0.3 * len(own)
    same = docs_small.assign(f=got.loc[docs_small.doc_id].fingerprint.values).groupby("text").f.nunique()
    assert (same == 1).all()


def test_op3_best_fit_packing(spark, sf_small, docs_small):
    got = q.QUERIES["op3_best_fit_packing"](spark, sf_small).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = set()
    for doc, text in zip(docs_small.doc_id, docs_small.text):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want |= {(doc, at // 4096, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes()))
                 for at in range(0, len(ids), 4096)}
    assert set(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want and len(got) == len(want)
    assert check_packing(got) <= 1.02 * (got.length.sum() / 4096) + 1


def test_op4_minhash_near_dedup(spark, sf_small, docs_small):
    got = q.QUERIES["op4_minhash_near_dedup"](spark, sf_small).toPandas().set_index("doc_id")
    sets = {d: shingles(t, 4) for d, t in zip(docs_small.doc_id, docs_small.text)}
    want = brute_components(sets, 80)
    assert got.component_id.to_dict() == want
    assert got.n_shingles.to_dict() == {d: len(s) for d, s in sets.items()}
    assert got.kept.to_dict() == {d: d == c for d, c in want.items()}


def test_op6_base_spans(spark, sf_small, docs_small):
    from test_llm_units import slow_base_spans
    got = q.QUERIES["op6_pii"](spark, sf_small).toPandas().set_index("doc_id")
    kinds = ("email", "ip", "card", "phone")
    for doc, text in zip(docs_small.doc_id, docs_small.text):
        base, row = slow_base_spans(text), got.loc[doc]
        listed = [f"{kinds[k]}:{a}:{b}" for a, k, b in base]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in kinds] == [sum(x[1] == i for x in base) for i in range(4)]
        assert set(listed) <= set(row.spans.split(",")) | {""}


def test_op7_byte_bpe(spark, sf_small, docs_small):
    got = q.QUERIES["op7_byte_bpe"](spark, sf_small).toPandas().set_index("doc_id")
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for doc, text in zip(docs_small.doc_id, docs_small.text):
        ids = encoding.encode_ordinary(text)
        assert tuple(got.loc[doc]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                       hashlib.sha256(text.encode()).hexdigest())


def test_op8_held_out_accuracy(spark, sf_small, docs_small):
    got = q.QUERIES["op8_language_id"](spark, sf_small).toPandas().set_index("doc_id").loc[docs_small.doc_id]
    assert (got.held_out.values == [zlib.crc32(str(d).encode()) % 4 == 2 for d in docs_small.doc_id]).all()
    assert got.score.between(0, 1).all()
    assert (got.lang_pred.values == docs_small.lang.values)[got.held_out.values].mean() >= 0.9


def test_op9_held_out_accuracy(spark, sf_small):
    sf = sf_small.replace("0.001", "0.01")
    got = q.QUERIES["op9_toxicity"](spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    assert (got.held_out.values == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    out = got[got.held_out].merge(labels, on="doc_id")
    assert (out.predicted == out.toxic).mean() >= 0.9


def test_op10_sharding(spark, sf_small, docs_small):
    got = q.QUERIES["op10_sharding"](spark, sf_small).toPandas().set_index("doc_id").loc[docs_small.doc_id]

    def best(doc, n):
        scores = [1 / -np.log((int(hashlib.md5(f"{doc}|{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52) for s in range(n)]
        return int(np.argmax(scores))
    assert got.shard.tolist() == [best(d, 24) for d in docs_small.doc_id]
    assert got.grown_shard.tolist() == [best(d, 25) for d in docs_small.doc_id]
    assert ((got.shard == got.grown_shard) | (got.grown_shard == 24)).all()
    assert got["size"].tolist() == [len(t.encode()) + 8 for t in docs_small.text]
    assert got.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in docs_small.text]
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
