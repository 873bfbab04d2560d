"""Findings of the third round on the training-data operators."""

from lcspark.llm import packing, queries


def test_parts_are_looked_up_once_a_slice(monkeypatch):
    """op3: chunks are told apart by Arrow; the cache is asked for each
    distinct part once, however many texts and forms it occurs in."""
    asked = []
    look_up = packing.ChunkCache.ids
    monkeypatch.setattr(packing.ChunkCache, "ids", lambda self, chunks: asked.extend(chunks) or look_up(self, chunks))
    words = ["alpha", "Beta", "naïve", "İstanbul", "x1", "don't", "日本語"]
    texts = [" ".join(w + m for w in words for m in ("", ".", ",", "?!")) for _ in range(1500)] + ["", " ", "a\nb  c."]
    tokenizer = packing.ChunkTokenizer(queries.word_tokenizer())
    got = tokenizer.encode_texts(texts)
    for text, ids in zip(texts[-4:], got[-4:]):
        assert ids.tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(asked) < 40 and len(got) == len(texts)


def test_slices_of_texts_change_no_ids(monkeypatch):
    """Slices and gathered runs of a few bytes, and a text longer than both."""
    texts = ["one two.", "", "three, " * 50, "Four five!", "é ü.", "six"]
    whole = packing.ChunkTokenizer(queries.word_tokenizer())
    expected = [whole.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for slice_bytes, gathered_bytes in ((1, 1), (12, 5), (400, 9), (10**6, 20)):
        monkeypatch.setattr(packing, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(packing, "GATHERED_BYTES", gathered_bytes)
        assert [i.tolist() for i in whole.encode_texts(texts)] == expected
    assert whole.encode_texts([]) == []


def test_few_parts_are_encoded_at_a_time(monkeypatch):
    """What the tokenizer holds doesn't grow with a slice's new parts."""
    tokenizer = packing.ChunkTokenizer(queries.word_tokenizer())
    given, encode = [], tokenizer._encode_words
    monkeypatch.setattr(packing, "PARTS_ENCODED", 7)
    monkeypatch.setattr(tokenizer, "_encode_words", lambda words: given.append(len(words)) or encode(words))
    text = " ".join(f"{'abcdefghij'[i % 10] * (1 + i // 10)} {i} é{'xyz'[i % 3] * (i // 3)}" for i in range(60))
    assert tokenizer.encode_texts([text])[0].tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
    assert max(given) == 7 and sum(given) == 118
