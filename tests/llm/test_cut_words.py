"""Words that are cut inside a character."""

import pyarrow as pa

from termweave.llm import kernels, langid


def test_bytes_need_not_be_whole_characters():
    words = [("é" * 20).encode()[:31], None, b"\xff", b"a"]
    raw, offs = kernels.text_bytes(pa.array(words, pa.binary()))
    assert raw.tobytes() == b"".join(w or b"" for w in words) and offs.tolist() == [0, 31, 31, 32, 33]


def test_long_words_are_learned_whichever_byte_they_are_cut_at(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = [("fr", "é" * 20), ("ja", "日本語の長い文章" * 3), ("el", "ηλεκτροεγκεφαλογραφήματος"), ("en", "a plain word")]
    docs = spark.createDataFrame([(10 * k + i, t, lang) for i, (lang, t) in enumerate(texts) for k in range(6)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs, path).collect()}
    assert {(i % 10, r["lang_pred"]) for i, r in got.items()} == {(i, lang) for i, (lang, _) in enumerate(texts)}
    monkeypatch.setattr(langid, "BLOCK", 5)  # a word at a time
    assert {r["doc_id"]: r for r in langid.identify(docs, path).collect()} == got
