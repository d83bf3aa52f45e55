import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from mentionlake.llm.bpe import Encoder, Vocabulary, digests, encoded, vocabulary_path

ODD = [
    "", "   ", "aaaaaaa aaaa", "<|endoftext|>x<|startoftext|>", "I'M don't 'sxx 123 ½ ΑΣ ΣΑΣ. İstanbul ﬁ é K​　x", "🙂🙂🙂!!!???",
    "it's'll'd", "\x00\x01\x1c\x1d a\u0085b", "İ ǅ ᾳ ẞ ß", "a" * 500, "<|ENDOFTEXT|>", "一二三", "é<|endoftext|>́",
]


def test_same_ids_and_decoded_text_as_the_library(spark, rows_of, docs):
    library = Tokenizer.from_file(vocabulary_path())
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice("aAbB 'śe!1<|>Σ") for _ in range(80)) for _ in range(100)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in encoded(frame).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    by_id = {i: t or "" for i, t in rows_of}
    for r in digests(docs).collect():
        ids = library.encode(by_id[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_capital():
    library, encoder = Tokenizer.from_file(vocabulary_path()), Encoder(Vocabulary.read(vocabulary_path()))
    signs = [c for c in range(0x110000) if c in encoder.capitals or chr(c).lower() != chr(c)]
    texts = [f"a{chr(c)} {chr(c)}b1{chr(c)}" for c in signs if not 0xD800 <= c < 0xE000]
    assert len(encoder.capitals) == 55
    for text, want, got in zip(texts, library.encode_batch(texts, add_special_tokens=False), encoder.encode(texts)):
        assert got.tolist() == want.ids, ascii(text)


def test_no_rows(no_docs):
    assert digests(no_docs).count() == 0
