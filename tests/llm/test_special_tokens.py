"""Byte-level BPE of texts with white space of all kinds around a special token."""

from __future__ import annotations

import random


def test_white_space_before_a_special_token():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from kerbline.llm.byte_bpe import encode_texts
    from kerbline.llm.packing import tokenizer_file

    rng = random.Random(6)
    parts = ["\n\n", "\n", " ", "  ", "\t", "\r\n", "foo", "bar's", "<|endoftext|>", "<|endoftext|>", "日本", "　", "<|end", "1"]
    texts = ["foo\n\n<|endoftext|>", "foo  <|endoftext|>\n\nbar", "\n\n<|endoftext|>", "<|endo", "ftext|>", None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    ids, off = encode_texts(pa.array(texts), "byte_bpe_50k.json")
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    assert ids[off[0] : off[1]].tolist() == [21943, 628, 50256]
    for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[off[i] : off[i + 1]].tolist() == e.ids, repr(texts[i])
