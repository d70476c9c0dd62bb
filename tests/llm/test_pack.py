"""Packing: the pieces' ids are the tokenizer's, whole and in order."""

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm.pack import END_ID, digest, encode_texts, pack, piece_lengths, word_encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["It's a test, isn't it? YES!!", None, "", " \n\t ", "İstanbul áb áb ΑΣ, ΑΣ <|endoftext|>x don't! 9a Ⅷ ... ».,  x é.",
         "word " * 5000, "x" * 9000, "a, b. c; d: e! f?", "日本語 <|startoftext|>,"]


def reference(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [END_ID]


def test_ids_are_the_tokenizers():
    ids, offsets = encode_texts(pa.array(TEXTS), PATH, END_ID)
    for k, text in enumerate(TEXTS):
        assert ids[offsets[k]:offsets[k + 1]].tolist() == reference(text)


def test_words_are_forgotten_and_encoded_again(monkeypatch):
    import tabulon.llm.pack as module
    monkeypatch.setattr(module, "CACHE_WORDS", 3)
    enc = word_encoder(PATH)
    for _ in range(2):
        ids, _ = enc.gather(enc([b"some", b"words,", b"it's", b"here!", b"words"]))
        assert ids.tolist() == reference("some words, it's here! words")[:-1]


def test_piece_lengths():
    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        got = piece_lengths(n, 4096)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 4096 for x in got) and got == sorted(got, reverse=True)


def test_pieces(spark):
    df = spark.createDataFrame([(k, t, 5, "s") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], 5, "s"), (None, "x", 5, "s")],
                               "doc_id long, text string, length int, offset string").repartition(3)
    rows = pack(df, PATH).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    by_doc = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096
        by_doc.setdefault(r["doc_id"], []).append(r)
    for k, text in enumerate(TEXTS):
        want = reference(text)
        copies = 2 if k == 0 else 1
        spans = sorted((r["start"], r["length"]) for r in by_doc[k])
        assert sum(n for _, n in spans) == copies * len(want) and {r["doc_tokens"] for r in by_doc[k]} == {len(want)}
        for r in by_doc[k]:
            assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["start"]:r["start"] + r["length"]]
    assert digest(pack(df, PATH)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_no_rows_and_a_bad_size(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df, PATH).count() == 0
    with pytest.raises(ValueError):
        pack(df, PATH, max_tokens=1000)


def test_every_letter_before_every_mark_is_encoded_as_in_the_whole_text():
    """Letters that the normalizer takes apart (a dotted capital I, nukta letters) change what follows them."""
    import sys

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tabulon.llm import pack as P
    path = public_tokenizers.path("word_bpe_49k.json")
    letters = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and chr(c).isalpha()]
    texts = [" ".join(x + m for m in ["", *".,;:!?"]) + f" a{x}b. {x}{x}" for x in letters]
    texts = [" ".join(texts[k:k + 200]) for k in range(0, len(texts), 200)] + ["SEVG\u0130. \u0130! \u0958?"]
    ids, offsets = P.encode_texts(pa.array(texts), path, 2)
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:z].tolist() for a, z in zip(offsets, offsets[1:])] == [[*e.ids, 2] for e in whole]
