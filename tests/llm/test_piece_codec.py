import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quillstack.llm.piece_codec import PieceModel, decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b   c    d", "Hello, world! <s> </s> <unk> <0x0A>\n\n\tx", "漢字かな交じり文 🙂🙂 \x00\x01 é É Straße", "▁▁x ▁", "aaaaaaaaaaaaaaaaaaaaaaaa",
    "x" * 3000, "ab " * 2000, "thouinor|edston|lyesha", "Èle ouchan èment enanè", "   lead", "trail   ", "1234567890 3.14",
]


def test_equals_sentencepiece():
    own, lib = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = [np.frombuffer(x, "<i4").tolist() for x in own.encode(TEXTS)[0]]
    assert got == lib.encode(TEXTS)
    assert [own.decode(x) for x in got] == [lib.decode(x) for x in got]


def test_parity_is_counted_and_words_come_and_go(monkeypatch):
    import quillstack.llm.piece_codec as pc

    class Other:
        def encode(self, words, **_):
            return [[0] if w == "odd" else peer.encode(w) for w in words]

    own, peer = PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    own.peer = Other()
    monkeypatch.setattr(pc, "KEPT", 2)
    for _ in range(3):
        ids, misses = own.encode(["an odd word", "a word", "", "odd odd"])
        assert misses == [1, 0, 0, 1] and np.frombuffer(ids[1], "<i4").tolist() == peer.encode("a word")
        own.encode(["some other words that fill the cache"])


def test_round_trips_are_told_by_words(monkeypatch):
    """Of each new word once; only texts with a word that its ids don't give back are decoded."""
    own, decoded = PieceModel(PATH), []
    was = own.decode
    monkeypatch.setattr(own, "decode", lambda ids: decoded.append(ids) or was(ids))
    raw, _, same = own.checked([*TEXTS, *TEXTS])
    assert all(same) and not own.torn and not decoded
    assert [was(np.frombuffer(x, "<i4").tolist()) for x in raw] == [t.replace("▁", " ") for t in [*TEXTS, *TEXTS]]
    # a piece that decodes to other bytes of the same size, and one to fewer
    for other in (b" zq", b""):
        own = PieceModel(PATH)
        broken = own.backend.encode("▁ab", add_special_tokens=False).ids[-1]
        own.bytes[broken] = other
        own.sizes[broken] = len(other)
        texts = ["an ab", "ab", "an", "", "ab an"]
        for _ in range(2):  # learned, and from the cache
            raw, _, same = own.checked(texts)
            assert same == [own.decode(np.frombuffer(x, "<i4").tolist()) == t for t, x in zip(texts, raw)] == [False, False, True, True, False]


def test_frame_round_trip(spark):
    rows = [(i, t, [1]) for i, t in enumerate(TEXTS)] + [(3, "a", [2]), (None, None, None)]
    out = encode(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>"), PATH)
    got = out.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_tokens == len(r.ids) and r.parity_misses == 0 for r in got)
    back = {r.doc_id: r.text for r in decode(out, PATH).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t, _ in rows)
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_table(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in encode(d, PATH).collect()}
    assert got == {r.doc_id: lib.encode(r.text or "") for r in d.collect()}


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_model_made_by_hand(tmp_path, squeeze):
    r = random.Random(2)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    words = {"▁"} | {c for c in "abcdeé"} | {"".join(r.choice("abcdeé") for _ in range(r.randint(2, 4))) for _ in range(60)}
    pieces += [(w, -round(r.uniform(1, 12), 3), 1) for w in sorted(words | {"▁" + w for w in words if "▁" not in w})]
    raw = b"".join(field(1, field(1, p) + field(2, s) + field(3, k)) for p, s, k in pieces)
    raw += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, "identity") + field(3, 1) + field(4, squeeze) + field(5, 1))
    path = tmp_path / "m.model"
    path.write_bytes(raw)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), PieceModel(str(path))
    texts = ["", "abcde", "a  bé", " x🙂y ", "".join(r.choice("abcdeé ") for _ in range(300))]
    got = [np.frombuffer(x, "<i4").tolist() for x in own.encode(texts)[0]]
    assert got == lib.encode(texts)
    assert [own.decode(x) for x in got] == [lib.decode(x) for x in got]
