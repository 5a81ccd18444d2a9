"""The transducer against the library: both kinds of models, long chunks, the escape character, the normaliser."""

import pickle
import random
import struct
import time

import numpy as np
import pyarrow as pa
import pytest

from barquarry.llm import sentencepiece_fst
from barquarry.llm.queries import vocabulary

sentencepiece = pytest.importorskip("sentencepiece")


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, kind, body):
    return varint(number << 3 | kind) + (varint(len(body)) + body if kind == 2 else body)


def model_file(path, pieces, kind=1, charsmap=b"", squeeze=True):
    """A model written by hand: pieces (text, score), after the unknown one and the bytes."""
    every = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)] + [(t, s, 1) for t, s in pieces]
    out = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, varint(k))) for t, s, k in every)
    out += field(2, 2, field(3, 0, varint(kind)) + field(35, 0, varint(1)) + field(40, 0, varint(0)) + field(41, 0, varint(2**64 - 1)) + field(42, 0, varint(2**64 - 1)) + field(43, 0, varint(2**64 - 1)))
    out += field(3, 2, field(2, 2, charsmap) * bool(charsmap) + field(3, 0, varint(1)) + field(4, 0, varint(int(squeeze))) + field(5, 0, varint(1)))
    path.write_bytes(out)
    return str(path)


def encoded(fst, texts):
    flat, begin = sentencepiece_fst.encode(pa.array(texts, pa.string()), fst, sentencepiece_fst.ChunkIds(fst))
    return [flat[a:b].tolist() for a, b in zip(begin, begin[1:])]


def odd_texts(n=300, seed=1):
    rng = random.Random(seed)
    signs = "abcdeehlnorst  .,▁éü中文字\U0001f600\t\n0123"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 90))) for _ in range(n)] + ["", " ", "▁", " ▁ a", "a▁b", "hello" * 40]


def test_pair_model_equals_the_library():
    path = vocabulary("piece_bpe_32k.model")
    library, fst = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path)
    texts = odd_texts() + ["the internationalisation of responsibilities " * 4, "supercalifragilisticexpialidocious" * 5]
    for text, ids in zip(texts, encoded(fst, texts)):
        assert ids == library.encode(text), text


def test_unigram_model_equals_the_library(tmp_path):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdehlnorst") for _ in range(rng.randint(1, 5))) for _ in range(300)} | set("abcdehlnorst")
    pieces = [(w, -rng.uniform(1, 12)) for w in sorted(words)] + [("▁" + w, -rng.uniform(1, 12)) for w in sorted(words)] + [("▁", -3.0)]
    path = model_file(tmp_path / "u.model", pieces)
    library, fst = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path)
    texts = odd_texts(seed=2) + ["helloabcdedcba" * 30]
    for text, ids in zip(texts, encoded(fst, texts)):
        assert ids == library.encode(text), text


def test_long_paths_equal_short_ones(monkeypatch):
    fst = sentencepiece_fst.Transducer(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(3)
    chunks = ["▁" + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    ids, counts = fst.encode_chunks(chunks)
    short = np.split(ids, np.cumsum(counts)[:-1])
    for chunk, want in zip(chunks, short):
        assert fst.path_long(np.frombuffer(chunk.encode("utf-32-le"), "<u4").astype(np.int64)) == want.tolist()


def test_long_chunks_take_time_in_proportion():
    fst = sentencepiece_fst.Transducer(vocabulary("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rng = random.Random(7)
    han = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(100_000))
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(50_000))
    for text, most in ((han, 4), (letters, 10), ("x" * 50_000, 10)):
        began = time.process_time()
        ids = encoded(fst, [text])[0]
        assert time.process_time() - began < most
        assert ids == library.encode(text)


def trie(rules):
    """A double array of the rules' keys, and the strings they become, as a model file holds them."""
    values, at = b"", {}
    for new in rules.values():
        at[new] = len(values)
        values += new.encode() + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def children(keys):
        return sorted({k[0] for k in keys if k})

    def place(node, keys, value):
        labels = ([0] if value is not None else []) + children(keys)
        base = 1
        while base in bases or any((base ^ x) in used for x in labels):
            base += 1
        bases.add(base)
        used.update(base ^ x for x in labels)
        units[node] |= (node ^ base if node else base) << 10
        if value is not None:
            units[node] |= 1 << 8
            units[base] = 1 << 31 | value
        for c in children(keys):
            units[base ^ c] = c
            below = [k[1:] for k in keys if k[0] == c]
            place(base ^ c, [k for k in below if k], next((v for k, v in leaves.items() if k == paths[node] + bytes([c])), None) if paths.setdefault(base ^ c, paths[node] + bytes([c])) else None)

    leaves, paths = {k.encode(): at[v] for k, v in rules.items()}, {0: b""}
    place(0, list(leaves), None)
    array = np.zeros(max(units) + 1, "<u4")
    for k, v in units.items():
        array[k] = v
    return struct.pack("<I", array.nbytes) + array.tobytes() + values


def test_normaliser_is_compiled_and_applied_longest_first():
    rules = {"A": "a", "AB": "x", "é": "e", "　": " ", "ﬁ": "fi", "…": "..."}
    assert sentencepiece_fst._rules(trie(rules)) == rules
    fst = sentencepiece_fst.Transducer(vocabulary("piece_bpe_32k.model"))
    fst.rules, fst.rule_starts, fst.rule_longest, fst.squeeze = rules, "".join(sorted({k[0] for k in rules})), 2, True
    assert fst.normalise("AAB é　　ﬁn… ") == "ax e fin..."


def test_model_without_byte_fallback_is_refused(tmp_path):
    body = b"".join(field(1, 2, field(1, 2, t) + field(2, 5, struct.pack("<f", 0.0)) + field(3, 0, varint(k))) for t, k in ((b"<unk>", 2), (b"<s>", 3), (b"</s>", 3), ("▁a".encode(), 1)))
    path = tmp_path / "m.model"
    path.write_bytes(body + field(2, 2, field(3, 0, varint(1))) + field(3, 2, field(3, 0, varint(1))))
    with pytest.raises(ValueError):
        sentencepiece_fst.Transducer(str(path))


def test_pieces_are_found_by_their_hashes_wherever_they_had_to_go():
    fst = sentencepiece_fst.Transducer(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    want = dict(zip(fst.keys.tolist(), fst.ids.tolist()))
    asked = rng.permutation(np.concatenate([fst.keys, rng.integers(0, 2**64, 20_000, dtype=np.uint64), np.zeros(1, np.uint64)]))
    assert fst.find(asked).tolist() == [want.get(h, sentencepiece_fst.NONE) for h in asked.tolist()]
    # hashes that share a place, and one that is 0
    back = pow(int(sentencepiece_fst._C), -1, 1 << 64)
    few = np.array([0, *[(i * back) % 2**64 for i in range(1, 9)], *[((2**64 - 1 - i) * back) % 2**64 for i in range(8)]], np.uint64)
    fst.keys, fst.ids = few, np.arange(len(few))
    fst._place()
    assert fst.find(few).tolist() == list(range(len(few)))
    assert set(fst.find(few + np.uint64(12345)).tolist()) == {sentencepiece_fst.NONE}


def test_neighbours_are_told_apart_once():
    fst = sentencepiece_fst.Transducer(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    a, b = (rng.choice(fst.ids, 3000) for _ in range(2))
    want = fst.apart_pair(a, b).tolist()
    assert 0 < sum(want) < 3000
    seen, plain = [], fst.apart_pair
    fst.apart_pair = lambda x, y: seen.append(len(x)) or plain(x, y)
    chunks = ["▁" + "".join(rng.choice(list("abcdeinorst"), 9)) for _ in range(500)]
    first = fst.encode_chunks(chunks)[0].tolist()
    asked = sum(seen)
    assert fst.encode_chunks(chunks[::-1])[0].tolist() != first and fst.encode_chunks(chunks)[0].tolist() == first
    assert sum(seen) - asked < asked / 50  # pairs that share a place are asked again
    assert fst.stay_apart(a, b).tolist() == fst.stay_apart(a, b).tolist() == want
    del fst.apart_pair
    assert pickle.loads(pickle.dumps(fst)).pairs is None
