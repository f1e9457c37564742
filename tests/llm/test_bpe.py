import hashlib
import random
import sys

import pytest

from factorloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.tokenizer(PATH), tokenizers.Tokenizer.from_file(PATH)


def agree(both, text):
    own, ref = both
    want = ref.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    return got == want and own.decode(got) == ref.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " \n\t", "a", "Don't STOP'LL", "x" * 3000, "ab" * 2000 + " é é", "ΑΣ Σ", "İI", "a\x1cb\x1fc", "<|endoftext|>A<|startoftext|> <|endoftext|", "12345 ³ Ⅷ", "中文字 ﬁ  　x", "###&&&%%% ***", "�́e"])
def test_like_the_library(both, text):
    assert agree(both, text)


def test_random_texts(both):
    r = random.Random(3)
    pools = ["abcdefgh ", "aeiou'stremd ", "0123456789. ", "".join(map(chr, range(0x20, 0x500))), "".join(chr(r.randrange(0x20, 0xD000)) for _ in range(400)), "".join(chr(r.randrange(0x10000, 0x30000)) for _ in range(200)) + " "]
    for k in range(600):
        assert agree(both, "".join(r.choice(pools[k % len(pools)]) for _ in range(r.randrange(1, 80))))


def test_cuts_and_both_merges(both):
    own = both[0]
    s = [own.base[b] for b in b"qzxqjthe"]
    parts = own.split_fragments(s)
    assert [x for p in parts for x in p] == s and len(parts) > 1
    for p, q in zip(parts, parts[1:]):
        assert (p[-1] << 17 | q[0]) not in own.inside
    r = random.Random(5)
    for _ in range(200):
        f = [own.base[r.choice(b"aeinrst")] for _ in range(r.randrange(2, 40))]
        assert own._scan(list(f)) == own._heap(list(f))


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (1, "Hello world", "x"), (None, "a", "z")], "doc_id long, text string, ids string")
    rows = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digests(df, PATH).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (2, 0, nothing, nothing) in rows and (3, 0, nothing, nothing) in rows and len(rows) == 4
    enc = bpe.encode(df, PATH)
    assert bpe.decode(enc, PATH).where("doc_id = 1").first()["text"] == "hello</w> world</w>"
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0


def words(n, seed=9):
    r = random.Random(seed)
    return ["".join(r.choices("aeinrstlodh", k=9)) for _ in range(n)]


def test_pieces_of_runs_are_encoded_once(both, monkeypatch):
    own, calls = both[0], []
    own.release()
    plain = own.encode_word
    monkeypatch.setattr(own, "encode_word", lambda word: calls.append(word) or plain(word))
    text = "Stone, stone. (stone) stone! STONE's stone7 stone,"
    assert own.encode(text) == both[1].encode(text, add_special_tokens=False).ids
    assert sorted(calls) == sorted(set(calls)) and "stone" in calls


def test_what_is_kept_has_the_stated_size(both):
    own = both[0]
    own.release()
    some = list(dict.fromkeys(words(140_000)))
    for word in some:
        own.encode(word)
    # one generation holds them all, and takes no more than it may
    assert len(own.chunks) == len(some) and not own.chunks.older
    held = sys.getsizeof(own.chunks) + sum(sys.getsizeof(k) + sys.getsizeof(v) + 16 for k, v in own.chunks.items())
    assert held <= own.chunks.size <= bpe.RUNS
    for word in words(140_000, 10):
        own.encode(word)
    assert own.chunks.older and own.chunks.size <= bpe.RUNS
    own.release()
