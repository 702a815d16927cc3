import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from brookwell.llm import bpe

from .helpers import corpus, table


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.ByteBPE(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library(pair):
    own, library = pair
    rng = random.Random(3)
    texts = ["", "a" * 5000, " " * 500, "\n\n  x", "aé" * 300, "Ünï😀😀", "'s 't", "<|endoftext|>", "abcabcab" * 40]
    texts += ["".join(rng.choice("abcdeé ßt 1\n\t　😀.'s") for _ in range(rng.randrange(300))) for _ in range(300)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(60, 2000))) for _ in range(60)]
    assert own.encode(texts) == [library.encode_ordinary(t) for t in texts]
    assert all(own.decode(ids) == t.encode() for ids, t in zip(own.encode(texts), texts, strict=True))


def test_small_vocabulary_against_plain_merging():
    """Ranks whose merges make pairs of lesser rank: leftmost-least first, as by hand."""
    rng = random.Random(5)
    for _ in range(60):
        ranks = {bytes([i]): i for i in range(256)}
        while len(ranks) < 290:
            b = bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 6)))
            ranks.setdefault(b, len(ranks))
        own = bpe.ByteBPE(ranks, r".+")

        def plain(data, ranks=ranks):
            parts = [bytes([c]) for c in data]
            while len(parts) > 1:
                least, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if least == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]

        for n in (3, 20, 60, 150):
            data = bytes(rng.choice(b"abc") for _ in range(n))
            assert own._matrix([data])[0] == plain(data)
            assert own._long(data) == plain(data)


def test_table(spark, pair):
    rows = corpus()
    found = {r.doc_id: r for r in bpe.encode_documents(table(spark, rows), output="digests").collect()}
    for doc_id, text, *_ in rows:
        ids = pair[1].encode_ordinary(text or "")
        r = found[doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    coded = bpe.encode_documents(table(spark, rows))
    assert coded.count() == len(rows)
    back = {r.doc_id: bytes(r.text_bytes) for r in bpe.decode_documents(coded).collect()}
    assert all(back[i] == (t or "").encode() for i, t, *_ in rows)
    assert bpe.encode_documents(table(spark, [])).collect() == []
