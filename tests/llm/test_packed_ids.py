"""Pieces go through the library many at a time, and ids are spelled out by tables."""

import base64

import numpy as np
import pytest

from coinbrook.llm import bpe


class Counting:
    """The library's tokenizer, with a count of the results that it makes."""

    def __init__(self, model):
        self.model, self.results = model, 0

    def encode_batch_fast(self, *args, **more):
        found = self.model.encode_batch_fast(*args, **more)
        self.results += len(found)
        return found


@pytest.fixture(scope="module")
def own():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_results_are_not_made_piece_by_piece(own):
    coder = bpe.ByteBpe(*bpe.default_vocabulary())
    coder.model = Counting(coder.model)
    texts = [" ".join(f"{chr(97 + i % 26)}{'né漢'[i % 3]}{k}w{i * 7919 % 10007}" for i in range(3000)) for k in range(2)] + ["", "\n \t", "<|endoftext|>"]
    assert list(coder.encode(texts)) == [own.encode_ordinary(t) for t in texts]
    pieces = {p for t in texts for p in coder.pattern.findall(t)}
    assert coder.model.results <= len(pieces) // 1000


def test_very_long_text(own):
    coder = bpe.ByteBpe(*bpe.default_vocabulary())
    text = "".join(f"{i} é{'xyz'[i % 3]}, " for i in range(200_000))
    (ids,) = coder.packed([text])
    assert ids.tolist() == own.encode_ordinary(text)
    assert b"".join(coder.decoding(ids)) == text.encode()
    assert b"".join(coder.numbers(ids)) == b"".join(b"%d," % i for i in ids)
    assert list(coder.decoding(np.zeros(0, np.int32))) == []


def test_ranks_without_a_byte_are_refused(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate((b"a", b"b", b"ab"))))
    coder = bpe.ByteBpe(str(path), bpe.default_vocabulary()[1])
    assert list(coder.encode(["abba"])) == [[2, 1, 0]]
    with pytest.raises(ValueError, match="single bytes"):
        list(coder.encode(["abc"]))
