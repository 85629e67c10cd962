"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is split by the vocabulary's pattern; each distinct piece of a batch is
encoded once by the library and kept in a memo of bounded bytes, so that the library
sees every piece and little is encoded twice. The library takes some thousand pieces at
a time as words of one text; their bytes tell whose ids are whose. Ids are held packed,
four bytes each, and spelled out by tables. Very long texts are split and encoded a
stretch at a time; coder and memo go when the task ends. Tokens are written in the byte alphabet
(one printable character a byte); decoding reverses that table. Token offsets are
kept in bytes and in code points: a token that holds a part of a character covers
that whole character.

Defined results: a null text counts as empty (no tokens, the digests of the empty
string); equal rows are encoded alike and all kept; an empty table gives an empty
result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import sys
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from coinbrook.llm.common import SLICE_BYTES, arrow_step, documents, slices

#: Bytes held by a task's memo; it is emptied beyond that.
MEMO_BYTES = 40 << 20
#: What a memo's entry takes besides its two objects.
ENTRY_BYTES = 100
#: Pieces of a very long text that are encoded at once.
STRETCH = 100_000
#: Ids that are spelled out at once.
SPELLED = 1 << 16


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Spelling:
    """Bytes of each id in one block, so that many ids are spelled out by an index."""

    def __init__(self, of: dict[int, bytes]):
        self.sizes = np.zeros(max(of, default=-1) + 1, np.int64)
        self.sizes[list(of)] = [len(x) for x in of.values()]
        self.ends = np.cumsum(self.sizes)
        self.block = np.frombuffer(b"".join(of[i] for i in sorted(of)), np.uint8)

    def __call__(self, ids: np.ndarray) -> Iterator[bytes]:
        for start in range(0, len(ids), SPELLED):
            some = ids[start : start + SPELLED]
            size = self.sizes[some]
            shift = self.ends[some] - np.cumsum(size)
            yield self.block[np.arange(size.sum()) + np.repeat(shift, size)].tobytes()


class ByteBpe:
    """Encoder and decoder for one file of ranks; made once in each task."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.alphabet = byte_alphabet()
        self.spelling = "".join(self.alphabet)
        written = {token: self.spell(token) for token in ranks}
        # Any split of a token into two known tokens may be merged, in the order of the token's rank.
        merges = [
            (written[token[:i]], written[token[i:]])
            for token, _ in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.model = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.pattern = regex.compile(pattern)
        back = {ord(c): chr(b) for b, c in enumerate(self.alphabet) if ord(c) != b}
        self.token_bytes = {r: written[t].translate(back).encode("latin-1") for t, r in ranks.items()}
        self.decoding = Spelling(self.token_bytes)
        self.numbers = Spelling({r: b"%d," % r for r in ranks.values()})
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def spell(self, data: bytes) -> str:
        """``data`` in the byte alphabet."""
        return codecs.charmap_decode(data, "strict", self.spelling)[0]

    def learn(self, pieces: list[list[str]]) -> None:
        """Puts the ids of all pieces into the memo."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        memo = self.memo
        new = [p for p in dict.fromkeys(chain.from_iterable(pieces)) if p not in memo]
        for start in range(0, len(new), 2_000):
            some = new[start : start + 2_000]
            data = [p.encode() for p in some]
            # Pretokenized words are encoded each by itself.
            found = self.model.encode_batch_fast([[self.spell(d) for d in data]], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(found.ids, np.int32)
            # A piece's tokens spell it, so its last token ends where it does.
            token_ends, piece_ends = np.cumsum(self.decoding.sizes[ids]), np.cumsum([len(d) for d in data])
            last = np.searchsorted(token_ends, piece_ends)
            if len(ids) == 0 or token_ends[-1] != piece_ends[-1] or (token_ends[last] != piece_ends).any():
                raise ValueError("the ranks lack single bytes, so that not every text has ids")
            packed, bounds = ids.tobytes(), [0, *((last + 1) * ids.itemsize).tolist()]
            values = [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            memo.update(zip(some, values, strict=True))
            self.held += sum(map(sys.getsizeof, some)) + sum(map(sys.getsizeof, values)) + ENTRY_BYTES * len(some)

    def packed(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text as 32-bit numbers; special tokens are ordinary text here."""
        if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:
            yield self.packed_long(texts[0])
            return
        split = [self.pattern.findall(t) for t in texts]
        self.learn(split)
        for pieces in split:
            yield np.frombuffer(b"".join(map(self.memo.__getitem__, pieces)), np.int32)

    def packed_long(self, text: str) -> np.ndarray:
        """The same for one very long text, whose pieces are not all held at once."""
        found, ids = (m[0] for m in self.pattern.finditer(text)), bytearray()
        while some := list(islice(found, STRETCH)):
            self.learn([some])
            ids += b"".join(map(self.memo.__getitem__, some))
        return np.frombuffer(ids, np.int32)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text as a list."""
        for ids in self.packed(texts):
            yield ids.tolist()

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: Sequence[int]) -> str:
        """The text; characters whose bytes are spread over tokens are whole again, broken bytes become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, ids: Sequence[int]) -> list[tuple[int, int, int, int]]:
        """For each token its byte span and the span of the characters it touches."""
        data = self.decode_bytes(ids)
        starts = list(accumulate((b & 0xC0 != 0x80 for b in data), initial=0))  # characters begun before each byte
        out, at = [], 0
        for i in ids:
            end = at + len(self.token_bytes[i])
            first = starts[at + 1] - 1 if end > at else starts[at]
            out.append((at, end, first, starts[end]))
            at = end
        return out


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """doc_id, ids and, if asked for, the tokens' byte and character spans, a row for each row of ``df``."""
    path, pat = ranks_path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    spans = [(n, pa.list_(pa.int32())) for n in ("byte_start", "byte_end", "char_start", "char_end")] if offsets else []
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), *spans])

    def run(batches):
        bpe = ByteBpe(path, pat)
        for batch in slices(batches):
            ids = list(bpe.packed(batch.column("text").to_pylist()))
            columns = [batch.column("doc_id"), pa.array(ids, schema.field("ids").type)]
            if offsets:
                each = [bpe.offsets(x.tolist()) for x in ids]
                columns += [pa.array([[s[k] for s in x] for x in each], pa.list_(pa.int32())) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return arrow_step(documents(df), run, "doc_id long, ids array<int>" + "".join(f", {n} array<int>" for n, _ in spans))


def decode(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text from ``encode``'s doc_id and ids (null ids: empty text)."""
    path, pat = ranks_path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(batches):
        bpe = ByteBpe(path, pat)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow_step(df.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and round_trip_ok: every text is encoded, then decoded from its ids, in one pass."""
    path, pat = ranks_path or default_vocabulary()[0], pattern or default_vocabulary()[1]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip_ok", pa.bool_())])

    def run(batches):
        bpe = ByteBpe(path, pat)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            rows: list[list] = [[], [], [], []]
            for text, ids in zip(texts, bpe.packed(texts), strict=True):
                decoded, written = b"".join(bpe.decoding(ids)), hashlib.sha256()
                for numbers in bpe.numbers(ids[:-1]):
                    written.update(numbers)
                # No comma after the last.
                written.update(b"%d" % ids[-1] if len(ids) else b"")
                rows[0].append(len(ids))
                rows[1].append(written.hexdigest())
                rows[2].append(hashlib.sha256(decoded).hexdigest())
                rows[3].append(decoded == text.encode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(rows, list(schema)[1:], strict=True))], schema=schema)

    return arrow_step(documents(df), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip_ok boolean")
