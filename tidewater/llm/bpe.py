"""Operator 6: byte-level BPE by sentencepiece, from a vocabulary of ranks.

A sentencepiece model is serialised straight from the ranks: each token's bytes are mapped to one character
each (printable bytes to themselves, the others to code points from 256 on), its score is the negative rank,
and normalisation is the identity. Sentencepiece merges the adjacent pair with the best score, leftmost
first, which is what merging by lowest rank does. Texts are cut into pre-tokens by the pattern; each is
encoded for itself; a pre-token that is a token as a whole is that token. Decoding maps ids back to bytes.

Tasks stream batches of texts; the different pre-tokens of a batch are encoded in one call, and their ids are
kept for later ones in a table of bounded size. The model (a few MB, as large as the vocabulary) is broadcast.

Defined cases: null and empty texts have no tokens and decode to nothing; white space, control characters
and very long texts are encoded whole; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text

#: Pre-tokens whose ids a task keeps, and pre-tokens that are looked up together.
KEPT, TOGETHER = 400_000, 100_000


def byte_characters() -> list[str]:
    """A character for each byte: itself where printable and not a space, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 token and rank a line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pre-token pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model: the tokens by rank, then the unknown piece."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    to_char = byte_characters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        piece = model.pieces.add()
        piece.piece, piece.score = "".join(to_char[b] for b in token), -float(rank)
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    t, n = model.trainer_spec, model.normalizer_spec
    t.model_type, t.vocab_size, t.unk_id = pb.TrainerSpec.BPE, len(model.pieces), len(tokens)
    t.bos_id = t.eos_id = t.pad_id = -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str) -> None:
        import regex
        from sentencepiece import SentencePieceProcessor

        self.find = regex.compile(pattern).findall
        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.processor = SentencePieceProcessor(model_proto=model)
        self.table = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        mapped = [b.decode("latin-1").translate(self.table) for b in raw]
        for p, b, ids in zip(new, raw, self.processor.encode(mapped, num_threads=1), strict=True):
            one = self.whole.get(b)
            ids = ids if one is None else [one]
            self.known[p] = b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """encode() of every text. The new pre-tokens of about ``TOGETHER`` are learnt in one call."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.find(text))
            size += len(held[-1])
            if size >= TOGETHER:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, found: list[list[str]]) -> Iterator[bytes]:
        for parts in [found] if sum(map(len, found)) <= KEPT else [[f] for f in found]:
            need = set().union(*parts)
            new = need - self.known.keys()
            if len(self.known) + len(new) > KEPT:
                self.known.clear()
                new = need
            self._learn(list(new))
            for f in parts:
                yield b"".join(map(self.known.__getitem__, f))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def _codecs(docs: DataFrame, vocabulary: str, pattern: str):
    """A function that gives the codec of the Python worker it runs in."""
    small_batches(docs.sparkSession)
    tokens = read_ranks(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((tokens, model_bytes(tokens), pattern))
    made: list[Codec] = []

    def codec() -> Codec:
        if not made:
            made.append(Codec(*sent.value))
        return made[0]

    return codec


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs; with ``ids`` also token_ids (ARRAY<INT>)."""
    codec = _codecs(docs, vocabulary, pattern)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec()
        for texts in batches:
            rows, kept = [], []
            for found in c.encode_all(texts):
                rows.append((len(found) // 4, hashlib.sha256(found).hexdigest(), hashlib.sha256(c.decode(found)).hexdigest()))
                if ids:
                    kept.append(np.frombuffer(found, "<i4"))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield out.assign(token_ids=pd.Series(kept, dtype=object)) if ids else out

    udf = F.pandas_udf(run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids)
    return docs.select("doc_id", udf(whole_text()).alias("r")).select("doc_id", "r.*")


def encode(docs: DataFrame, vocabulary: str, pattern: str, into: str = "token_ids") -> DataFrame:
    """docs with the ids of text as ARRAY<INT>."""
    codec = _codecs(docs, vocabulary, pattern)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec()
        for texts in batches:
            yield pd.Series([memoryview(ids).cast("i").tolist() for ids in c.encode_all(texts)])

    return docs.withColumn(into, F.pandas_udf(run, "array<int>")(whole_text()))


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "token_ids", into: str = "text") -> DataFrame:
    """encoded with the text of its ids."""
    codec = _codecs(encoded, vocabulary, pattern)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec()
        for rows in batches:
            yield pd.Series([b"".join(c.tokens[i] for i in r).decode("utf-8", "replace") for r in rows])

    return encoded.withColumn(into, F.pandas_udf(run, "string")(F.col(ids)))
