"""Byte-level BPE by a sentencepiece model that is written straight from a rank vocabulary.

Each byte b becomes the character U+0100+b, each vocabulary entry a piece of such characters whose score is minus its
rank, and normalisation is the identity; the library's BPE then merges the pair with the best score, leftmost first,
which is the rank rule. Pre-tokens are encoded one by one; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from .common import map_texts
from .pretokens import splitter

CACHE_ENTRIES = 400_000
KEPT_BYTES = 64
#: Byte b as a character of the model.
SHIFT = {b: 0x100 + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary in order of rank: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    return [token for _, token in pairs]


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(SHIFT)


def serialise(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of a vocabulary; piece ids are the ranks, the unknown piece comes last."""
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=to_chars(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    trainer, normalizer = model.trainer_spec, model.normalizer_spec
    trainer.model_type, trainer.vocab_size, trainer.unk_id = pb.TrainerSpec.BPE, len(tokens) + 1, len(tokens)
    trainer.bos_id = trainer.eos_id = trainer.pad_id = -1
    normalizer.name = "identity"
    normalizer.add_dummy_prefix = normalizer.remove_extra_whitespaces = normalizer.escape_whitespaces = False
    return model.SerializeToString()


def encoder(tokens: list[bytes], model: bytes) -> Callable[[list], list[tuple]]:
    """A function from texts to (ids,): the ids as little-endian unsigned 32-bit integers."""
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    split = splitter()
    # a pre-token that is itself an entry is that entry, also where no chain of merges leads to it
    whole = {t: np.uint32(i).tobytes() for i, t in enumerate(tokens)}
    known: dict[str, bytes] = {}

    def learn(pieces: list[str]) -> None:
        rest = []
        for p in pieces:
            if (ids := whole.get(p.encode())) is not None:
                known[p] = ids
            else:
                rest.append(p)
        for p, ids in zip(rest, processor.encode([to_chars(p.encode()) for p in rest], out_type=int, num_threads=1), strict=True):
            known[p] = np.array(ids, "<u4").tobytes()

    def encode(texts: list) -> list[tuple]:
        cut = [split(t) if t else [] for t in texts]
        missing = set().union(*cut).difference(known)
        if len(known) + len(missing) > CACHE_ENTRIES:
            known.clear()
            missing = set().union(*cut)
        learn(list(missing))
        out = [(b"".join(map(known.__getitem__, pieces)),) for pieces in cut]
        for p in missing:
            if len(p) > KEPT_BYTES:
                del known[p]
        return out

    return encode


def decoder(tokens: list[bytes]) -> Callable[[list], list[tuple]]:
    def decode(rows: list) -> list[tuple]:
        return [(b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) if ids else b"",) for ids in rows]

    return decode


def bpe_encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns of keep, ids) for each row of docs; ids are packed little-endian unsigned 32-bit integers.

    A null text counts as empty and gives no ids. Repeated rows and null ids each give a row of their own; an empty
    table gives an empty result; other columns are ignored. There is no shuffle.
    """
    tokens = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, serialise(tokens)))
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).alias("text"))
    return map_texts(rows, lambda: encoder(*shared.value), "ids binary")


def bpe_decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows of encoded with a column decoded: the bytes of the ids. Null ids decode to no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = encoded.drop("decoded").select("*", F.col(ids_col).alias("__ids"))
    return map_texts(rows, lambda: decoder(shared.value), "decoded binary")
