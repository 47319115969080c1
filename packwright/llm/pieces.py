"""SentencePiece models on the tokenizers library.

The model protobuf is parsed here; normaliser, metaspace marker, scores or merges, and
byte fallback are rebuilt. Whole texts are encoded many at a time on several threads, their
ids are compared with those of the original library on the given model (``parity``), and
decoded again by the rebuilt decoder.
"""

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from packwright.llm.words import slices

MARK = "▁"

# Numbers of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

# Text that is encoded at once: tokens take a hundred times the room of their letters for a while.
BYTES_AT_ONCE = 1 << 18

ENCODED = "struct<ids:array<int>,parity:boolean,decoded:string>"


@dataclass(frozen=True)
class Spec:
    """What a model file says."""

    kind: int
    pieces: tuple[tuple[str, float, int], ...]
    unk_id: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    strip_blanks: bool
    escape_blanks: bool


def fields_of(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            size, at = varint(at)
            value, at = message[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = message[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} in a model file")
        yield number, value


def parse_model(model: bytes) -> Spec:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields_of(model):
        if number == 1:
            piece = dict(fields_of(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer |= dict(fields_of(value))
        elif number == 3:
            normalizer |= dict(fields_of(value))
    unknown = [i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN]
    return Spec(
        kind=trainer.get(3, UNIGRAM),
        pieces=tuple(pieces),
        unk_id=unknown[0],
        byte_fallback=bool(trainer.get(35, 0)),
        charsmap=normalizer.get(2, b""),
        dummy_prefix=bool(normalizer.get(3, 1)),
        strip_blanks=bool(normalizer.get(4, 1)),
        escape_blanks=bool(normalizer.get(5, 1)),
    )


def _model(spec: Spec):
    from tokenizers import models

    if spec.kind == UNIGRAM:
        return models.Unigram([(text, score) for text, score, _ in spec.pieces], spec.unk_id, spec.byte_fallback)
    if spec.kind != BPE:
        raise ValueError(f"model type {spec.kind} is not supported")
    ids = {text: i for i, (text, _, _) in enumerate(spec.pieces)}
    plain = {text for text, _, kind in spec.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    merges = []
    for text, score, kind in spec.pieces:
        if kind not in (NORMAL, USER_DEFINED):
            continue
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in plain and right in plain:
                merges.append((-score, ids[left], ids[right], left, right))
    merges.sort()
    return models.BPE(
        ids,
        [(left, right) for *_, left, right in merges],
        unk_token=spec.pieces[spec.unk_id][0],
        fuse_unk=True,
        byte_fallback=spec.byte_fallback,
    )


def build(spec: Spec):
    """The whole tokenizer: normaliser, model, decoder."""
    from tokenizers import Regex, Tokenizer, decoders, normalizers

    tokenizer = Tokenizer(_model(spec))
    steps = []
    if spec.charsmap:
        steps.append(normalizers.Precompiled(spec.charsmap))
    if spec.strip_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if spec.escape_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if spec.dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(undo)
    return tokenizer


def build_decoder(spec: Spec):
    """The decoder alone, over pieces that are spelled with blanks instead of markers.

    It spares a replacement per id. Where two pieces would be spelled alike, it is the
    decoder of the whole tokenizer.
    """
    from tokenizers import Tokenizer, decoders, models

    spelled = {text.replace(MARK, " "): i for i, (text, _, _) in enumerate(spec.pieces)}
    if len(spelled) < len(spec.pieces):
        return build(spec)
    tokenizer = Tokenizer(models.WordLevel(spelled, spec.pieces[spec.unk_id][0]))
    undo = [decoders.ByteFallback(), decoders.Fuse()]
    if spec.dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(undo)
    return tokenizer


class Encoder:
    """One task's encoder: the rebuilt tokenizer, its decoder, and the original library."""

    def __init__(self, model: bytes, threads: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import Tokenizer

        self.spec = parse_model(model)
        self.tokenizer, self.decoder = build(self.spec), build_decoder(self.spec)
        self.bare = Tokenizer(self.tokenizer.model)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=model)

    def normalize(self, text: str) -> str:
        """Without character maps and without stripping, blanks only change their letter."""
        spec = self.spec
        if spec.charsmap or spec.strip_blanks or not spec.escape_blanks:
            return self.tokenizer.normalizer.normalize_str(text)
        return ((MARK if spec.dummy_prefix else "") + text.replace(" ", MARK)) if text else ""

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of each text, and whether the original library gives the same for the whole text."""
        if not texts:
            return [], []
        normal = [self.normalize(t) for t in texts]
        ids = [e.ids for e in self.bare.encode_batch_fast(normal, add_special_tokens=False)]
        # Threads of one call each would leave memory behind; the tokenizers' own stay.
        theirs = self.original.encode(texts, num_threads=1)
        return ids, [a == b for a, b in zip(ids, theirs)]

    def decode(self, rows: list[list[int]]) -> list[str]:
        """The texts of ids, by the rebuilt decoder."""
        return self.decoder.decode_batch(rows, skip_special_tokens=False) if rows else []


def int_lists(rows: list[list[int] | None]) -> pa.Array:
    """Lists as one array of numbers and their offsets."""
    sizes = np.fromiter((len(r or ()) for r in rows), dtype=np.int32, count=len(rows))
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    values = np.fromiter(chain.from_iterable(r or () for r in rows), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([r is None for r in rows], pa.bool_()))


def ranges(batch: pa.Array) -> tuple[list[int], list[int]]:
    """Begins and lengths of slices of a bounded number of bytes."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch), 0).to_pylist()
    found = [(begin, stop - begin) for begin, stop in slices([range(n) for n in sizes], BYTES_AT_ONCE)]
    return [b for b, _ in found], [n for _, n in found]


def encoded(encoder: Encoder, batch: pa.Array) -> pa.Array:
    """Texts to structs of ids, parity and decoded text."""
    texts = batch.to_pylist()
    ids, same = encoder.encode([t for t in texts if t is not None])
    read = iter(zip(ids, same, encoder.decode(ids)))
    rows = [(None, None, None) if t is None else next(read) for t in texts]
    columns = [int_lists([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.string())]
    return pa.StructArray.from_arrays(columns, ["ids", "parity", "decoded"], mask=pa.array([t is None for t in texts], pa.bool_()))


def tokenized(spark: SparkSession, text: Column, model: bytes, threads: int = 2) -> Column:
    """Ids of a whole text by the rebuilt tokenizer, whether the original library gives the
    same, and the decoded ids. Null stays null; an empty text has no ids and decodes to itself."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value, threads)
        for batch in batches:
            # A slice is numbers in arrays before the next is read.
            done = [encoded(encoder, part) for part in map(batch.slice, *ranges(batch))]
            yield pa.concat_arrays(done or [encoded(encoder, batch)])

    return F.arrow_udf(run, ENCODED)(text)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as handle:
        return handle.read()
