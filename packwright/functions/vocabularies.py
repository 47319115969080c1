"""Tokenizers of one's own: a vocabulary file under a name, in DataFrames, jobs and SQL.

A registration lives in the session it was made in. The file is read once through Spark's
file systems, so it may lie wherever inputs lie, and travels to the executors as a
broadcast of its bytes; an executor needs the public library of its format and no file.
"""

import base64
import binascii
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

SENTENCEPIECE, RANKS, LIBRARY = "sentencepiece", "ranks", "tokenizers"
FORMATS = (SENTENCEPIECE, RANKS, LIBRARY)

# How byte-level vocabularies of ranks cut a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A vocabulary is broadcast whole; a file beyond this is no vocabulary.
MOST_BYTES = 256 << 20

# Ids are Spark's int.
MOST_ID = (1 << 31) - 1

Encode = Callable[[Sequence[str]], Sequence[Sequence[int]]]
Decode = Callable[[Sequence[Sequence[int]]], Sequence[str]]


@dataclass(frozen=True)
class Vocabulary:
    """A registered vocabulary. ``pattern`` belongs to the format of ranks."""

    name: str
    kind: str
    eos_id: int
    content: bytes
    pattern: str = WORD_PATTERN
    window: int | None = None


# By the session's own id, then by name.
_registered: dict[str, dict[str, Vocabulary]] = {}
_SESSION_KEY = "packwright.session.id"


def _of_session(spark: SparkSession) -> dict[str, Vocabulary]:
    key = spark.conf.get(_SESSION_KEY, None)
    if key is None:
        key = uuid.uuid4().hex
        spark.conf.set(_SESSION_KEY, key)
    return _registered.setdefault(key, {})


def registered(spark: SparkSession, name: str) -> Vocabulary | None:
    return _of_session(spark).get(name)


def registered_names(spark: SparkSession) -> list[str]:
    return sorted(_of_session(spark))


def keep(spark: SparkSession, vocabulary: Vocabulary) -> None:
    """Under its name, in place of an earlier one."""
    _of_session(spark)[vocabulary.name] = vocabulary


def forget(spark: SparkSession, name: str) -> None:
    _of_session(spark).pop(name, None)


def read_file(spark: SparkSession, path: str) -> bytes:
    """The bytes of one file of any file system that Spark can read."""
    found = spark.read.format("binaryFile").load(path).select("length", "path").collect()
    if len(found) != 1:
        raise ValueError(f"{path!r} is not one file")
    if found[0].length > MOST_BYTES:
        raise ValueError(f"{path!r} has {found[0].length} bytes; a vocabulary has {MOST_BYTES} at most")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def format_of(path: str, content: bytes) -> str:
    """By what the file holds: JSON with a model, lines of base64 and a rank, or a piece model."""
    head = content.lstrip()[:1]
    if head == b"{":
        return LIBRARY
    first = content.split(b"\n", 1)[0].split()
    if len(first) == 2 and first[1].isdigit():
        try:
            base64.b64decode(first[0], validate=True)
            return RANKS
        except binascii.Error:
            pass
    if content[:1] == b"\x0a":
        return SENTENCEPIECE
    raise ValueError(f"{path!r} is no vocabulary of a known format ({', '.join(FORMATS)})")


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank. Every single byte has to be there."""
    ranks: dict[bytes, int] = {}
    for number, line in enumerate(content.splitlines(), 1):
        fields = line.split()
        if not fields:
            continue
        if len(fields) != 2 or not fields[1].isdigit():
            raise ValueError(f"line {number} of a vocabulary is not a token and its rank")
        token, rank = base64.b64decode(fields[0]), int(fields[1])
        if token in ranks:
            raise ValueError(f"line {number} of a vocabulary repeats a token")
        ranks[token] = rank
    if len(set(ranks.values())) != len(ranks):
        raise ValueError("two tokens of a vocabulary have one rank")
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"a vocabulary lacks {len(missing)} of the 256 bytes, first 0x{missing[0]:02X}")
    return ranks


def open_vocabulary(kind: str, content: bytes, pattern: str) -> tuple[Encode, Decode, int]:
    """Functions of lists of texts and of lists of ids, and the number of ids.

    Strings of special tokens inside a text are plain text in every format, and none are
    added around it.
    """
    if kind == SENTENCEPIECE:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        return (
            lambda texts: model.encode(list(texts), num_threads=1),
            lambda rows: model.decode(list(rows), num_threads=1),
            model.vocab_size(),
        )
    if kind == RANKS:
        import tiktoken

        ranks = parse_ranks(content)
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return (
            lambda texts: [coder.encode_ordinary(t) for t in texts],
            lambda rows: [coder.decode(r) for r in rows],
            max(ranks.values()) + 1,
        )
    if kind == LIBRARY:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(content.decode())
        whole.encode_special_tokens = True
        whole.no_truncation()
        whole.no_padding()
        return (
            lambda texts: [e.ids for e in whole.encode_batch(list(texts), add_special_tokens=False)],
            lambda rows: whole.decode_batch([list(r) for r in rows], skip_special_tokens=False),
            whole.get_vocab_size(with_added_tokens=True),
        )
    raise ValueError(f"unknown vocabulary format {kind!r}; known: {', '.join(FORMATS)}")


def check_name(name: str) -> str:
    """Names are parts of SQL function names."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} is no name for a tokenizer: letters, digits and underscores, no digit first")
    return name
