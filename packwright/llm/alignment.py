"""Alignment of the tokens of two tokenizers by their bytes.

Tokens of one text by both tokenizers are ranges of the same bytes. Two tokens are linked
where their ranges overlap, and what is connected by links is a group. Every token points
to the farthest-right token that overlaps it; doubling the pointers (each takes over the
pointer of what it points to) brings all tokens of a group to its last one in as many
rounds as the longest chain has binary digits. All texts of a slice are done at once.

How often two ids are linked in the corpus is counted from the distinct id pairs of each
slice, and comes back to the slice it was counted in; a text keeps its links as places in
the slice's list of pairs, so that neither links nor texts are exchanged one by one.
"""

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.pieces import BYTE, MARK, Spec, parse_model
from packwright.llm.words import slices
from packwright.session import stage


@dataclass(frozen=True)
class Params:
    """``slice_bytes`` of text, or one text if it is longer, are aligned at once."""

    slice_bytes: int = 2 << 20
    threads: int = 2


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by letter.

    Printable Latin-1 stands for itself; the other bytes, in order, for what follows U+00FF.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_spellings(vocabulary: bytes) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary file."""
    letters = byte_letters()
    content = json.loads(vocabulary)
    ids = dict(content["model"]["vocab"])
    special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
    spelled = [b""] * (1 + max([*ids.values(), *special.values()]))
    for text, number in ids.items():
        known = text not in special and all(c in letters for c in text)
        spelled[number] = bytes(letters[c] for c in text) if known else text.encode()
    return spelled


def piece_spellings(spec: Spec) -> list[bytes]:
    """Bytes of each id of a piece model; the marker is a blank, a byte piece its byte."""
    return [
        bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(MARK, " ").encode() for text, _, kind in spec.pieces
    ]


class ByteLevel:
    """A byte-level vocabulary file's encoder.

    The library that reads the file spends most of its time on the pattern that cuts words.
    Where the file says just what the other library does (that pattern, merges in order of
    their ids), texts of letters that both patterns are tested to cut alike go there.
    """

    # The pattern of byte-level vocabularies.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    RARE = re.compile("[^\x00-\u024f]")

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.encode_special_tokens = True
        self.spellings = byte_level_spellings(vocabulary)
        self.fast = self._fast(json.loads(vocabulary))

    def _fast(self, content: dict):
        import tiktoken

        model, cut = content["model"], content.get("pre_tokenizer") or {}
        ids = model.get("vocab") or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or ()]
        merged = [ids[a + b] for a, b in pairs]
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges")]
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        letters = byte_letters()
        if content.get("normalizer") or any(odd) or not usual or sorted(set(merged)) != merged or not letters.keys() <= ids.keys():
            return None
        ranks = {self.spellings[i]: i for i in [*(ids[c] for c in letters), *merged]}
        return tiktoken.Encoding("byte-level", pat_str=self.WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        quick = [self.fast is not None and not self.RARE.search(t) for t in texts]
        slow = iter(self.tokenizer.encode_batch_fast([t for t, q in zip(texts, quick) if not q], add_special_tokens=False))
        return [
            np.asarray(self.fast.encode_to_numpy(t, disallowed_special=()) if q else next(slow).ids, dtype=np.int64)
            for t, q in zip(texts, quick)
        ]


def tokens_until(ends: np.ndarray, n_bytes: int) -> np.ndarray:
    """For each number of bytes, how many tokens have ended before: the token that holds the last."""
    flags = np.zeros(n_bytes + 1, dtype=np.int64)
    flags[ends] = 1
    return np.cumsum(flags) - flags


def farthest(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Where each token points: first those of A, then those of B, by where they end.

    Both tile the same bytes. The farthest-right token that overlaps a token is the one of
    the other side that holds its last byte. Where both end there, it is B's, the last of
    its group, which points to itself.
    """
    n, n_bytes = len(end_a), int(end_a[-1])
    to_b = tokens_until(end_b, n_bytes)[end_a]
    to_a = tokens_until(end_a, n_bytes)[end_b]
    last = end_a[to_a] == end_b
    return np.concatenate((n + to_b, np.where(last, n + np.arange(len(end_b)), to_a)))


def terminals(pointers: np.ndarray) -> np.ndarray:
    """The token each token comes to in the end, by pointer doubling."""
    while True:
        following = pointers[pointers]
        if np.array_equal(following, pointers):
            return pointers
        pointers = following


def linked_tokens(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of A's and B's tokens of every link: one for each piece between neighbouring ends."""
    n_bytes = int(end_a[-1])
    is_end = np.zeros(n_bytes + 1, dtype=bool)
    is_end[end_a] = is_end[end_b] = True
    ends = np.flatnonzero(is_end)
    return tokens_until(end_a, n_bytes)[ends], tokens_until(end_b, n_bytes)[ends]


class Spelled:
    """A vocabulary's bytes by id, their lengths, and ids as decimals before each separator."""

    # Before the next token: of the same side, of the other side, of the next group, none.
    SEPARATORS = (b",", b"|", b";", b"")

    def __init__(self, spellings: list[bytes]):
        self.spellings = spellings
        self.lengths = np.array([len(s) for s in spellings], dtype=np.int64)

    def decimals(self) -> list[bytes]:
        return [b"%d%s" % (i, s) for s in self.SEPARATORS for i in range(len(self.spellings))]


def group_lines(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc_a, doc_b, decimals: list[bytes], n_ids: tuple[int, int]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text. Groups are numbered along all texts; ``doc_a`` and
    ``doc_b`` say where the tokens of each text begin and, at last, end."""
    n_groups = int(group_a[-1]) + 1
    until_a = np.searchsorted(group_a, np.arange(n_groups), side="right")
    until_b = np.concatenate(([0], np.searchsorted(group_b, np.arange(n_groups), side="right")))
    at_a = np.arange(len(a)) + until_b[group_a]
    at_b = np.arange(len(b)) + until_a[group_b]
    # Which separator follows: within a side, at the end of A's part, at the end of a group.
    next_a = np.append(group_a[1:] != group_a[:-1], True)
    next_b = np.append(group_b[1:] != group_b[:-1], True)
    code = np.empty(len(a) + len(b), dtype=np.int64)
    code[at_a] = a + n_ids[0] * next_a
    code[at_b] = 4 * n_ids[0] + b + n_ids[1] * (2 * next_b)
    firsts = np.asarray(doc_a) + np.asarray(doc_b)
    lasts = firsts[1:][np.diff(firsts) > 0] - 1
    code[lasts] += n_ids[1]
    words = [decimals[c] for c in code.tolist()]
    return [b"".join(words[x:y]) for x, y in zip(firsts[:-1].tolist(), firsts[1:].tolist())]


class Aligner:
    """One task's tokenizers."""

    def __init__(self, vocabulary: bytes, model: bytes, threads: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.byte_level = ByteLevel(vocabulary)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a, self.b = Spelled(self.byte_level.spellings), Spelled(piece_spellings(parse_model(model)))
        self.decimals = self.a.decimals() + self.b.decimals()
        self.threads = threads

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[list[int]]]:
        """Ids of both; none where the bytes of either are not those of a blank and the text."""
        there = [i for i, t in enumerate(texts) if t]
        lines = [" " + texts[i] for i in there]
        rows_a: list[np.ndarray] = [np.zeros(0, dtype=np.int64) for _ in texts]
        rows_b: list[list[int]] = [[] for _ in texts]
        if not there:
            return rows_a, rows_b
        found_a = self.byte_level.encode(lines)
        found_b = self.pieces.encode([texts[i] for i in there], num_threads=self.threads)
        spelled_a, spelled_b = self.a.spellings, self.b.spellings
        for i, line, a, b in zip(there, lines, found_a, found_b):
            data = line.encode()
            if b"".join([spelled_a[x] for x in a.tolist()]) == data and b"".join([spelled_b[x] for x in b]) == data:
                rows_a[i], rows_b[i] = a, b
        return rows_a, rows_b

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """Per text: counts, digest of its groups, and its distinct links as places in ``pairs``."""
        rows_a, rows_b = self.tokens(texts)
        sizes_a, sizes_b = [np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) for rows in (rows_a, rows_b)]
        doc_a, doc_b = [np.concatenate(([0], np.cumsum(s))) for s in (sizes_a, sizes_b)]
        a = np.concatenate(rows_a)
        b = np.fromiter(chain.from_iterable(rows_b), dtype=np.int64, count=int(sizes_b.sum()))
        none = np.zeros(len(texts), dtype=np.int64)
        if not len(a):
            empty = np.zeros(0, dtype=np.int64)
            return {"n_a": none, "n_b": none, "n_groups": none, "n_links": none, "lines": [None] * len(texts),
                    "pairs": empty, "totals": empty, "first": np.zeros(len(texts) + 1, dtype=np.int64), "at": empty, "times": empty}
        end_a, end_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        label = terminals(farthest(end_a, end_b))
        is_last = np.zeros(len(b), dtype=np.int64)
        is_last[label[len(a) :] - len(a)] = 1
        number = np.cumsum(is_last) - 1
        group_a, group_b = number[label[: len(a)] - len(a)], number[label[len(a) :] - len(a)]
        lines = group_lines(a, b, group_a, group_b, doc_a, doc_b, self.decimals, (len(self.a.spellings), len(self.b.spellings)))
        from_a, from_b = linked_tokens(end_a, end_b)
        doc_of_link = np.searchsorted(doc_a, from_a, side="right") - 1
        pairs, place = np.unique(a[from_a] << 32 | b[from_b], return_inverse=True)
        in_doc, times = np.unique(doc_of_link * len(pairs) + place, return_counts=True)
        owner = in_doc // len(pairs)
        groups_until = np.concatenate((group_a, [group_a[-1] + 1]))[doc_a]
        return {
            "n_a": sizes_a,
            "n_b": sizes_b,
            "n_groups": np.diff(groups_until),
            "n_links": np.bincount(doc_of_link, minlength=len(texts)),
            "lines": [line if n else None for line, n in zip(lines, sizes_a.tolist())],
            "pairs": pairs,
            "totals": np.bincount(place, minlength=len(pairs)),
            "first": np.searchsorted(owner, np.arange(len(texts) + 1)),
            "at": in_doc % len(pairs),
            "times": times,
        }


COUNTED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned_slices(docs: DataFrame, vocabulary: bytes, model: bytes, params: Params) -> DataFrame:
    """One row per row of ``docs``, with its links as ``at`` and ``times``, and one per slice
    (``is_slice``) with the list of its id ``pairs`` and how often each is linked there."""
    id_type = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    slice_bytes, threads = params.slice_bytes, params.threads

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, number = Aligner(*shared.value, threads), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, stop in slices([t and t.encode() for t in texts], slice_bytes):
                found, n, number = aligner.align(texts[begin:stop]), stop - begin, number + 1
                numbers = lambda values, kind=pa.int64(): pa.array(np.append(values, 0), kind)
                lists = lambda first, values, kind: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
                of_docs = np.append(found["first"], found["first"][-1])
                of_slice = np.append(np.zeros(n + 1, dtype=np.int64), len(found["pairs"]))
                hashes = [sha256(line).hexdigest() if line is not None else "" for line in found["lines"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0).slice(begin, n), pa.nulls(1, batch.column(0).type)]),
                        pa.array([number] * (n + 1), pa.int64()),
                        pa.array([False] * n + [True], pa.bool_()),
                        *(numbers(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")),
                        pa.array([*hashes, ""], pa.string()),
                        lists(of_docs, found["at"], pa.int32()),
                        lists(of_docs, found["times"], pa.int32()),
                        lists(of_slice, found["pairs"], pa.int64()),
                        lists(of_slice, found["totals"], pa.int64()),
                    ],
                    names=["doc_id", "slice", "is_slice", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times", "pairs", "totals"],
                )

    schema = f"doc_id {id_type}, slice long, is_slice boolean, {COUNTED}, at array<int>, times array<int>, pairs array<long>, totals array<long>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each, schema)


def pair_counts(slices_: DataFrame) -> DataFrame:
    """``pair, n, best``: links of two ids in all texts, and whether no other id of A has more
    with the same id of B."""
    rows = slices_.select(F.explode(F.arrays_zip("pairs", "totals")).alias("p"))
    counts = stage(rows.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.totals").alias("n")), "pair-counts")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("highest"))
    return counts.withColumn("b", of_b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def add_up(texts: pa.Table, counted: pa.Table) -> pa.Table:
    """A slice's texts and its counted pairs to the texts with their sums."""
    order = np.argsort(counted.column("place").to_numpy())
    n = counted.column("n").to_numpy()[order]
    best = counted.column("best").to_numpy(zero_copy_only=False).astype(np.int64)[order]
    at = texts.column("at").combine_chunks()
    place, times = at.flatten().to_numpy(), texts.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(np.array(at.value_lengths(), dtype=np.int64))))
    sums = lambda values: pa.array(np.diff(np.concatenate(([0], np.cumsum(values)))[ends]))
    kept = texts.drop_columns(["slice", "at", "times"])
    return kept.append_column("n_best", sums(best[place] * times)).append_column("count_sum", sums(n[place] * times))


def align(docs: DataFrame, vocabulary: bytes, model: bytes, params: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A is the byte-level vocabulary file's tokens of a blank and the text, B the piece model's
    of the text, before which it puts a blank itself. Strings of special tokens are plain
    text. Null and empty texts, and those whose bytes either tokenizer changes, have no
    tokens: all numbers are 0 and the digest is an empty string. Repeated rows and ids and
    null ids are rows like others, and further columns are left alone.
    """
    rows = stage(aligned_slices(docs, vocabulary, model, params), "aligned")
    of_slices = rows.where("is_slice").select(F.col("slice").alias("part"), "pairs", "totals")
    placed = of_slices.select("part", F.posexplode("pairs").alias("place", "pair"))
    counted = placed.join(pair_counts(of_slices), "pair").select("part", "place", "n", "best")
    texts = rows.where(~F.col("is_slice")).select("doc_id", "slice", *(c.split()[0] for c in COUNTED.split(", ")), "at", "times")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {COUNTED}, n_best long, count_sum long"
    return texts.groupBy("slice").cogroup(counted.groupBy("part")).applyInArrow(add_up, schema)
