"""Laying examples end to end and cutting them into blocks of one length."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.integers import div
from packwright.functions.text import n_tokens
from packwright.operators.offsets import running_offsets
from packwright.session import stage

# Tokens in a block.
CONTEXT_LENGTH = 8192
SUBSET = ("data_type", "subset_name")

# Blocks that follow each other go to the same task up to this many tokens, so a task
# that writes them writes few, large files per subset. Raise it with the data.
TOKENS_PER_RUN = 1 << 23


def token_offsets(
    examples: DataFrame, groups: Sequence[str] = SUBSET, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Where each example starts in its subset's stream of tokens. Empty ones take no place.

    Lengths are written once, as they are read twice and cost a tokenization each time.
    """
    sized = examples.select(*groups, *keys, n_tokens(F.col("token_ids")).alias("n"))
    return running_offsets(stage(sized, "lengths").where("n > 0"), groups, keys, "n")


def cut_pieces(
    placed: DataFrame,
    groups: Sequence[str],
    context_length: int,
    last_block: Column,
    example: Sequence[str] = (),
) -> DataFrame:
    """One row per block an example reaches into, with its slice of ids and mask.

    ``example`` names columns that go along with each slice: the keys it belongs to.

    ``placed`` has ``token_ids``, ``start``, ``n`` and either a ``tgt_mask`` array or
    one ``is_target`` flag for the whole row; a flag stays a flag until the block is
    put together, which halves what the shuffle carries.
    """
    length = F.lit(context_length).cast("bigint")
    start, n = F.col("start"), F.col("n")
    first_block = div(start, length)
    end_block = F.least(div(start + n - 1, length), last_block)
    reach = F.when(first_block <= end_block, F.sequence(first_block, end_block))
    masks = "tgt_mask" in placed.columns
    reached = placed.select(
        *groups,
        "token_ids",
        "tgt_mask" if masks else "is_target",
        "start",
        "n",
        *example,
        F.explode(reach).alias("block_idx"),
    )
    first = F.greatest(F.col("block_idx") * length - start, F.lit(0))
    last = F.least((F.col("block_idx") + 1) * length - start, n)
    begin, count = (first + 1).cast("int"), (last - first).cast("int")
    part = F.slice("tgt_mask", begin, count) if masks else F.col("is_target").cast("int")
    return reached.select(
        *groups,
        "block_idx",
        F.struct(
            (start + first).alias("at"),
            F.slice("token_ids", begin, count).alias("ids"),
            part.alias("mask"),
            *example,
        ).alias("piece"),
    )


def join_pieces(
    pieces: DataFrame,
    groups: Sequence[str],
    context_length: int,
    tokens_per_run: int = TOKENS_PER_RUN,
    whole: bool = True,
) -> DataFrame:
    """Blocks from their pieces. A block's pieces hold at most one block of tokens.

    With ``whole`` a block of another length is an error: two rows of one key would both
    be put there.

    Pieces are exchanged by run of blocks, which also puts all pieces of a block
    together: a write by subset needs no further exchange.

    If the pieces came with the keys of their example, the blocks get ``boundaries``: in
    order, the ``start`` and ``length`` of each example's part of the block and its keys.
    """
    fields = pieces.schema["piece"].dataType
    kind = fields["mask"].dataType.typeName()
    example = [name for name in fields.names if name not in ("at", "ids", "mask")]
    run = div(F.col("block_idx"), max(1, tokens_per_run // context_length))
    placed = pieces.withColumn("_run", run).repartition(*groups, "_run")
    blocks = placed.groupBy(*groups, "_run", "block_idx").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces")
    )
    masks = F.transform(
        "pieces",
        lambda p: p["mask"] if kind == "array" else F.array_repeat(p["mask"], F.size(p["ids"])),
    )
    ids = F.flatten(F.transform("pieces", lambda p: p["ids"]))
    if whole:
        problem = F.raise_error(F.lit("a block has not its length: keys are not unique")).cast("array<int>")
        ids = F.when(F.size(ids) == context_length, ids).otherwise(problem)
    return blocks.select(
        *groups,
        "block_idx",
        ids.alias("token_ids"),
        F.flatten(masks).alias("tgt_mask"),
        *([boundaries(F.col("pieces"), example, context_length).alias("boundaries")] if example else []),
    )


def boundaries(pieces: Column, example: Sequence[str], context_length: int) -> Column:
    """Neighbouring pieces of one example as one interval of the block."""
    same = lambda a, b: reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in example])
    begins = F.filter(
        F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: (i == 0) | ~same(F.get(pieces, i), F.get(pieces, i - 1))
    )

    def interval(begin: Column, following: Column) -> Column:
        first, last = F.get(pieces, begin), F.get(pieces, F.coalesce(following, F.size(pieces)) - 1)
        return F.struct(
            F.pmod(first["at"], F.lit(context_length)).cast("int").alias("start"),
            (last["at"] + F.size(last["ids"]) - first["at"]).cast("int").alias("length"),
            *[first[k].alias(k) for k in example],
        )

    return F.transform(F.arrays_zip(begins.alias("begin"), F.slice(begins, 2, F.size(begins)).alias("next")), lambda b: interval(b["begin"], b["next"]))


def example_positions(intervals: Column) -> Column:
    """Places that count from zero again where another example begins."""
    return F.flatten(F.transform(intervals, lambda b: F.sequence(F.lit(0), b["length"] - 1)))


def examples_in_blocks(blocks: DataFrame, keep: Sequence[str] = (*SUBSET, "block_idx")) -> DataFrame:
    """One row per interval of ``boundaries``: its columns and its slice of ids and mask."""
    rows = blocks.select(*keep, "token_ids", "tgt_mask", F.explode("boundaries").alias("b"))
    part = lambda name: F.slice(name, F.col("b.start") + 1, F.col("b.length")).alias(name)
    return rows.select(*keep, "b.*", part("token_ids"), part("tgt_mask"))


def pack(
    examples: DataFrame,
    context_length: int = CONTEXT_LENGTH,
    groups: Sequence[str] = SUBSET,
    keys: Sequence[str] = ("doc_id",),
    staged: bool = True,
    tokens_per_run: int = TOKENS_PER_RUN,
    shifts: dict[str, Sequence[int]] | None = None,
    example: Sequence[str] = (),
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Full blocks of ``context_length`` tokens per subset; the tail of a subset is dropped.

    The ids are written once (``staged``; not needed for a table that is written
    already and has its lengths in ``n``). The offsets then read lengths only, and the
    arrays move twice: to meet their offset, and to meet their block. A subset of any
    share spreads over its blocks. ``shifts`` is that of ``running_offsets``, and ``offsets``
    its result where that is there already. ``example`` names those of the keys that make
    an example; blocks then tell whose tokens they hold (``boundaries``).
    """
    groups, keys = list(groups), list(keys)
    mask = "tgt_mask" if "tgt_mask" in examples.columns else "is_target"
    length = F.col("n") if "n" in examples.columns else n_tokens(F.col("token_ids")).alias("n")
    ids = F.col("token_ids")
    if mask == "tgt_mask":
        ids = F.when(F.size(ids) == F.size(mask), ids).otherwise(
            F.raise_error(F.lit("a mask is not as long as its ids")).cast("array<int>")
        )
    tokens = examples.select(*groups, *keys, ids.alias("token_ids"), mask, length)
    if staged:
        tokens = stage(tokens, "tokens")
    # Only now: a filter on the length before the write would be pushed below it and
    # tokenize every text a second time.
    tokens = tokens.where("n > 0")
    if offsets is None:
        offsets = running_offsets(tokens.select(*groups, *keys, "n"), groups, keys, "n", shifts)
    full_tokens = div(F.col("total"), context_length) * context_length
    kept = offsets.where(F.col("start") < full_tokens).drop("n")
    placed = tokens.join(kept, groups + keys)
    return full_blocks(placed, groups, context_length, tokens_per_run, example)


def full_blocks(
    placed: DataFrame,
    groups: Sequence[str],
    context_length: int,
    tokens_per_run: int = TOKENS_PER_RUN,
    example: Sequence[str] = (),
) -> DataFrame:
    """Blocks of rows that have their ``start`` and their group's ``total``, without the tail."""
    last_block = div(F.col("total"), context_length) - 1
    pieces = cut_pieces(placed, groups, context_length, last_block, example)
    return join_pieces(pieces, groups, context_length, tokens_per_run)


def pack_parts(
    examples: DataFrame,
    context_length: int = CONTEXT_LENGTH,
    groups: Sequence[str] = SUBSET,
    parts: Sequence[str] = ("part_start",),
    tokens_per_run: int = TOKENS_PER_RUN,
    example: Sequence[str] = (),
    numbers: DataFrame | None = None,
) -> DataFrame:
    """``pack`` for a written table that knows where each row starts inside its part.

    A part is one split of an input file, so there is about one per 128 MB of input and
    the table of their starts is small. It is joined plainly: the engine broadcasts it by
    its own count of its size, and the arrays then move once only, to their block.

    Parts follow each other by ``parts``. With ``numbers`` (the first of ``parts`` and a number)
    they go by that number instead of the first, and then by the rest.
    """
    groups, parts = list(groups), list(parts)
    tokens = examples.where("n > 0")
    lengths = tokens.groupBy(*groups, *parts).agg(F.sum("n").alias("_n"))
    order = parts
    if numbers is not None:
        (number,) = [c for c in numbers.columns if c != parts[0]]
        lengths, order = lengths.join(numbers, parts[0]), [number, *parts[1:]]
    starts = running_offsets(lengths, groups, order, "_n").withColumnRenamed("start", "_base").select(*groups, *parts, "_base", "total")
    placed = tokens.join(stage(starts, "parts"), [*groups, *parts])
    placed = placed.withColumn("start", F.col("_base") + F.col("start_in_part"))
    return full_blocks(placed, groups, context_length, tokens_per_run, example)


def unpack(
    blocks: DataFrame,
    tokens: DataFrame,
    offsets: DataFrame,
    keys: Sequence[str],
    context_length: int = CONTEXT_LENGTH,
    groups: Sequence[str] = SUBSET,
) -> DataFrame:
    """Ids of each example again: cut out of the blocks it reaches into, and its dropped tail.

    ``offsets`` has ``n, start, total`` by groups and keys; ``tokens`` the ids, of which only
    those in the tail of a subset are used, which no block has. Intervals meet their block,
    which is moved once, and only slices of it move on.
    """
    groups, keys = list(groups), list(keys)
    length = F.lit(context_length).cast("bigint")
    start, n = F.col("start"), F.col("n")
    full = div(F.col("total"), context_length) * length
    reach = F.sequence(div(start, length), div(F.least(start + n, full) - 1, length))
    inside = offsets.where((n > 0) & (start < full)).select(*groups, *keys, "start", "n", F.explode(reach).alias("block_idx"))
    at = F.col("block_idx") * length
    first = F.greatest(start - at, F.lit(0))
    last = F.least(start + n - at, length)
    cut = F.struct(*keys, (first + 1).cast("int").alias("begin"), (last - first).cast("int").alias("length"))
    cuts = inside.groupBy(*groups, "block_idx").agg(F.collect_list(cut).alias("cuts"))
    joined = blocks.select(*groups, "block_idx", "token_ids").join(cuts, [*groups, "block_idx"])
    sliced = joined.select(*groups, "block_idx", "token_ids", F.explode("cuts").alias("c")).select(
        *groups, *[F.col(f"c.{k}").alias(k) for k in keys], "block_idx", F.slice("token_ids", F.col("c.begin"), F.col("c.length")).alias("ids")
    )
    kept = F.greatest(full - start, F.lit(0))
    tails = offsets.where(start + n > full).select(*groups, *keys, "start", "n", "total")
    tail = tokens.select(*groups, *keys, "token_ids").join(tails, groups + keys).select(
        *groups, *keys, div(full, length).alias("block_idx"),
        F.slice("token_ids", (kept + 1).cast("int"), (n - kept).cast("int")).alias("ids"),
    )
    pieces = sliced.unionByName(tail).groupBy(*groups, *keys).agg(F.array_sort(F.collect_list(F.struct("block_idx", "ids"))).alias("pieces"))
    return pieces.select(*groups, *keys, F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("token_ids"))


def packing_report(
    examples: DataFrame, context_length: int = CONTEXT_LENGTH, groups: Sequence[str] = SUBSET
) -> DataFrame:
    """Blocks, kept tokens and tokens lost in the tail of each subset."""
    totals = examples.groupBy(*groups).agg(
        F.count("*").alias("n_examples"), F.sum(n_tokens(F.col("token_ids"))).alias("n_tokens")
    )
    blocks = div(F.col("n_tokens"), context_length)
    return totals.select(
        *groups,
        "n_examples",
        "n_tokens",
        blocks.alias("n_blocks"),
        (blocks * context_length).alias("kept_tokens"),
        (F.col("n_tokens") - blocks * context_length).alias("dropped_tokens"),
    )
