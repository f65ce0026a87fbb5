"""Prompt, pair, step and packed tables for model tuning.

Tokens are white-space words unless a tokenizer column function is passed in.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions import lexicons as lx
from opinara.functions import prompts as pr
from opinara.functions import tokens as tk
from opinara.functions.text import split_words, strip_ws, text_slices, word_count
from opinara.operators.filters import drop_null, drop_short_abusive
from opinara.operators.ordering import id_positions, long_digits, running_total
from opinara.session import cut_lineage

Tokenizer = Callable[[Column], Column]

PAD = -100  # in the type of the tokens beside it


class UserTokenizer:
    """A tokenizer callable as a column function, a slice of an Arrow batch at a time.

    ``encode`` takes one text, or with ``batched`` a list of them. ``each`` tokenizes
    every text of an array column in the same way.
    """

    def __init__(self, encode: Callable, batched: bool = False):
        def many(texts: list[str]) -> list[list[int]]:
            made = encode(texts) if batched else map(encode, texts)
            return [[int(i) for i in ids] for ids in made]

        def one_slice(texts: pd.Series) -> pd.Series:
            known = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype="object")
            out[known] = pd.Series(many(list(texts[known])), index=texts.index[known], dtype="object")
            return out

        def one_slice_of_lists(arrays: pd.Series) -> pd.Series:
            flat = [t for a in arrays if a is not None for t in a]
            coded = iter(many(["" if t is None else t for t in flat]))
            return pd.Series([None if a is None else [next(coded) for _ in a] for a in arrays], index=arrays.index)

        def letters(array) -> int:
            return sum(len(t) for t in array if t is not None)

        def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield from map(one_slice, text_slices(texts))

        def lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for arrays in batches:
                yield from map(one_slice_of_lists, text_slices(arrays, letters))

        self.ids = F.pandas_udf(ids, "array<bigint>")
        self.lists = F.pandas_udf(lists, "array<array<bigint>>")

    def __call__(self, texts: Column) -> Column:
        return self.ids(texts)

    def each(self, arrays: Column) -> Column:
        return self.lists(arrays)


def user_tokenizer(encode: Callable, batched: bool = False) -> UserTokenizer:
    """A tokenizer callable as a column function."""
    return UserTokenizer(encode, batched)


def each_text(tokenizer: Tokenizer, arrays: Column) -> Column:
    """Tokens of every text of an array."""
    each = getattr(tokenizer, "each", None)
    return each(arrays) if each else F.transform(arrays, tokenizer)


def as_token(df: DataFrame, tokens: str, value: str | int) -> Column:
    """A mark in the type of the elements of a token column, nested or not."""
    kind = df.schema[tokens].dataType.elementType
    return F.lit(value).cast(getattr(kind, "elementType", kind))


def format_rows(df: DataFrame, formatter: Callable[[pd.Series], pd.Series], col: str, out: str = "text") -> DataFrame:
    """One row per text of a user formatter, which must give a list for every row."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            for part in text_slices(values):
                made = formatter(part)
                for item in made:
                    if not isinstance(item, list):
                        raise ValueError("the formatter must return a list of texts")
                yield made

    call = F.pandas_udf(texts, "array<string>")
    return df.withColumn(out, F.explode(call(F.col(col))))


def truncated_text(c: Column, n: int) -> Column:
    """First ``n`` words, joined by blanks."""
    return F.array_join(tk.truncate_tokens(split_words(c), n), " ")


def prepare_tuning_set(
    df: DataFrame,
    text: str = "text",
    label: str = "criteria",
    max_tokens: int = 300,
    margin: int = 50,
    words: Sequence[str] = lx.ABUSIVE_WORDS,
    counter: Tokenizer = word_count,
) -> DataFrame:
    """Filter reviews, then overwrite the text with the tuning dialogue.

    All filters stand before the dialogue is built, on the source columns.
    """
    kept = drop_short_abusive(drop_null(df, [text, label]), text, words)
    kept = kept.where(counter(F.col(text)) < max_tokens - margin)
    turn = pr.chatml(
        pr.CLASSIFY, F.concat(F.lit("Review:\n"), F.col(text), F.lit("\n")), F.col(label)
    )
    return kept.withColumn(text, truncated_text(turn, max_tokens))


def conversation_turns(
    df: DataFrame,
    generation_prompt: bool = False,
    preamble: str = "",
    bos: str = "",
    key: str = "conv_id",
) -> DataFrame:
    """``(conv_id, pos, piece)``: the turns of a conversation in header style, one per row.

    A leading system turn fills the system header, which is empty otherwise. The pieces
    of a conversation in order of ``pos`` make up its text; nothing is gathered here.
    """
    content = strip_ws(F.coalesce(F.col("text"), F.lit("")))
    placed = running_total(
        df.select(key, "turn", "role", content.alias("content")),
        [F.col("turn")],
        long_digits(F.col("turn")),
        {"pos": F.lit(1)},
        [key],
        {"pos": "turns"},
    )

    def turn(role: Column, text: Column) -> Column:
        return F.concat(
            F.lit(pr.HEADER_START), role, F.lit(f"{pr.HEADER_END}\n\n"), text, F.lit(pr.TURN_END)
        )

    first, last = F.col("pos") == 1, F.col("pos") == F.col("turns")
    opens = first & F.col("role").eqNullSafe(F.lit("system"))
    system = turn(F.lit("system"), F.concat(F.lit(preamble), F.when(opens, F.col("content")).otherwise("")))
    piece = F.concat(
        F.when(first, F.concat(F.lit(bos), system)).otherwise(""),
        F.when(opens, "").otherwise(turn(F.coalesce("role", F.lit("")), F.col("content"))),
        F.when(last & F.lit(generation_prompt), f"{pr.HEADER_START}assistant{pr.HEADER_END}\n\n").otherwise(""),
    )
    return placed.select(key, "pos", piece.alias("piece"))


def render_conversations(df: DataFrame, *args, key: str = "conv_id", **options) -> DataFrame:
    """``(conv_id, text)``: one text per conversation, so one cell must hold its longest;
    ``conversation_turns`` has no such limit. Takes the options of that function."""
    pieces = conversation_turns(df, *args, key=key, **options)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    grouped = pieces.groupBy(key).agg(ordered.alias("pieces"))
    return grouped.select(key, F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"))


def extract_prompt(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Take the shared leading messages of a pair out as ``prompt``."""
    prompt = tk.common_prefix(F.col(chosen), F.col(rejected))
    found = df.withColumn("prompt", prompt)
    start = F.size("prompt") + 1

    def rest(c: str) -> Column:
        return F.slice(F.col(c), start, F.greatest(F.size(c) - F.size("prompt"), F.lit(0)))

    return found.withColumns({chosen: rest(chosen), rejected: rest(rejected)})


def unpair(df: DataFrame) -> DataFrame:
    """``(prompt, chosen, rejected)`` rows as two ``(prompt, completion, label)`` rows."""
    kept = [c for c in df.columns if c not in ("chosen", "rejected")]
    sides = F.array(
        F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")),
        F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")),
    )
    return df.select(*kept, F.inline(sides))


def prefix_prompt(df: DataFrame) -> DataFrame:
    """Put the prompt in front of both answers."""
    return df.withColumns(
        {c: F.concat(F.col("prompt"), F.col(c)) for c in ("chosen", "rejected")}
    )


def prompt_completion_ids(
    df: DataFrame, max_length: int, eos: str, tokenizer: Tokenizer = split_words
) -> DataFrame:
    """``input_ids`` of prompt and completion and the mask of completion positions."""
    closed = tk.ensure_text_eos(F.col("completion"), eos)
    coded = df.withColumns(
        {
            "__n": F.size(tokenizer(F.col("prompt"))),
            "input_ids": tk.truncate_tokens(
                tokenizer(F.concat(F.col("prompt"), closed)), max_length
            ),
        }
    )
    return coded.withColumn(
        "completion_mask", tk.completion_mask(F.col("__n"), F.size("input_ids"))
    ).drop("__n")


def answer_boundary(
    df: DataFrame, answers: Sequence[str] = ("chosen", "rejected"), tokenizer: Tokenizer = split_words
) -> DataFrame:
    """Prompt and answer tokens when their border may melt into one token.

    The whole text is tokenized; if its start is not the prompt's own tokens, the last
    prompt token belongs to the answer. ``boundary_ok`` tells whether the two prompts
    differ in at most one token and one in length; rows are marked, not dropped.
    """
    own = df.withColumn("__p", tokenizer(F.col("prompt")))
    for a in answers:
        own = own.withColumn(f"__f_{a}", tokenizer(F.concat(F.col("prompt"), F.col(a))))
    cuts = {}
    for a in answers:
        size = F.size("__p")
        same = F.slice(F.col(f"__f_{a}"), F.lit(1), size) == F.col("__p")
        cuts[f"__c_{a}"] = F.when(same, size).otherwise(F.greatest(size - 1, F.lit(0)))
    cut = own.withColumns(cuts)
    parts = {}
    for a in answers:
        full, at = F.col(f"__f_{a}"), F.col(f"__c_{a}")
        parts[f"{a}_prompt"] = F.slice(full, F.lit(1), at)
        parts[f"{a}_answer"] = F.slice(full, at + 1, F.greatest(F.size(full) - at, F.lit(0)))
    split = cut.withColumns(parts)
    one, two = (F.col(f"{a}_prompt") for a in answers)
    shorter = F.least(F.size(one), F.size(two))
    differing = F.size(
        F.filter(
            F.zip_with(F.slice(one, F.lit(1), shorter), F.slice(two, F.lit(1), shorter), lambda x, y: x != y),
            lambda d: d,
        )
    )
    ok = (differing <= 1) & (F.abs(F.size(one) - F.size(two)) <= 1)
    return split.withColumns(
        {"prompt_tokens": F.slice(F.col("__p"), F.lit(1), shorter), "boundary_ok": ok}
    ).drop("__p", *[f"__f_{a}" for a in answers], *[f"__c_{a}" for a in answers])


def truncate_pair(
    df: DataFrame,
    prompts: Sequence[str] = ("chosen_prompt", "rejected_prompt", "prompt_tokens"),
    answers: Sequence[str] = ("chosen_answer", "rejected_answer"),
    max_length: int = 1024,
    max_prompt: int = 512,
    mode: str = "keep_end",
) -> DataFrame:
    """Shorten prompts that, with the longer answer, exceed ``max_length``; then cut the
    answers whose prompt and longer answer still do.

    ``prompts`` pairs with ``answers`` in order; further prompts are only shortened.
    """
    if mode not in ("keep_end", "keep_start"):
        raise ValueError(f"unknown truncation mode: {mode}")
    cut = tk.keep_end if mode == "keep_end" else tk.truncate_tokens
    longer = F.greatest(*[F.size(a) for a in answers])
    df = df.withColumn("__longer", longer)
    df = df.withColumns(
        {
            p: F.when(F.size(p) + F.col("__longer") > max_length, cut(F.col(p), max_prompt)).otherwise(F.col(p))
            for p in prompts
        }
    )
    df = df.withColumns(
        {
            a: F.when(
                F.size(p) + F.col("__longer") > max_length,
                tk.truncate_tokens(F.col(a), max_length - max_prompt),
            ).otherwise(F.col(a))
            for p, a in zip(prompts, answers)
        }
    )
    return df.drop("__longer")


def sequence_labels(
    df: DataFrame, prompt: str, answer: str, side: str, pad: str | int = PAD
) -> DataFrame:
    """``<side>_input_ids`` and ``<side>_labels``, padded over the prompt."""
    return df.withColumns(
        {
            f"{side}_input_ids": F.concat(F.col(prompt), F.col(answer)),
            f"{side}_labels": tk.masked_labels(F.col(prompt), F.col(answer), as_token(df, answer, pad)),
        }
    )


def pair_sequences(
    df: DataFrame,
    bos: str | int | None = None,
    eos: str | int | None = None,
    tokenizer: Tokenizer = split_words,
    **limits,
) -> DataFrame:
    """Boundary, marks, truncation and labels of preference pairs in one go."""
    split = answer_boundary(df, tokenizer=tokenizer)
    prompts = ("chosen_prompt", "rejected_prompt", "prompt_tokens")
    answers = ("chosen_answer", "rejected_answer")
    if bos is not None:
        split = split.withColumns({p: tk.ensure_bos(F.col(p), as_token(split, p, bos)) for p in prompts})
    if eos is not None:
        split = split.withColumns({a: tk.ensure_eos(F.col(a), as_token(split, a, eos)) for a in answers})
    cut = truncate_pair(split, prompts, answers, **limits)
    for side in ("chosen", "rejected"):
        cut = sequence_labels(cut, f"{side}_prompt", f"{side}_answer", side)
    return cut


def step_labels(
    df: DataFrame,
    sep: str | int,
    max_length: int | None = 1024,
    max_prompt: int | None = 512,
    max_completion: int | None = None,
    last_only: bool = False,
    bos: str | int | None = None,
    pad: str | int = PAD,
    tokenizer: Tokenizer = split_words,
) -> DataFrame:
    """``input_ids`` and ``labels`` of stepwise records.

    Every step ends in the separator token, which carries the step's label; all other
    positions are padded. With ``last_only`` just the last step keeps its label.
    """
    count = F.least(F.size("completions"), F.size("labels"))
    df = df.withColumn("__words", each_text(tokenizer, F.col("completions")))
    fill, end = as_token(df, "__words", pad), as_token(df, "__words", sep)
    kind = df.schema["__words"].dataType.elementType.elementType
    shown = F.transform(
        F.slice(F.col("labels"), F.lit(1), count),
        lambda v, i: F.when(
            F.lit(not last_only) | (i == F.size("labels") - 1), v.cast("int").cast(kind)
        ).otherwise(fill),
    )
    steps = F.transform("__words", lambda s: F.array_append(s, end))
    df = df.withColumns({"__steps": steps, "__shown": shown})
    marks = F.zip_with(
        F.slice(F.col("__steps"), F.lit(1), count),
        F.col("__shown"),
        lambda s, v: F.concat(tk.repeat(fill, F.size(s) - 1), F.array(v)),
    )
    df = df.withColumn("__p", tokenizer(F.col("prompt")))
    prompt = F.col("__p")
    if bos is not None:
        prompt = F.array_prepend(prompt, as_token(df, "__p", bos))
    if max_prompt is not None:
        prompt = tk.keep_end(prompt, max_prompt)
    ids, labels = F.flatten("__steps"), F.flatten(marks)
    if max_completion is not None:
        ids, labels = (tk.truncate_tokens(x, max_completion) for x in (ids, labels))
    df = df.withColumns({"__p": prompt, "__c": ids, "__m": labels})
    ids = F.concat("__p", "__c")
    labels = F.concat(tk.repeat(fill, F.size("__p")), F.col("__m"))
    if max_length is not None:
        ids, labels = (tk.truncate_tokens(x, max_length) for x in (ids, labels))
    return df.withColumns({"input_ids": ids, "step_labels": labels}).drop(
        "__words", "__steps", "__shown", "__p", "__c", "__m"
    )


def desirability_balance(
    df: DataFrame, label: str, w_d: float = 1.0, w_u: float = 1.0
) -> DataFrame:
    """Counts per side, recommended weight ranges and whether advice is due."""
    counts = df.agg(
        F.greatest(F.count_if(F.col(label)), F.lit(1)).alias("desirable"),
        F.count(F.lit(1)).alias("__n"),
    ).withColumn("undesirable", F.greatest(F.col("__n") - F.col("desirable"), F.lit(1)))
    des = F.col("undesirable") * w_u / F.col("desirable")
    und = F.col("desirable") * w_d / F.col("undesirable")
    ranges = counts.select(
        "desirable",
        "undesirable",
        F.round(des, 2).alias("des_low"),
        F.round(des * 1.33, 2).alias("des_high"),
        F.round(und / 1.33, 2).alias("und_low"),
        F.round(und, 2).alias("und_high"),
    )
    inside = F.lit(w_d).between(F.col("des_low"), F.col("des_high")) | F.lit(w_u).between(
        F.col("und_low"), F.col("und_high")
    )
    differ = F.col("desirable") != F.col("undesirable")
    return ranges.withColumn("advice", differ & ~inside)


def pack_wrapped(df: DataFrame, tokens: str, length: int, key: str) -> DataFrame:
    """``(seq, tokens)``: all tokens in id order, cut every ``length`` tokens.

    Each row knows its first token's position in the whole stream, so it hands one
    slice to every sequence it touches, and a sequence gathers at most ``length`` tokens.
    """
    sized = df.select(key, F.col(tokens).alias("__t"), F.size(tokens).alias("__n"))
    placed = running_total(sized, [F.col(key)], long_digits(F.col(key)), {"__end": F.col("__n")})
    start = F.col("__end") - F.col("__n")
    spans = F.sequence(F.floor(start / length), F.floor((F.col("__end") - 1) / length))
    touched = placed.withColumns(
        {"__start": start, "seq": F.explode(F.when(F.col("__n") > 0, spans))}
    )
    low = F.greatest(F.col("seq") * length - F.col("__start"), F.lit(0))
    high = F.least((F.col("seq") + 1) * length - F.col("__start"), F.col("__n"))
    slices = touched.select(
        "seq",
        "__start",
        F.slice(F.col("__t"), (low + 1).cast("int"), (high - low).cast("int")).alias("piece"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("__start", "piece")))
    gathered = slices.groupBy("seq").agg(ordered.alias("pieces"))
    return gathered.select("seq", F.flatten(F.transform("pieces", lambda p: p["piece"])).alias("tokens"))


def _best_fit(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Bin of each row: longest first, into the fullest bin that still has room."""
    ordered = rows.sort_values(["n", "key"], ascending=[False, True])
    room: list[tuple[int, int]] = []  # (space left, bin), sorted
    bins: list[int] = []
    opened = 0
    for n in ordered["n"]:
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            space, index = room.pop(at)
        else:
            space, index = length, opened
            opened += 1
        bins.append(index)
        bisect.insort(room, (space - n, index))
    return ordered.assign(bin=bins)


def pack_best_fit(
    df: DataFrame, tokens: str, length: int, key: str, shard_rows: int = 10_000
) -> DataFrame:
    """``(shard, bin, tokens)``: rows cut to ``length`` and packed best-fit decreasing.

    Rows are packed inside shards of about ``shard_rows`` rows in id order, whose
    number grows with the table; only ids and sizes reach Python, the tokens follow by
    a join on the id.
    """
    cut = df.select(F.col(key).alias("key"), tk.truncate_tokens(F.col(tokens), length).alias("__t"))
    sized = cut.select("key", F.size("__t").cast("int").alias("n"))
    shard = F.floor((F.col("pos") - 1) / shard_rows).alias("shard")
    sharded = id_positions(sized, "key", out="pos").select("key", "n", shard)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return _best_fit(rows[rows["n"] > 0], length)[["key", "shard", "bin", "n"]]

    packed = sharded.groupBy("shard").applyInPandas(
        pack, "key bigint, shard bigint, bin bigint, n int"
    )
    ordered = F.array_sort(F.collect_list(F.struct(-F.col("n"), F.col("key"), F.col("__t"))))
    gathered = packed.join(cut, "key").groupBy("shard", "bin").agg(ordered.alias("rows"))
    return gathered.select(
        "shard",
        "bin",
        F.transform("rows", lambda r: r["key"]).alias("members"),
        F.flatten(F.transform("rows", lambda r: r["__t"])).alias("tokens"),
    )


def best_fit_steps(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[n]`` rows of each size ``n``, run on the counts.

    Steps ``(n, first, rows, bin, each)``: of the rows of size ``n``, ``rows`` from number
    ``first`` on fill the bins from ``bin`` on, ``each`` rows a bin. Sizes fall; a row goes
    to the bin with the least room that takes it, of equal ones to the first. Bins of one
    room are kept as runs of neighbours. While a bin still has room for a row it is the
    fullest that has, so a run takes all its rows at once, and its room falls by half or
    more; a size cuts at most two runs. So there are fewer than ``3 * length *
    log2(length)`` steps, however many rows.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first bin, bins) in a heap
    rooms: list[int] = []  # sorted
    steps = []
    opened = 0

    def put(room: int, first: int, bins: int) -> None:
        if bins and room:
            if room not in runs:
                bisect.insort(rooms, room)
            heapq.heappush(runs.setdefault(room, []), (first, bins))

    for n in sorted((n for n, c in counts.items() if n > 0 and c > 0), reverse=True):
        placed, total = 0, counts[n]
        while placed < total:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                first, bins = heapq.heappop(runs[room])
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first = length, opened
                bins = -(-(total - placed) // (length // n))
                opened += bins
            each = room // n
            rows = min(total - placed, bins * each)
            whole, rest = divmod(rows, each)
            steps.append((n, placed, rows, first, each))
            put(room - each * n, first, whole)
            put(room - rest * n, first + whole, 1 if rest else 0)
            used = whole + bool(rest)
            put(room, first + used, bins - used)
            placed += rows
    return steps


def pack_by_sizes(df: DataFrame, tokens: str, length: int, key: str) -> DataFrame:
    """``(bin, members, tokens)``: rows cut to ``length``, packed best-fit decreasing over
    the whole table, longest first and ties by the integer ``key``, which must be distinct.

    Only the histogram of sizes, at most ``length`` rows, reaches the driver. Each row
    knows its number among the rows of its size, and a table of steps whose size depends
    on ``length`` alone says which bin that number has. Rows without tokens are in no bin.
    """
    cut = df.select(F.col(key).alias("key"), tk.truncate_tokens(F.col(tokens), length).alias("__t"))
    sized = cut.select("key", F.size("__t").cast("int").alias("n")).where("n > 0")
    sized = cut_lineage(sized)
    counts = {r["n"]: r["count"] for r in sized.groupBy("n").count().collect()}
    steps = df.sparkSession.createDataFrame(
        best_fit_steps(counts, length), "n int, first bigint, rows bigint, bin bigint, each bigint"
    )
    # one row a size, so a row meets the steps of its size once
    steps = steps.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("first", "rows", "bin", "each"))).alias("steps"))
    numbered = id_positions(sized, "key", ["n"], out="number").withColumn("number", F.col("number") - 1)
    mine = F.filter("steps", lambda s: F.col("number").between(s["first"], s["first"] + s["rows"] - 1))[0]
    placed = numbered.join(F.broadcast(steps), "n").select("key", "n", "number", mine.alias("s"))
    placed = placed.select(
        "key", "n", (F.col("s.bin") + F.floor((F.col("number") - F.col("s.first")) / F.col("s.each"))).alias("bin")
    )
    ordered = F.array_sort(F.collect_list(F.struct(-F.col("n"), F.col("key"), F.col("__t"))))
    gathered = placed.join(cut, "key").groupBy("bin").agg(ordered.alias("rows"))
    return gathered.select(
        "bin",
        F.transform("rows", lambda r: r["key"]).alias("members"),
        F.flatten(F.transform("rows", lambda r: r["__t"])).alias("tokens"),
    )
