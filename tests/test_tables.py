import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opinara.functions import tokens as tk
from opinara.operators import tuning as tn
from opinara.sources import files, schema


def test_csv_edges(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_bytes('﻿text,criteria\n"a ""q"" b\nline2, c",Service\nx,NA\n'.encode())
    got = files.read_reviews_csv(spark, str(path), "text string, criteria string").collect()
    assert [tuple(r) for r in got] == [('a "q" b\nline2, c', "Service"), ("x", None)]


def test_csv_round_trip_keeps_blanks(spark, tmp_path):
    rows = [(1, "  a \t"), (2, 'q"uo,te'), (3, "two\nlines"), (4, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    files.write_table(df, str(tmp_path / "out"), "csv")
    back = files.read_reviews_csv(spark, str(tmp_path / "out"), "id int, text string", [""])
    assert sorted(map(tuple, back.collect())) == rows


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "a", True, 2.0)], "i int, s string, b boolean, d double")
    assert schema.columns_by_type(df) == (["i", "d"], ["s", "b"])
    with pytest.raises(ValueError):
        schema.require_columns(df, ["i", "nope"])
    kind = lambda ddl, **k: schema.record_kind(StructType.fromDDL(ddl), **k)
    assert kind("input_ids array<int>, labels array<int>") == "labelled_ids"
    assert kind("input_ids array<int>") == "ids"
    assert kind("prompt string, completion string, text string") == "prompt_completion"
    assert kind("text string") == "text"
    assert kind("x string", has_formatter=True) == "formatted"
    with pytest.raises(ValueError):
        kind("x string")


def test_null_entries_leave_maps_and_arrays(spark):
    df = spark.sql("SELECT array(1, null, 2) AS a, map('x', 1, 'y', null) AS m")
    row = df.select(schema.drop_null_elements(F.col("a")), schema.drop_null_elements(F.col("m"), True)).first()
    assert row[0] == [1, 2] and row[1] == {"x": 1}


def test_conversation_turns_join_to_the_whole(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f" word{t} " * 20) for t in range(1, 60)]
    rows += [(2, 0, "system", " be kind "), (2, 1, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    whole = {r["conv_id"]: r["text"] for r in tn.render_conversations(df).collect()}
    turns = tn.conversation_turns(df).orderBy("conv_id", "pos").collect()
    assert len(turns) == len(rows)
    for conv in (1, 2):
        assert "".join(r["piece"] for r in turns if r["conv_id"] == conv) == whole[conv]
    mark = "<|start_header_id|>{}<|end_header_id|>\n\n{}<|eot_id|>"
    assert whole[2] == mark.format("system", "be kind") + mark.format("user", "hi")
    assert whole[1].startswith(mark.format("system", ""))


def test_step_labels_example(spark):
    df = spark.createDataFrame(
        [("which is larger", ["11 over 8", "hence it"], [True, False])],
        "prompt string, completions array<string>, labels array<boolean>",
    )
    row = tn.step_labels(df, "\n").first()
    assert row["input_ids"] == ["which", "is", "larger", "11", "over", "8", "\n", "hence", "it", "\n"]
    assert row["step_labels"] == ["-100"] * 6 + ["1", "-100", "-100", "0"]
    last = tn.step_labels(df, "\n", last_only=True).first()
    assert last["step_labels"] == ["-100"] * 9 + ["0"]


def test_pair_truncation_limits(spark):
    long = " ".join(map(str, range(900)))
    df = spark.createDataFrame([(long, " a b", " c")], "prompt string, chosen string, rejected string")
    row = tn.pair_sequences(df, max_length=600, max_prompt=100).first()
    assert row["chosen_prompt"] == [str(i) for i in range(800, 900)]
    assert row["chosen_labels"] == ["-100"] * 100 + ["a", "b"]
    with pytest.raises(ValueError):
        tn.truncate_pair(tn.answer_boundary(df), mode="middle")


def test_common_prefix(spark):
    df = spark.sql("SELECT array('a','b','c') AS x, array('a','b') AS y, array('z') AS z")
    row = df.select(*[tk.common_prefix(F.col(a), F.col(b)) for a, b in (("x", "y"), ("y", "x"), ("x", "x"), ("x", "z"))]).first()
    assert [*row] == [["a", "b"], ["a", "b"], ["a", "b", "c"], []]


def test_packing_keeps_every_token(spark):
    df = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.col("id") % 37 + 1), lambda i: i.cast("string")).alias("t"))
    total = df.agg(F.sum(F.size("t"))).first()[0]
    wrapped = tn.pack_wrapped(df, "t", 50, "id")
    sizes = [r[0] for r in wrapped.orderBy("seq").select(F.size("tokens")).collect()]
    assert sum(sizes) == total and set(sizes[:-1]) == {50}
    packed = tn.pack_best_fit(df, "t", 50, "id", shard_rows=100)
    bins = packed.select("shard", F.size("tokens").alias("n"), "members").collect()
    assert sum(r["n"] for r in bins) == total and max(r["n"] for r in bins) <= 50
    assert sorted(m for r in bins for m in r["members"]) == list(range(300))
    assert len({r["shard"] for r in bins}) == 3
    assert total / (50 * len(bins)) > 0.95


def test_best_fit_on_counts_is_best_fit_row_by_row():
    import random

    draw = random.Random(5)
    for length, n in ((10, 0), (7, 1), (50, 300), (64, 2000), (512, 700)):
        top = length if n % 2 else max(1, length // 3)
        sizes = sorted((draw.randint(1, draw.choice((top, length))) for _ in range(n)), reverse=True)
        room, want = [], []
        for size in sizes:
            best = min((r for r in room if r >= size), default=None)
            at = len(room) if best is None else room.index(best)
            if best is None:
                room.append(length)
            room[at] -= size
            want.append(at)
        counts = Counter(sizes)
        steps = tn.best_fit_steps(counts, length)
        got = [first + j // each for _, _, rows, first, each in steps for j in range(rows)]
        assert got == want
        assert len(steps) <= 3 * length * math.log2(length)


def test_pack_by_sizes_equals_the_whole_best_fit(spark):
    rows = [(i, ["x"] * (i * 37 % 61)) for i in range(-150, 150)] + [(900, None), (901, [])]
    df = spark.createDataFrame(rows, "id bigint, t array<string>")
    got = tn.pack_by_sizes(df, "t", 50, "id").collect()
    sizes = sorted(((min(len(t), 50), i) for i, t in rows if t), key=lambda r: (-r[0], r[1]))
    room, bins = [], []
    for n, i in sizes:
        best = min((r for r in room if r >= n), default=None)
        at = len(room) if best is None else room.index(best)
        if best is None:
            room.append(50)
            bins.append([])
        room[at] -= n
        bins[at].append(i)
    assert {r["bin"]: r["members"] for r in got} == dict(enumerate(bins))
    assert all(len(r["tokens"]) == 50 - room[r["bin"]] for r in got)
    assert tn.pack_by_sizes(df.where("id > 950"), "t", 50, "id").count() == 0


def test_formatter_must_return_lists(spark):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(Exception, match="must return a list"):
        tn.format_rows(df, lambda s: s, "x").collect()


def test_balance_advice(spark):
    df = spark.createDataFrame([(True,)] * 9 + [(False,)], "label boolean")
    row = tn.desirability_balance(df, "label").first()
    assert (row["desirable"], row["undesirable"], row["advice"]) == (9, 1, True)
    assert not tn.desirability_balance(df, "label", w_d=0.12).first()["advice"]


def test_stream_equals_batch(spark, tmp_path):
    from opinara.operators.labeling import FRENCH, label_reviews
    from opinara.streaming.scoring import read_stream, score_stream, start_writing

    df = spark.createDataFrame([(1, "le prix"), (2, "  "), (3, "zzz"), (4, None)], "id bigint, text string")
    df.write.parquet(str(tmp_path / "in"))
    arriving = read_stream(spark, str(tmp_path / "in"), df.schema)
    running = start_writing(score_stream(arriving, FRENCH), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    running.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, label_reviews(df.where("id IN (1, 3)"), FRENCH).collect()))
    assert got == want == [(1, "le prix", "Price_value"), (3, "zzz", "Global_experience")]
