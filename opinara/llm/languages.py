"""Language of texts, in two steps: the family first, then the language within it.

A text is the mean of its character sequences: runs of two to four bytes of the
lower-cased text, other than letters turned into single spaces, hashed to buckets. Linear
support vector machines tell families apart, one for every two of them; within the family
that wins, one for every two of its languages does. The winner has most votes.

The machines learn from a bounded sample of labelled texts per language, one Spark task a
machine, by coordinate descent on the dual problem. A fifth of the sample is kept from
them to turn margins into probabilities. Prediction is a map over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm.batches import map_slices, materialize
from opinara.llm.words import raw_bytes

# Families of languages by their ISO 639-1 codes. Any other language is a
# family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
LETTER = r"\p{L}"

SPACE = 0x20
PLAIN = np.full(256, SPACE, dtype=np.uint8)  # ASCII letters and all bytes beyond ASCII stay
PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
PLAIN[0x80:] = np.arange(0x80, 0x100)
SPREAD = np.uint32(0x9E3779B1)  # odd multiplier of the bucket hash
CHUNK = 1 << 18  # places that are hashed at a time, however long the texts


@dataclass(frozen=True)
class Settings:
    """``rows``: bound of the sample, distinct texts a language and a family.
    ``languages``: more learned values than that are an error, since the machines of all
    pairs go to all tasks: 64 languages make 2,016 machines of 256 KB at most."""

    rows: int = 1000
    languages: int = 64
    lengths: tuple[int, ...] = (2, 3, 4)  # bytes of a sequence
    bits: int = 16  # buckets, as a power of two
    cost: float = 10.0  # of a margin violation; shared out evenly between the classes
    rounds: int = 60
    tolerance: float = 0.01  # largest projected gradient left
    folds: int = 4  # remainders of the id's CRC; ``held_out`` is never learned from
    held_out: int = 2


def family_of(language: str) -> str:
    """Family of a language tag such as ``pt`` or ``pt-BR``."""
    code = language.replace("_", "-").split("-")[0].lower()
    return FAMILY_OF.get(code, language)


# ---- features -------------------------------------------------------------------------


@dataclass
class Plain:
    """Texts as letters and single spaces, each between two spaces."""

    data: np.ndarray
    owner: np.ndarray  # text of each byte
    end: np.ndarray  # of each text

    def sequences(self, s: Settings):
        """``(text numbers, buckets)`` of all sequences, a bounded number at a time."""
        for low in range(0, len(self.data), CHUNK):
            high = min(len(self.data), low + CHUNK)
            owner = self.owner[low:high]
            left = self.end[owner] - np.arange(low, high)
            code = np.zeros(high - low, np.uint32)
            for k in range(1, max(s.lengths) + 1):
                byte = self.data[low + k - 1 : high + k - 1].astype(np.uint32)
                code[: len(byte)] = (code[: len(byte)] << np.uint32(8)) | byte
                if k in s.lengths:
                    whole = left >= k
                    mixed = (code[whole] ^ np.uint32(k)) * SPREAD
                    yield owner[whole], ((mixed ^ (mixed >> np.uint32(15))) * SPREAD) >> np.uint32(32 - s.bits)


def plain_texts(column: pa.Array) -> Plain:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw, offsets = raw_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(offsets) - 1
    data = np.full(len(raw) + 2 * n, SPACE, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
    inner = np.repeat(np.arange(n), np.diff(offsets))
    data[np.arange(len(raw)) + 2 * inner + 1] = PLAIN[raw]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != SPACE) | (data[:-1] != SPACE) | (owner[1:] != owner[:-1])
    data, owner = data[keep], owner[keep]
    return Plain(data, owner, np.searchsorted(owner, np.arange(n), side="right"))


def feature_shares(column: pa.Array, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text and the share of its sequences in each."""
    out, texts = [], len(column)
    for i in range(texts):
        counts = np.zeros(1 << s.bits, np.int64)
        for _, bucket in plain_texts(column.slice(i, 1)).sequences(s):
            counts += np.bincount(bucket, minlength=1 << s.bits)
        some = np.flatnonzero(counts)
        out.append((some.astype(np.int32), (counts[some] / max(1, counts.sum())).astype(np.float32)))
    return out


# ---- one machine ----------------------------------------------------------------------


def dual_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: np.ndarray, size: int, rounds: int, tolerance: float
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the last is the bias) and dual variables of a linear hinge-loss machine.

    Minimizes ``|w|^2 / 2 + sum(cost * max(0, 1 - sign * w.x))``, one dual variable after
    another in seeded random order, until no projected gradient exceeds ``tolerance``.
    """
    rng = np.random.default_rng(7)
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norm = np.array([float(x @ x) + 1.0 for _, x in rows])
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            slope = sign[i] * (w[at] @ x + w[size]) - 1.0
            left = slope if 0 < alpha[i] < cost[i] else min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0)
            if left == 0.0:
                continue
            worst = max(worst, abs(left))
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            alpha[i] = new
            w[at] += step * x
            w[size] += step
        if worst <= tolerance:
            break
    return w, alpha


def probability_line(margin: np.ndarray, sign: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to the chance of the first class.

    The targets are drawn in from 0 and 1 by the class sizes, so the curve stays finite
    where the classes are apart; Newton's steps, with a small pull on the slope.
    """
    up, down = (sign > 0).sum(), (sign < 0).sum()
    target = np.where(sign > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        weight = p * (1 - p)
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([
            [(weight * margin * margin).sum() + 1e-3, (weight * margin).sum()],
            [(weight * margin).sum(), weight.sum() + 1e-9],
        ])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 1e-3), float(b)


def train(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, s: Settings) -> tuple[np.ndarray, float, float, float]:
    """Weight per bucket, bias, and the probability line of one machine.

    Shares are scaled by the root of their mean, so frequent and rare sequences count
    alike; the scale is folded into the weights.
    """
    size = 1 << s.bits
    total = np.zeros(size)
    for at, x in rows:
        total[at] += x
    scale = 1 / np.sqrt(total / max(1, len(rows)) + 1e-5)
    scaled = [(at, x * scale[at]) for at, x in rows]
    aside = np.arange(len(rows)) % 5 == 4  # rows come in the order of their hashes
    if len(set(sign[aside])) < 2 or len(set(sign[~aside])) < 2:
        aside = np.zeros(len(rows), bool)  # too few rows to keep some
    share = np.where(sign > 0, (sign > 0).mean(), (sign < 0).mean())
    learn = np.flatnonzero(~aside)
    w, _ = dual_descent([scaled[i] for i in learn], sign[learn], s.cost * 0.5 / share[learn], size, s.rounds, s.tolerance)
    check = np.flatnonzero(aside) if aside.any() else learn
    margin = np.array([w[scaled[i][0]] @ scaled[i][1] + w[size] for i in check])
    return ((w[:size] * scale).astype(np.float32), float(w[size]), *probability_line(margin, sign[check]))


# ---- all machines ---------------------------------------------------------------------


@dataclass
class Machine:
    first: str
    second: str
    weight: np.ndarray
    bias: float
    slope: float
    offset: float


@dataclass
class Model:
    """``machines[""]`` tells families apart, ``machines[family]`` its languages."""

    languages: dict[str, list[str]]  # by family
    machines: dict[str, list[Machine]] = field(default_factory=dict)

    def vote(self, level: str, names: list[str], p: Plain, n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Winner of each text, as a place in ``names``, and its least chance against
        another; of equally many votes the higher chance, then the first name wins."""
        if len(names) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        machines = self.machines[level]
        sums = np.zeros((len(machines), n))
        count = np.zeros(n)
        for owner, bucket in p.sequences(s):
            count += np.bincount(owner, minlength=n)
            for total, m in zip(sums, machines):
                total += np.bincount(owner, weights=m.weight[bucket], minlength=n)
        votes, least = np.zeros((n, len(names))), np.ones((n, len(names)))
        for total, m in zip(sums, machines):
            margin = total / np.maximum(count, 1) + m.bias
            chance = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.offset, -30, 30)))
            a, b = names.index(m.first), names.index(m.second)
            votes[:, a] += chance >= 0.5
            votes[:, b] += chance < 0.5
            least[:, a] = np.minimum(least[:, a], chance)
            least[:, b] = np.minimum(least[:, b], 1 - chance)
        best = (votes + least / 2).argmax(1)  # a chance is at most 1, half of it less than a vote
        return best, least[np.arange(n), best]

    def predict(self, column: pa.Array, s: Settings) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 without a letter or a model."""
        n = len(column)
        lettered = pc.match_substring_regex(pc.fill_null(column, ""), LETTER).to_numpy(zero_copy_only=False).astype(bool)
        names, scores = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
        some = np.flatnonzero(lettered)
        families = sorted(self.languages)
        if not families or not len(some):
            return names.tolist(), scores.tolist()
        texts = column.take(pa.array(some))
        family, chance = self.vote("", families, plain_texts(texts), len(some), s)
        for k, name in enumerate(families):
            own = np.flatnonzero(family == k)
            if not len(own):
                continue
            languages = self.languages[name]
            parts = plain_texts(texts.take(pa.array(own))) if len(languages) > 1 else None
            best, inner = self.vote(name, languages, parts, len(own), s)
            names[some[own]] = [languages[i] for i in best]
            scores[some[own]] = chance[own] * inner
        return names.tolist(), np.round(scores, 6).tolist()


def held_out(key: Column, s: Settings) -> Column:
    """Whether a document is kept from learning; a null id counts as an empty one."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % s.folds == s.held_out


def training_sample(docs: DataFrame, s: Settings) -> DataFrame:
    """``(lang, seed, at, share)``: features of at most ``rows`` distinct texts a language,
    those whose hashes are the least."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), s) & F.col("text").rlike(LETTER))
    known = known.select("lang", "text", F.xxhash64("text").alias("seed"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("seed", 0.02).alias("n"))
    sizes = sizes.limit(s.languages + 1).collect()
    if len(sizes) > s.languages:
        raise ValueError(f"more than {s.languages} languages to learn")
    cuts = [(r.lang, min(2**63 - 1, int(min(1.0, 1.2 * s.rows / max(1, r.n)) * 2**64) - 2**63)) for r in sizes]
    table = docs.sparkSession.createDataFrame(cuts, "lang string, cut long")
    few = known.join(F.broadcast(table), "lang").where("seed <= cut").groupBy("lang", "seed").agg(F.min("text").alias("text"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = feature_shares(part.column("text"), s)
        at = pa.array([a for a, _ in rows], pa.list_(pa.int32()))
        share = pa.array([x for _, x in rows], pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([part.column("lang"), part.column("seed"), at, share], ["lang", "seed", "at", "share"])

    rows = materialize(map_slices(few, run, "lang string, seed long, at array<int>, share array<float>"), "language_sample")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("seed"))
    return rows.withColumn("place", place).where(F.col("place") <= s.rows).drop("place")


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Machines of all pairs of families and of all pairs of languages of a family."""
    spark = docs.sparkSession
    sample = training_sample(docs, s)
    families: dict[str, list[str]] = {}
    for row in sample.select("lang").distinct().orderBy("lang").collect():
        families.setdefault(family_of(row.lang), []).append(row.lang)
    model = Model(families)
    pairs = [("", a, b) for a, b in combinations(sorted(families), 2)]
    pairs += [(f, a, b) for f, names in families.items() for a, b in combinations(names, 2)]
    if not pairs:
        return model
    kinds = spark.createDataFrame([(x, f) for f, names in families.items() for x in names], "lang string, family string")
    rows = sample.join(F.broadcast(kinds), "lang")
    place = F.row_number().over(Window.partitionBy("family").orderBy("seed", "lang"))
    of_family = rows.withColumn("place", place).where(F.col("place") <= s.rows)
    sides = [(i, level == "", name, sign) for i, (level, a, b) in enumerate(pairs) for name, sign in ((a, 1), (b, -1))]
    sides = F.broadcast(spark.createDataFrame(sides, "machine int, top boolean, name string, sign int"))
    classes = of_family.select(F.lit(True).alias("top"), F.col("family").alias("name"), "seed", "at", "share").unionByName(
        rows.select(F.lit(False).alias("top"), F.col("lang").alias("name"), "seed", "at", "share")
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["seed", "sign"], kind="stable")
        x = [(np.asarray(a, np.int32), np.asarray(v, np.float64)) for a, v in zip(group["at"], group["share"])]
        weight, bias, slope, offset = train(x, group["sign"].to_numpy(np.float64), s)
        return pd.DataFrame(
            {"machine": [group["machine"].iloc[0]], "weight": [weight.tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]}
        )

    trained = classes.join(sides, ["top", "name"]).groupBy("machine").applyInPandas(
        run, "machine int, weight binary, bias double, slope double, offset double"
    )
    for r in sorted(trained.collect(), key=lambda r: r.machine):  # at most one row a pair
        level, a, b = pairs[r.machine]
        machine = Machine(a, b, np.frombuffer(r.weight, np.float32), r.bias, r.slope, r.offset)
        model.machines.setdefault(level, []).append(machine)
    return model


def predict_languages(docs: DataFrame, s: Settings = Settings(), model: Model | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document of ``(doc_id, text, lang)``.

    Learns from text and non-null ``lang`` of documents outside the held-out fold; only the
    text is read to predict. ``score`` is the family's least chance against another family
    times the language's against another of its family, 0 to 1. A null or empty text, one
    without a letter, or no labelled text at all gives ``und`` and 0; a single language is
    given to all others, with 1. Repeated rows are judged alike and learned from once. A
    null id is learned from as an empty one. No documents give no rows; other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, s))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(part.column("text"), s)
        columns = [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id"), s).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(rows, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
