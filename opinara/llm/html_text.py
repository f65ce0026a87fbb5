"""Main text of pages: a linear-chain conditional random field over DOM leaf blocks.

Every page becomes its sequence of leaf blocks. Features are names of ancestor elements,
what their attributes speak for, the block's own element and its text. The field has two
labels, main text or not, weights per feature and label, and weights per pair of labels.
It is trained on labelled pages by gradient ascent of the log-likelihood, with forward
and backward sums over all pages at once, and decoded by Viterbi, page by page.

Pages label themselves where their markup does: a page with one ``article`` or ``main``
element says which blocks are its text. Each page of a bounded sample of them is used as
it stands and re-rendered in layouts that say less, with the same texts, so that class
names, roles and plain elements get weights too.
"""

from __future__ import annotations

import html
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.batches import map_slices, materialize
from opinara.llm.html_blocks import Block, blocks_of, features

OTHER, MAIN = 0, 1
# Elements and roles within an article that are not its text.
NOT_MAIN = frozenset(
    "in:nav in:header in:footer in:aside in:form in:menu in:button in:label role:menu role:advert "
    "role:notice role:comments role:share role:form role:side".split()
)


@dataclass(frozen=True)
class Settings:
    """``pages``: bound of the labelled sample; pages of more ``chars`` or ``blocks`` are not
    trained on, though read like any other."""

    pages: int = 400
    chars: int = 100_000
    layouts: int = 3
    blocks: int = 300
    rounds: int = 120
    rate: float = 0.15
    penalty: float = 0.02


# ---- labelled pages -------------------------------------------------------------------


def own_labels(blocks: list[Block]) -> list[int] | None:
    """Labels by the page's own markup, None if it has none."""
    labels = [
        MAIN if ({"in:article", "in:main"} & b.inside and not NOT_MAIN & b.inside) else OTHER for b in blocks
    ]
    return labels if MAIN in labels and OTHER in labels else None


LAYOUT = {
    "menu": ("nav", ("menu", "navbar", "main-nav", "breadcrumb")),
    "header": ("header", ("header", "site-header", "masthead", "top-bar")),
    "notice": ("div", ("cookie-notice", "consent", "newsletter", "popup")),
    "advert": ("div", ("ad", "advert", "sponsored", "promo-banner")),
    "side": ("aside", ("sidebar", "widget", "related", "right-rail")),
    "comments": ("section", ("comments", "comment-list", "replies")),
    "form": ("form", ("search-form", "login", "contact-form")),
    "share": ("div", ("share", "social")),
    "footer": ("footer", ("footer", "site-footer", "copyright")),
}
CONTENT = ("content", "article-body", "post", "entry-content", "story", "main-text")


def render(main: list[str], other: list[str], rng: np.random.Generator) -> str:
    """A page of the same texts in another layout, its main blocks marked."""
    words = " ".join(main + other).split() or ["text"]

    def some(low: int, high: int) -> str:
        n = int(rng.integers(low, high))
        at = int(rng.integers(0, max(1, len(words) - n)))
        return html.escape(" ".join(words[at : at + n]))

    def part(role: str) -> str:
        tag, names = LAYOUT[role]
        name = names[int(rng.integers(len(names)))]
        plain = rng.random() < 0.6 and tag != "form"
        opened = f'<div class="{name}">' if plain else f"<{tag}>" if rng.random() < 0.5 else f'<{tag} id="{name}">'
        closed = "</div>" if plain else f"</{tag}>"
        if role == "menu":
            inner = "<ul>" + "".join(f'<li><a href="#">{some(1, 3)}</a></li>' for _ in range(int(rng.integers(3, 8)))) + "</ul>"
        elif role in ("comments", "side"):
            inner = "".join(f"<p>{some(3, 60)}.</p>" for _ in range(int(rng.integers(1, 5))))
        elif role == "form":
            inner = f"<label>{some(1, 4)}</label><input><button>{some(1, 3)}</button>"
        elif role == "footer":
            inner = f"<p>&copy; {some(2, 15)}</p>"
        else:
            inner = f"<p>{some(2, 25)}.</p>" if rng.random() < 0.5 else some(2, 20)
        return opened + inner + closed

    marked = [f'<{"h1" if i == 0 else "p"} data-gold="1">{html.escape(t)}</{"h1" if i == 0 else "p"}>' for i, t in enumerate(main)]
    for role in ("advert", "side", "share"):  # within the article
        if rng.random() < 0.3:
            marked.insert(int(rng.integers(1, len(marked) + 1)), part(role))
    kind = int(rng.integers(4))
    name = CONTENT[int(rng.integers(len(CONTENT)))]
    opened = (f'<div class="{name}">', "<article>", "<main>", f'<section id="{name}">')[kind]
    closed = ("</div>", "</article>", "</main>", "</section>")[kind]
    before = [part(r) for r in ("header", "menu", "notice", "advert") if rng.random() < 0.7]
    after = [part(r) for r in ("share", "comments", "side", "form", "footer") if rng.random() < 0.7]
    return f"<html><body>{''.join(before)}{opened}{''.join(marked)}{closed}{''.join(after)}</body></html>"


def labelled_sequences(source: str, seed: int, s: Settings) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of a page and its other layouts; none if it has no labels."""
    blocks = blocks_of(source)
    labels = own_labels(blocks) if len(blocks) <= s.blocks else None
    if labels is None:
        return []
    out = [(features(blocks), labels)]
    main = [b.text for b, y in zip(blocks, labels) if y == MAIN]
    other = [b.text for b, y in zip(blocks, labels) if y == OTHER]
    rng = np.random.default_rng(seed & 0x7FFFFFFF)
    for _ in range(s.layouts):
        drawn = blocks_of(render(main, other, rng))
        out.append((features(drawn), [MAIN if b.gold else OTHER for b in drawn]))
    return out


def training_rows(pages: DataFrame, s: Settings) -> DataFrame:
    """``(sequence, features, label)`` of a bounded, seeded sample of labelled pages.

    The sample is the ``pages`` distinct pages with labels whose hashes are the least, or
    all such pages if there are fewer.
    """
    marked = pages.where(F.length("html") <= s.chars).where(
        F.lower("html").contains("<article") | F.lower("html").contains("<main")
    )
    seeded = marked.select("html", F.xxhash64("html").alias("seed"))

    def run(batches):
        for b in batches:
            rows = []
            for source, seed in zip(b["html"], b["seed"]):
                for k, (x, y) in enumerate(labelled_sequences(source, int(seed), s)):
                    rows += [(seed, f"{seed}-{k}", i, f, label) for i, (f, label) in enumerate(zip(x, y))]
            yield pd.DataFrame(rows, columns=["seed", "sequence", "i", "features", "label"])

    # a cut by hash first, so that tasks pass on few pages; copies of a page count once
    distinct = seeded.agg(F.approx_count_distinct("seed")).first()[0]
    share = min(1.0, 1.5 * s.pages / max(1, distinct))
    while True:
        cut = min(2**63 - 1, int(share * 2**64) - 2**63)
        few = seeded.where(F.col("seed") <= cut).groupBy("seed").agg(F.min("html").alias("html"))
        rows = materialize(
            few.select("html", "seed").mapInPandas(run, "seed long, sequence string, i int, features array<string>, label int"),
            "labelled_pages",
        )
        own = rows.select("seed").distinct()
        if share >= 1 or own.count() >= s.pages:
            break
        share = min(1.0, 4 * share)  # too few of the pages had labels
    sample = own.orderBy("seed").limit(s.pages)
    return rows.join(F.broadcast(sample), "seed").drop("seed")


# ---- the field ------------------------------------------------------------------------


@dataclass
class Field:
    names: dict[str, int]
    weight: np.ndarray  # features x 2
    step: np.ndarray  # label before x label

    def emissions(self, blocks: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(blocks), 2))
        for row, own in zip(out, blocks):
            at = [self.names[f] for f in own if f in self.names]
            row += self.weight[at].sum(0)
        return out

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """Viterbi: the most probable labels; of equal paths the one with less main text."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.step.tolist()
        back, score = [], None
        for x, y in self.emissions(blocks).tolist():
            if score is None:
                score = (x, y)
                continue
            p, q = score
            to_a, to_b = p + aa >= q + ba, p + ab >= q + bb
            back.append((0 if to_a else 1, 0 if to_b else 1))
            score = ((p + aa if to_a else q + ba) + x, (p + ab if to_b else q + bb) + y)
        label = 0 if score[0] >= score[1] else 1
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def train(sequences: list[tuple[list[list[str]], list[int]]], s: Settings) -> Field:
    """Weights by ascent of the penalized log-likelihood, all sequences in step."""
    names = {f: i for i, f in enumerate(sorted({f for x, _ in sequences for own in x for f in own}))}
    total = [(b, y) for x, labels in sequences for b, y in zip(x, labels)]
    row = np.repeat(np.arange(len(total)), [len(b) for b, _ in total])
    col = np.array([names[f] for b, _ in total for f in b], np.int64)
    label = np.array([y for _, y in total], np.int64)
    lengths = np.array([len(x) for x, _ in sequences])
    longest, n = int(lengths.max(initial=0)), len(sequences)
    begin = np.cumsum(lengths) - lengths
    where = begin[:, None] + np.arange(longest)[None, :]
    real = np.arange(longest)[None, :] < lengths[:, None]
    where = np.where(real, where, 0)
    gold = np.zeros((len(total), 2))
    gold[np.arange(len(total)), label] = 1
    gold_step = np.zeros((2, 2))
    inner = np.ones(len(total), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    np.add.at(gold_step, (label[at - 1], label[at]), 1)
    weight, step = np.zeros((len(names), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(step), np.zeros_like(step)]
    for k in range(1, s.rounds + 1):
        emission = np.zeros((len(total), 2))
        for y in (0, 1):
            emission[:, y] = np.bincount(row, weights=weight[col, y], minlength=len(total))
        e = emission[where]
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = log_sum(forward[:, t - 1, :, None] + step[None], 1) + e[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        z = log_sum(forward[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            new = log_sum(step[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], new, 0)
        state = np.exp(forward + backward - z[:, None, None])
        expected = np.zeros((len(total), 2))
        expected[where[real]] = state[real]
        moves = forward[:, :-1, :, None] + step[None, None] + (e[:, 1:] + backward[:, 1:])[:, :, None, :]
        moves = np.exp(moves - z[:, None, None, None]) * real[:, 1:, None, None]
        difference = gold - expected
        slope = np.stack(
            [np.bincount(col, weights=difference[row, y], minlength=len(names)) for y in (0, 1)], 1
        ) / n - s.penalty * weight
        slope_step = (gold_step - moves.sum((0, 1))) / n - s.penalty * step
        for value, g, m, v in ((weight, slope, *moments[:2]), (step, slope_step, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value += s.rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(names, weight, step)


def fit(pages: DataFrame, s: Settings) -> Field | None:
    """A field from the pages' labelled sample, None if no page has labels."""
    rows = training_rows(pages, s).toPandas()  # at most pages * (layouts + 1) * blocks rows
    rows = rows.sort_values(["sequence", "i"], kind="stable")
    sequences = [
        ([list(f) for f in g["features"]], g["label"].tolist()) for _, g in rows.groupby("sequence", sort=True)
    ]
    return train(sequences, s) if sequences else None


def main_text(field: Field | None, source: str | None) -> str:
    blocks = blocks_of(source)
    if field is None:
        return " ".join(b.text for b in blocks)
    return " ".join(b.text for b, y in zip(blocks, field.decode(features(blocks))) if y == MAIN)


def extract_text(
    pages: DataFrame,
    settings: Settings = Settings(),
    key: str = "page_id",
    url: str = "url",
    source: str = "html",
    field: Field | None = None,
) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per input row.

    A null or empty page has an empty text, as has one without main text. Broken markup is
    read as far as it goes. Where no page is labelled and no ``field`` is given, all blocks
    are text. Repeated rows and null keys are rows like any other.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(field or fit(rows.select("html"), settings))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(shared.value, h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    kind = rows.schema["page_id"].dataType.simpleString()
    return map_slices(rows, run, f"page_id {kind}, url string, text string, n_chars long", "html")
