"""Near-duplicates, contamination and components against brute force."""

import collections
import hashlib
import random

import pytest

from opinara.llm.decontaminate import contamination
from opinara.llm.graph import components
from opinara.llm.near_dup import THREE_WORDS, Settings, near_duplicates
from tests.llm.helpers import AWKWARD, alnum, documents, spaced


def brute_groups(rows, k, percent):
    sets = []
    for _, text in rows:
        w = spaced(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                n = len(a & sets[j])
                if 100 * n >= percent * (len(a) + len(sets[j]) - n):
                    root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(key, len(s), least.get(find(i)), key is not None and least.get(find(i)) == key) for i, ((key, _), s) in enumerate(zip(rows, sets))]


def compare(spark, rows, settings):
    got = [tuple(r) for r in near_duplicates(documents(spark, rows), settings).collect()]
    want = brute_groups(rows, settings.words, settings.percent)
    assert sorted(got, key=str) == sorted(want, key=str)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("settings", [Settings(), THREE_WORDS], ids=["five", "three"])
def test_groups_of_awkward_rows(spark, settings):
    compare(spark, AWKWARD, settings)
    compare(spark, [], settings)


@pytest.mark.parametrize(
    "settings",
    [THREE_WORDS, Settings(words=3, percent=85, bands=24, rows=5, block=8, set_block=6)],
    ids=["one block", "many blocks"],
)
def test_copies_around_the_threshold(spark, settings):
    """A bucket of many texts some of which link and some just do not."""
    rng = random.Random(5)
    rows = []
    for g in range(4):
        base = [f"b{rng.randrange(50)}x{g}" for _ in range(150)]
        rows += [(100 * g + i, edited(rng, base, rng.randrange(0, 9))) for i in range(45)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]
    rng.shuffle(rows)
    compare(spark, rows, settings)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (101, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def brute_contamination(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = alnum(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    for key, text in rows:
        w, hit, found = alnum(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        ids = sorted(str(i) for i in found if i is not None)
        yield key, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 4, 9, 10, 11, 30]))) for i in range(20)]
    items += [(21, items[5][1]), (5, items[7][1]), (None, text(12)), (22, None), (23, "!!")]
    rows = list(AWKWARD)
    for i in range(60):
        t = text(rng.randrange(0, 80)).split()
        for _ in range(rng.randrange(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(t) + 1)
            t[at:at] = own[rng.randrange(0, 2) :]
        rows.append((100 + i, ", ".join(t).upper() if i % 2 else " ".join(t)))
    rows += rows[-5:]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in contamination(documents(spark, rows), benchmark).collect()]
    assert sorted(got, key=str) == sorted(brute_contamination(rows, items), key=str)


def test_contamination_of_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    got = [tuple(r) for r in contamination(documents(spark, AWKWARD), benchmark).collect()]
    assert sorted(got, key=str) == sorted(brute_contamination(AWKWARD, []), key=str)
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert contamination(documents(spark, []), some).count() == 0


def test_components_of_few_edges_take_few_tasks(spark, monkeypatch):
    from opinara.llm import graph

    sizes = []

    def cut(df):
        out = cut_lineage(df)
        sizes.append(out.rdd.getNumPartitions())
        return out

    cut_lineage = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", cut)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 7)], "a long, b long")
        got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert max(sizes[1:]) <= 2
