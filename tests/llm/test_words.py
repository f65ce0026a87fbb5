"""Resampling, languages and spelling variants against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinara.llm import importance, languages, spelling
from opinara.llm.automata import Acceptor, OneEdit
from opinara.llm.crc import span_crc
from opinara.llm.words import raw_bytes
from tests.llm.helpers import AWKWARD, alnum, documents, lower

texts = st.text(st.sampled_from("abAB 1é日ÿß.\n"), max_size=30) | st.none()


@given(st.binary(max_size=700), st.data())
@settings(max_examples=150, deadline=None)
def test_crc_of_spans(data, draw):
    place = st.integers(0, len(data))
    spans = [sorted(draw.draw(st.tuples(place, place))) for _ in range(draw.draw(st.integers(0, 6)))]
    low, high = (np.array([s[i] for s in spans], dtype=np.int64) for i in (0, 1))
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(len(spans))], dtype=np.uint32)
    raw = np.frombuffer(data, np.uint8)
    assert span_crc(raw, low, high).tolist() == [zlib.crc32(data[a:b]) for a, b in spans]
    assert span_crc(raw, low, high, before).tolist() == [zlib.crc32(data[a:b], int(c)) for (a, b), c in zip(spans, before)]


# ---- resampling -----------------------------------------------------------------------


def brute_features(text):
    w = alnum(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, buckets=10_000, percent=5, least=20):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s = collections.Counter(bucket(f) for _, t in docs for f in brute_features(t))
    t = collections.Counter(bucket(f) for x in target for f in brute_features(x))
    size, wanted = sum(s.values()) + buckets, sum(t.values()) + buckets

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * size / ((s[b] + 1) * wanted)))

    rows = []
    for key, text in docs:
        f = brute_features(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(f), weight, score, None, len(alnum(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return rows


def sorted_rows(rows):
    return sorted((tuple(r)[:5] for r in rows), key=str)


def test_resampling(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Café", "日本", "x1"]
    docs = [(i * 7919 % 100_003, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(900)]
    docs += AWKWARD + [(500_000 + i, None) for i in range(3)]
    target = [" ".join(rng.choices(words[:15], k=40)) for _ in range(30)] + [None, ""]
    got = importance.resample(documents(spark, docs), documents(spark, list(enumerate(target))))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted_rows(got.collect()) == sorted_rows(brute_resample(docs, target))


def test_resampling_ties_and_empty_tables(spark):
    none = documents(spark, [])
    assert importance.resample(none, none).collect() == []
    same = [(5, "a b " * 10)] * 40 + [(6, "a b " * 10)] * 40
    got = importance.resample(documents(spark, same), none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]
    assert sorted_rows(got) == sorted_rows(brute_resample(same, []))
    few = importance.resample(documents(spark, same[:3]), documents(spark, [(1, "a b")])).collect()
    assert [r["rank"] for r in few] == [None] * 3


def test_resampling_ties_of_neighbouring_ids_in_other_tasks(spark):
    """Ids with equal scores, the larger ones in earlier parts of the table."""

    def draw(i):
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    by_draw = collections.defaultdict(list)
    for i in range(30_000):
        by_draw[draw(i)].append(i)
    tied = [i for d in sorted(by_draw, reverse=True) if len(by_draw[d]) > 1 for i in by_draw[d]][:400]
    docs = [(i, "a b " * 10) for i in sorted(tied, reverse=True)] + [(None, "a b " * 10)]
    frame = documents(spark, docs).repartitionByRange(8, -F.coalesce("doc_id", F.lit(0)))
    got = importance.resample(frame, documents(spark, [])).collect()
    assert sorted_rows(got) == sorted_rows(brute_resample(docs, []))


# ---- languages ------------------------------------------------------------------------


def brute_shares(text, s=languages.Settings()):
    plain = re.sub(r"[^a-z\x80-\U0010ffff]+", " ", f" {text.lower()} ").encode()
    out = collections.Counter()
    for k in s.lengths:
        for i in range(len(plain) - k + 1):
            mixed = (int.from_bytes(plain[i : i + k], "big") ^ k) * 0x9E3779B1 % 2**32
            out[(mixed ^ (mixed >> 15)) * 0x9E3779B1 % 2**32 >> (32 - s.bits)] += 1
    total = sum(out.values())
    return {b: n / total for b, n in out.items()}


@given(st.lists(st.text(st.sampled_from("abZÉé日 .\n1"), min_size=1, max_size=30), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_sequences_of_a_text(batch):
    for text, (at, share) in zip(batch, languages.feature_shares(pa.array(batch), languages.Settings())):
        want = brute_shares(text)
        assert dict(zip(at.tolist(), share.tolist())) == pytest.approx(want)


def test_long_texts_are_read_in_chunks(monkeypatch):
    whole = languages.feature_shares(pa.array(["one two three é"]), languages.Settings())
    monkeypatch.setattr(languages, "CHUNK", 3)
    cut = languages.feature_shares(pa.array(["one two three é"]), languages.Settings())
    assert whole[0][0].tolist() == cut[0][0].tolist() and whole[0][1].tolist() == cut[0][1].tolist()


def test_machine_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6))
    sign = np.where(x[:, 0] + 0.5 * rng.normal(size=80) > 0, 1.0, -1.0)
    rows = [(np.arange(6), v) for v in x]
    cost = np.full(80, 0.7)
    w, alpha = languages.dual_descent(rows, sign, cost, 6, 5000, 1e-9)
    full = np.hstack([x, np.ones((80, 1))])
    assert np.allclose(w, (alpha * sign) @ full)
    primal = w @ w / 2 + (cost * np.maximum(0, 1 - sign * (full @ w))).sum()
    dual = alpha.sum() - w @ w / 2
    assert primal - dual < 1e-5 * primal  # no duality gap
    assert ((alpha >= 0) & (alpha <= cost)).all()


PARTS = {
    "de": "sch ung keit der die und ein zu ge ver au ö ß".split(),
    "en": "th ing ed tion the and of is wh sh ly ou".split(),
    "es": "ción mente ado ra que de la os ñ ll rr ez".split(),
    "fr": "eau tre ment ez le la que ou é ê ç oi".split(),
    "it": "zione gli ato che di la mente cc zz ò issi are".split(),
}


def prose(rng, language, n):
    return " ".join("".join(rng.choices(PARTS[language], k=rng.randrange(1, 4))) for _ in range(n))


def test_held_out_texts_get_their_language(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, lang, rng.randrange(8, 80)), lang, "s") for i, lang in enumerate(rng.choices(sorted(PARTS), [9, 2, 3, 2, 2], k=900))]
    rows += [(5000, "1234 %% ..", "en", "s"), (5001, None, "de", "s"), (5002, "", "fr", "s"), (None, prose(rng, "de", 30), None, "s")]
    truth = {r[0]: r[2] for r in rows[:900]}
    small = languages.Settings(rows=60)  # fewer than there are of each
    model = languages.fit(documents(spark, rows), small)
    assert model.languages == {"germanic": ["de", "en"], "romance": ["es", "fr", "it"]}
    assert {k: len(v) for k, v in model.machines.items()} == {"": 1, "germanic": 1, "romance": 3}
    got = languages.predict_languages(documents(spark, rows), small, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2)
    aside = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in aside) >= 0.98 * len(aside)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (5000, 5001, 5002)] == ["und"] * 3
    assert by[None].lang_pred == "de"


def test_only_learned_rows_count(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, lang, 20), lang, "s") for i in range(80) for lang in ["de" if i % 2 else "fr"]]
    # whatever held-out rows say of their language is not read
    lied = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    a, b = (sorted(map(tuple, languages.predict_languages(documents(spark, x)).collect())) for x in (rows, lied))
    assert a == b and {r[2] for r in a} == {"de", "fr"}


def test_languages_of_awkward_rows(spark):
    none = languages.predict_languages(documents(spark, AWKWARD)).collect()  # no labels at all
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert languages.predict_languages(documents(spark, [])).collect() == []
    single = languages.predict_languages(documents(spark, [r + ("en",) for r in AWKWARD])).collect()
    assert {(r.lang_pred, r.score) for r in single} == {("en", 1.0), ("und", 0.0)}
    assert sum(r.lang_pred == "und" for r in single) == 3 and len(single) == len(AWKWARD)
    many = [(i, f"word{i}", f"l{i}") for i in range(200)]
    with pytest.raises(ValueError):
        languages.fit(documents(spark, many))


def test_families():
    assert languages.family_of("pt-BR") == "romance" and languages.family_of("DE_at") == "germanic"
    assert languages.family_of("tlh") == "tlh"


# ---- spelling -------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs, least_length=6, least_count=5):
    out = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= least_length and n >= least_count}


def brute_variants(docs):
    count = brute_words(docs)
    form, rows = {}, []
    for w, n in count.items():
        around = sorted((x for x in count if near(w, x)), key=lambda x: (-count[x], x))
        best = around[0] if around and count[around[0]] >= 5 * n else None
        form[w] = best
        rows.append((w, best, n, len(around), count[best] if best else None))
    out = []
    for w, best, n, around, form_n in rows:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, best, root, n, around, form_n))
    return sorted(out, key=str)


@given(st.sets(st.text(st.sampled_from("abé"), min_size=1, max_size=5), max_size=25))
@settings(max_examples=200, deadline=None)
def test_pairs_of_the_composition(words):
    pairs = [tuple(sorted(p)) for p in OneEdit(Acceptor(sorted(words))).pairs()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def variants_corpus():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdéß") for _ in range(rng.randrange(6, 9))) for _ in range(60)]
    docs = []
    for i in range(600):
        words = []
        for _ in range(40):
            w = base[min(59, int(rng.expovariate(0.08)))]
            k = rng.randrange(len(w))
            kind = rng.randrange(30)
            words.append(w[:k] + w[k + 1 :] if kind == 0 else w[:k] + "a" + w[k + (kind == 1) :] if kind in (1, 2) else w)
        docs.append((i, " ".join(words).replace("c", "C")))
    return docs


@pytest.mark.parametrize("largest", [20_000, 25])
def test_variants(spark, largest):
    docs = variants_corpus() + AWKWARD
    got = spelling.group_variants(documents(spark, docs), spelling.Settings(largest=largest))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == brute_variants(docs)
    assert sum(r[1] is not None for r in rows) > 50


def test_variants_of_nothing(spark):
    assert spelling.group_variants(documents(spark, [])).collect() == []
    assert spelling.group_variants(documents(spark, [(1, None), (2, ""), (None, "short")])).collect() == []
    long = [(i, "abcdefgh" * 3000) for i in range(6)]  # one very long word
    assert [tuple(r)[2:] for r in spelling.group_variants(documents(spark, long)).collect()] == [
        r[2:] for r in brute_variants(long)
    ]
