"""The training-data operators: small cases, brute force, round trips, and defined results for odd input."""

import importlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import boilerplate, encoding, leakage, mixing, neighbours, repeated_lines, splitting
from tests.compare import compare, connect
from tests.conftest import rows

MODULE = importlib.import_module("quern.llm.queries")
CASES = [(n, f, MODULE.ORACLE.get(n)) for n, f in MODULE.QUERIES.items()]


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_query(spark, small, con, name, query, sql):
    said = compare(spark, con, name, query, sql, small)
    assert " equal," in said or "no SQL" in said, said


# -- problem 1 ----------------------------------------------------------------------------------------------------


def brute_cut(unary, edges):
    best = None
    for labels in itertools.product((False, True), repeat=len(unary)):
        cost = sum(max(0, -u) if x else max(0, u) for u, x in zip(unary, labels)) + sum(c for a, b, c in edges if labels[a] != labels[b])
        if best is None or cost < best - 1e-9:
            best = cost
    return best


def test_min_cut_is_minimal():
    g = random.Random(1)
    for _ in range(300):
        n = g.randrange(1, 9)
        unary = [round(g.uniform(-3, 3), 1) for _ in range(n)]
        edges = [(a, b, round(g.uniform(0, 3), 1)) for a in range(n) for b in range(a + 1, n) if g.random() < 0.5]
        labels = boilerplate.min_cut(unary, edges)
        cost = sum(max(0, -u) if x else max(0, u) for u, x in zip(unary, labels)) + sum(c for a, b, c in edges if labels[a] != labels[b])
        assert cost == pytest.approx(brute_cut(unary, edges))


def test_narrow_pages_are_cut_as_well():
    g = random.Random(2)
    price = lambda unary, edges, labels: sum(max(0, -u) if x else max(0, u) for u, x in zip(unary, labels)) + sum(c for a, b, c in edges if labels[a] != labels[b])
    for n in (1, 2, 3, 7, 11):
        for _ in range(15):
            unary = [round(g.uniform(-3, 3), 1) for _ in range(n)]
            edges = [(i, i + d, round(g.uniform(0, 3), 1)) for i in range(n) for d in (1, 2) if i + d < n and g.random() < 0.8]
            assert price(unary, edges, boilerplate.min_cut(unary, edges)) == pytest.approx(brute_cut(unary, edges))


def test_very_long_pages_take_no_longer_by_the_line():
    import time

    g = random.Random(2)
    text = "\n".join(g.choice(["Menu", "Report on the spring seminar (Dora)", "Eve on the summer course (new)"]) for _ in range(30000))
    assert len(boilerplate.boilerplate_lines(text, {}, None, boilerplate.LineClassifier())) > 20000
    n, t = 60000, time.time()
    unary = [g.choice((1, -1)) * g.uniform(0.1, 1) for _ in range(n)]
    edges = [(i, i + d, 2.0) for i in range(n) for d in (1, 2) if i + d < n]  # nothing is settled before the flow
    assert len(boilerplate.min_cut(unary, edges)) == n and time.time() - t < 30


PAGE = """Menu
» Research
» Library
Home > Research > How Ann planned the workshop
How Ann planned the workshop
The workshop on optics was planned by Ann together with the staff of the library, and took place in May.
• Bob: second session, room 4
Contact: Carl Young
Upcoming
Report on the spring seminar (Dora)
Eve on the summer course (new)
View all
If it rains, the seminar takes place in the old hall, and Fay informs the group by noon.
Share this page
© 2024 The Institute. All rights reserved.
Privacy Policy | Terms of Use | Sitemap"""


def test_page_body(spark):
    df = spark.createDataFrame(
        [("a", PAGE, "How Ann planned the workshop", "x"), ("a", PAGE, "How Ann planned the workshop", "x"), ("b", "", None, "x"), ("c", None, None, "x"), (None, PAGE, None, "x"), ("d", "One line of text that says something.", None, "x")],
        "id string, text string, title string, held string",
    )
    got = {}
    for i, n in rows(boilerplate.page_boilerplate(df)):
        got.setdefault(i, []).append(n)
    assert got == {"a": [1, 2, 3, 4, 9, 10, 11, 12, 14, 15, 16]} or sorted(got["a"]) == [1, 2, 3, 4, 9, 10, 11, 12, 14, 15, 16]
    assert set(got) == {"a"}
    out = boilerplate.main_content(df)
    assert out.count() == 6 and out.columns == ["id", "text", "title", "held", "main_text"]
    body = {r["id"]: r["main_text"] for r in out.collect()}
    assert body["a"].split("\n")[0] == "How Ann planned the workshop" and body["b"] == "" and body["c"] is None
    assert boilerplate.page_boilerplate(df.limit(0)).count() == 0


def test_long_lines_are_counted_over_the_pages(spark):
    notice = "This service of the institute is kept by its staff and " + "by the friends of the house and " * 9 + "by all who visit it on any day of the year."
    name = lambda i: "".join(chr(97 + i // 5**k % 5) for k in range(5))
    own = lambda i, k: f"The talk of {name(i * 2 + k)} on the history of {name(i * 7 + k)} was held in the old hall and went on until the evening."
    df = spark.createDataFrame([(f"p{i:02}", "\n".join([own(i, 1), own(i, 2), "", notice, "Share this page", "© 2024 The Institute. All rights reserved."]), None) for i in range(60)], "id string, text string, title string")
    assert len(notice) > 300 and all({x["line_no"]: x["n"] for x in r["held"]} == {4: 60, 5: 60, 6: 60} for r in boilerplate._pages(df).collect())
    assert boilerplate.line_features(notice, 60, "")["repeated"] == 5.0


# -- problem 3 ----------------------------------------------------------------------------------------------------


def long_text(seed, n):
    g = random.Random(seed)
    words = []
    for _ in range(n):
        words.append("".join(g.choice("abcdefghij") for _ in range(g.randrange(1, 11))) + g.choice(["", "", "", ",", ".", ".\n", ".\n\n"]))
    return " ".join(words)


def check_pieces(text, pieces):
    at = 0
    for i, r in enumerate(pieces):
        assert r["piece_no"] == i + 1 and r["n_tokens"] <= 750
        assert text[r["start_at"] : r["end_at"]] == r["piece"] and splitting.tokens_of(r["piece"]) == r["n_tokens"]
        assert not text[at : r["start_at"]].strip() if r["start_at"] > at else True
        assert r["end_at"] > at
        if 0 < i:
            shared = text[r["start_at"] : at]
            assert splitting.tokens_of(shared) <= 110
            if max(map(len, text.split())) < 50:
                assert splitting.tokens_of(shared) >= 90
        at = r["end_at"]
    assert not text[at:].strip()


@pytest.mark.parametrize("text", [long_text(1, 2000), long_text(2, 60000), "x" * 9000, ("y" * 5000 + " ") * 3, " \n" * 50 + long_text(3, 900) + "\n" * 40, "é😀 " * 3000], ids=["plain", "many ranges", "no space", "long words", "blank ends", "wide"])
def test_pieces(spark, text):
    df = spark.createDataFrame([("k", text, "clash")], "id string, text string, piece string")
    check_pieces(text, splitting.split_items(df).orderBy("piece_no").collect())


@pytest.mark.parametrize("text", [
    "x" * 9000, "".join(chr(97 + i * i % 26) for i in range(200_000)), ("y" * 5000 + " ") * 3, ("z" * 700 + " ") * 40, ("w" * 100 + " ") * 300,
    "a b c " * 300 + "v" * 30_000 + " d e f" * 300, "u" * 65_530 + " " * 3 + "u" * 9000,
], ids=["no space", "many ranges", "long words", "words over the overlap", "longer words", "run amid words", "run to the end of a range"])
def test_the_overlap_goes_into_long_words(spark, text):
    got = splitting.split_items(spark.createDataFrame([("k", text)], "id string, text string")).orderBy("piece_no").collect()
    check_pieces(text, got)
    shared = [splitting.tokens_of(text[b["start_at"] : a["end_at"]]) for a, b in zip(got, got[1:])]
    assert shared and min(shared) >= 90 and max(shared) <= 110
    if " " not in text:  # no boundary: pieces are as long as the limit allows
        assert sorted(r["n_tokens"] for r in got)[len(got) // 2] >= 740


def test_words_are_kept_whole_where_they_can_be(spark):
    text = ("w" * 100 + " ") * 300 + ("z" * 990 + " ") * 30
    got = splitting.split_items(spark.createDataFrame([("k", text)], "id string, text string")).orderBy("piece_no").collect()
    assert all(text[r["end_at"]] == " " for r in got[:-1])


def test_pieces_end_at_natural_boundaries(spark):
    text = long_text(5, 3000)
    got = splitting.split_items(spark.createDataFrame([("k", text)], "id string, text string")).orderBy("piece_no").collect()
    assert all(text[r["end_at"] :].lstrip(" ").startswith("\n") or r["piece"].endswith(".") for r in got[:-1])


def test_oversized(spark):
    exact, over = "a " * 575 + "b", "a " * 576 + "b"  # 576 and 577 words
    assert splitting.tokens_of(exact) == 749 and splitting.tokens_of(over) == 751
    data = [("1", exact), ("2", over), ("2", over), ("3", None), (None, over), ("4", ""), ("5", " " * 9000), ("6", "x" * 2996), ("7", "x" * 3000), ("8", " " * 70000 + over + "\n" * 70000), ("9", " " * 4000 + "z")]
    df = spark.createDataFrame(data, "id string, text string")
    assert rows(splitting.oversized(df), "id", "n_tokens") == [("2", 751), ("7", 751), ("8", 751)]
    assert {r["id"] for r in splitting.split_items(df).collect()} == {"2", "7", "8"}
    assert splitting.oversized(df.limit(0)).count() == 0 and splitting.split_items(df.limit(0)).count() == 0


def test_files_in_byte_ranges(spark, tmp_path):
    text = long_text(9, 40000).replace("a", "ä")
    (tmp_path / "f.txt").write_text(text)
    (tmp_path / "g.txt").write_text("")
    got = splitting.split_files(spark, [str(tmp_path / "f.txt"), str(tmp_path / "g.txt")]).orderBy("piece_no").collect()
    data = text.encode()
    covered = 0
    for i, r in enumerate(got):
        assert r["piece_no"] == i + 1
        piece = r["piece"].encode()
        assert data[r["start_byte"] : r["start_byte"] + len(piece)] == piece and splitting.tokens_of(r["piece"]) <= 750
        assert not data[covered : r["start_byte"]].strip()
        covered = max(covered, r["start_byte"] + len(piece))
    assert not data[covered:].strip()


# -- problem 4 ----------------------------------------------------------------------------------------------------


def brute_lines(data, k=5, share=0.02):
    import string

    drop = str.maketrans("", "", string.digits + string.punctuation)
    norm = lambda x: "".join(x.lower().split()).translate(drop)
    known = {(s, i, t) for s, i, t in data if None not in (s, i, t)}
    ids, held = {}, {}
    for s, i, t in known:
        ids.setdefault(s, set()).add(i)
        for line in t.split("\n"):
            if norm(line):
                held.setdefault((s, norm(line)), set()).add(i)
    return {(i, n) for s, i, t in known for n, x in enumerate(t.split("\n"), 1) if norm(x) and len(held[s, norm(x)]) >= max(k, share * len(ids[s]))}


def test_repeated_lines(spark):
    g = random.Random(4)
    notice = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(200))
    menu = ["Menu", "Legal  NOTICE 2024!", notice, notice + " x", notice[:300], "शेयर करें", "12 34", "", "…"]
    data = []
    for i in range(400):
        source = "hot" if g.random() < 0.6 else f"s{g.randrange(5)}"
        lines = [g.choice([x, x.upper(), " ".join(x), f"{x} 7"]) for x in menu if g.random() < 0.1] + [f"own line {chr(97 + i % 26)}{chr(97 + i // 26)} {g.random()}"]
        data.append((source, f"id{i % 380}" if i < 380 else f"id{i - 380}", "\n".join(lines)))
    data = data[:380] + data[:5] + [(None, "x", "Menu"), ("hot", None, "Menu"), ("hot", "n", None), ("few", "a", "Menu"), ("few", "b", "Menu")]
    df = spark.createDataFrame([(*r, 1) for r in data], "source_id string, id string, text string, line int")
    got = {(r["id"], r["line_no"]) for r in repeated_lines.repeated_lines(df).collect()}
    assert got == brute_lines(data)
    clean = repeated_lines.without_repeated_lines(df)
    assert clean.count() == len(data) and clean.where("n_cut > 0").count() > 0
    assert repeated_lines.repeated_lines(df.limit(0)).count() == 0


def test_chunks_depend_on_content_alone():
    g = np.random.default_rng(5)
    core = g.integers(97, 123, 3000, dtype=np.uint8)
    cuts = []
    for pad in (0, 777):
        data = np.concatenate([g.integers(97, 123, pad, dtype=np.uint8), core])
        _, _, ends = repeated_lines.cut_points(data, np.array([0]), np.array([len(data)]))
        cuts.append({int(e) - pad for e in ends if e - pad > 100})
    assert cuts[0] == cuts[1] and len(cuts[0]) > 10
    span = repeated_lines.SpanHash(np.concatenate([core, core]))
    assert span(np.array([10, 3010]), np.array([90, 3090])).tolist()[0] == span(np.array([3010]), np.array([3090]))[0]


# -- problem 5 ----------------------------------------------------------------------------------------------------


def vectors(n, families, seed=0):
    g = np.random.default_rng(seed)
    base = g.standard_normal((families, 64))
    m = np.concatenate([base[g.integers(0, families, n // 2)] + 0.3 * g.standard_normal((n // 2, 64)), g.standard_normal((n - n // 2, 64))])
    return m.astype(np.float32)


def brute_pairs(ids, providers, m, k=10, least=0.85):
    u = m / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(ids)):
        near = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and providers[i] == providers[j] and s[i, j] >= least)[:k]
        out |= {tuple(sorted((ids[i], b))) for _, b in near}
    return out


def test_neighbours_recall(spark):
    m = vectors(3000, 200)
    ids, providers = [f"v{i:05d}" for i in range(len(m))], ["P" if i % 3 else "q" for i in range(len(m))]
    df = spark.createDataFrame([(i, p if n % 2 else f" {p.upper()} ", v.tolist(), n) for n, (i, p, v) in enumerate(zip(ids, providers, m))], "id string, embed_provider string, embedding array<float>, node int")
    want = brute_pairs(ids, [p.lower() for p in providers], m)
    got = {tuple(r) for r in neighbours.neighbour_pairs(df, min_cosine=0.85).collect()}
    assert len(want) > 1000 and len(got & want) >= 0.97 * len(want)
    narrow = {tuple(r) for r in neighbours.neighbour_pairs(df, min_cosine=0.85, candidates=512).collect()}
    assert len(narrow & want) >= 0.9 * len(want)  


def test_neighbours_in_dense_clusters(spark):
    g = np.random.default_rng(4)
    m = (g.standard_normal((2, 64))[np.arange(500) % 2] + 0.1 * g.standard_normal((500, 64))).astype(np.float32)
    ids = [f"v{i:05d}" for i in range(len(m))]
    df = spark.createDataFrame([(i, "p", v.tolist()) for i, v in zip(ids, m)], "id string, embed_provider string, embedding array<float>")
    assert {tuple(r) for r in neighbours.neighbour_pairs(df, min_cosine=0.85).collect()} == brute_pairs(ids, ["p"] * len(ids), m)


def test_depths_of_large_cells(spark):
    """Sums of packed counts stay below the sign of a long: cells of 3,000 in each of 12 trees."""
    strings = spark.range(3000).select(F.explode(F.sequence(F.lit(0), F.lit(neighbours.TREES - 1))).alias("block"), F.lit(1).cast("long").alias("space"), F.col("id").alias("code"), F.col("id").alias("node"), F.lit(True).alias("ask"))
    for candidates, depth in ((1024, 36), (2999 * neighbours.TREES, 36), (3000 * neighbours.TREES, 0)):
        found = neighbours.depths(strings, neighbours.TREES, candidates)
        assert [tuple(r) for r in found.groupBy("depth").count().collect()] == [(depth, 3000)]


def test_neighbours_odd_rows(spark):
    v = [1.0] * 64
    w = [1.0] * 63 + [0.9]
    data = [("a", "p", v), ("a", "p", v), ("b", "P ", [2.0] * 64), ("c", "p", w), ("d", "p", v + [5.0]), ("e", "p", [1.0] * 63), ("f", "q", v), ("g", None, v), ("h", "", v), ("i", " Legacy:Unknown", v), ("j", "p", None),
            ("k", "p", [0.0] * 64), ("l", "p", []), (None, "p", v), ("m", "p", [-1.0] * 64), ("n", "q", [float("nan")] + [1.0] * 63)]
    df = spark.createDataFrame(data, "id string, embed_provider string, embedding array<float>")
    got = {tuple(r) for r in neighbours.neighbour_pairs(df, min_cosine=0.85).collect()}
    assert got == {tuple(sorted(p)) for p in itertools.combinations("abcde", 2)} | {("f", "n")}
    assert neighbours.neighbour_pairs(df.limit(0), min_cosine=0.85).count() == 0


def test_a_class_of_copies_gives_no_pairs_beyond_k(spark):
    data = [(f"c{i:04d}", "p", [1.0] * 64) for i in range(700)] + [("z", "p", [1.0] * 63 + [0.8])]
    found = neighbours.nearest(spark.createDataFrame(data, "id string, embed_provider string, embedding array<float>"), min_cosine=0.85)
    assert found.groupBy("key_a").count().agg(F.max("count"), F.min("count")).first() == (10, 10)
    assert found.count() == 7010


# -- problem 7 ----------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, k=13):
    import re

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda t: {tuple(words(t)[i : i + k]) for i in range(len(words(t)) - k + 1)}
    sides = [(i, grams(t)) for i, t in items]
    return {(d, i) for d, t in docs for i, s in sides if grams(t) & s}


def test_leaks(spark):
    g = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(g.choice(vocabulary) for _ in range(g.randrange(5, 60)))) for i in range(30)]
    items += [(99, items[3][1].upper()), (100, "the " * 40)]
    docs = []
    for d in range(300):
        words = [g.choice(vocabulary + ["other"]) for _ in range(g.randrange(0, 200))]
        if g.random() < 0.4:
            part = g.choice(items)[1].split()
            n = g.choice([11, 12, 13, 14, 30])
            a = g.randrange(max(1, len(part) - n + 1))
            cut = part[a : a + n]
            words[len(words) // 2 : len(words) // 2] = [g.choice([w, w.upper(), f"«{w}»,", w + " –"]) for w in cut]
        docs.append((d, " ".join(words)))
    docs += [(500, "The the " * 20), (501, ""), (502, "the " * 12)]
    df = spark.createDataFrame([(*x, 1) for x in docs] + [(None, items[20][1], 1), (503, None, 1)], "doc_id long, text string, item_id int")
    side = spark.createDataFrame(items + [(None, "x"), (7, None)], "item_id long, text string")
    found = leakage.leaked_items(df, side)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute_leaks(docs, items)
    row = found.where("doc_id = 500 and item_id = 100").first()
    assert row["n_words"] == 40 and row["doc_word"] == 0
    assert leakage.without_leaks(df, side).count() == df.count() - len({d for d, _ in brute_leaks(docs, items)})
    assert leakage.leaked_items(df.limit(0), side).count() == 0 and leakage.leaked_items(df, side.limit(0)).count() == 0


def test_leaks_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 50)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    got = leakage.leaked_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "item_id", "n_words") == [(i, i, 20) for i in range(5)]


# -- problem 8 ----------------------------------------------------------------------------------------------------


def test_mixture(spark):
    g = random.Random(8)
    docs = []
    for i in range(3000):
        s = g.choices(["big", "mid", "small", "else"], [60, 20, 4, 16])[0]
        docs.append((i, s, " ".join(g.choice({"big": "apple pear plum", "mid": "iron zinc lead", "small": "cat dog cow", "else": "red blue green"}[s].split()) for _ in range(g.randrange(5, 80))), 1))
    docs += [(None, "big", "x", 1), (9001, None, "x", 1), (9002, "big", None, 1), (9003, "big", "", 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, label int")
    targets = spark.createDataFrame([("big", 0.3, None), ("mid", 0.3, 3), ("small", 0.2, 4), ("small", 0.2, 4), ("gone", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.mixture_report(df, targets).collect()}
    assert set(got) == {"big", "mid", "small", "gone"}
    for s, aim in (("big", 0.375), ("mid", 0.375), ("small", 0.25)):
        assert got[s]["share_aimed_at"] == pytest.approx(aim) and got[s]["share_reached"] == pytest.approx(aim, abs=0.004)
        assert got[s]["max_repeats"] is None or got[s]["most_repeats"] <= got[s]["max_repeats"]
    assert got["gone"]["tokens_mixed"] == 0 and got["gone"]["share_reached"] == 0
    mixed, _ = mixing.mixture(df, targets)
    assert mixed.where("source = 'else' or repeats < 1 or n_tokens < 1").count() == 0
    assert rows(mixed) == rows(mixing.mixture(df, targets)[0])  # the same again
    assert mixing.mixture(df.limit(0), targets)[0].count() == 0 and mixing.mixture(df, targets.limit(0))[0].count() == 0


# -- problem 9 ----------------------------------------------------------------------------------------------------

CLEAN = [
    "Die Gebühr für die jährliche Prüfung beträgt ₹3432 – „sehr günstig“, erklärte Kelsté Bäck.",
    "L’année dernière, la réunion d’été a réuni 214 élèves à l’école, précise André.",
    "¿Necesita la formación básica de energía? El niño recomienda las 18 primeras lecciones – ¡según José!",
    "खुली कृषि परियोजना के लिए केवल 14 स्थान हैं, इसलिए समय पर पत्र लिखें।",
    "The café near Tarn Hall isn’t open – “please wait”, said Zoë Ångström.",
]
PLAIN = [
    "SÃO BENTO DAS ÁGUAS and CORAÇÃO DO VALE", "Ãngelo Conceição joined; Âmbar Leitão stayed", "Â propos de l’Âge d’or", "Приветствие участникам: Різдво, Гірський, в Москве", "Χαιρετισμός προς όλους",
    "Ø 12 µm, ±3 °C, § 4, μm and αβ", "had “â€™” where an apostrophe should be", "shows up as “MarÃ\xada” or “BjÃ¶rn”", "writes � for any sign it lacks", "„Ä“ and “Å”", "col·lecció", "", "plain", "El «Ñandú» y L’Haÿ-les-Roses",
]


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", CLEAN)
def test_round_trip(text, wrong):
    seen = encoding.read_as(text.encode(), wrong)
    if seen is None:
        pytest.skip("that encoding has no such character")
    out, fixed, lost = encoding.restore(seen)
    assert (out, lost) == (text, 0) and fixed > 0


@pytest.mark.parametrize("text", CLEAN)
def test_twice_garbled(text):
    out, fixed, _ = encoding.restore(encoding.read_as(encoding.read_as(text.encode(), "cp1252").encode(), "cp1252"))
    assert out == text and fixed > 0


@pytest.mark.parametrize(("true", "wrong"), [("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1252", "cp1251")])
def test_single_byte_pairs(true, wrong):
    text = "Kelström and Brandão met at the café; Lamñez wrote the Prüfung."
    out, fixed, _ = encoding.restore(text.encode(true).decode(wrong))
    assert out == text and fixed >= 4


@pytest.mark.parametrize("text", PLAIN + CLEAN)
def test_correct_text_is_left_alone(text):
    assert encoding.restore(text) == (text, 0, 0)


def test_mixed_text_keeps_its_correct_part():
    mixed = CLEAN[0] + "\n" + encoding.read_as(CLEAN[1].encode(), "cp1252") + "\n" + PLAIN[0]
    assert encoding.restore(mixed)[0] == CLEAN[0] + "\n" + CLEAN[1] + "\n" + PLAIN[0]


def test_garbled(spark):
    data = [(1, CLEAN[0]), (2, "caf� and Ob�ez"), (3, "KelstÃ© came"), (4, None), (None, "KelstÃ©"), (5, ""), (6, "x " * 50000 + "KelstÃ© came"), (7, PLAIN[8])]
    df = spark.createDataFrame([(*r, "c") for r in data], "doc_id long, text string, restored string")
    got = {r["doc_id"]: (r["restored"], r["text"][-12:]) for r in encoding.garbled(df).collect()}
    assert got == {2: (False, "f� and Ob�ez"), 3: (True, "Kelsté came"), 6: (True, " Kelsté came")}
    assert encoding.garbled(df.limit(0)).count() == 0


def test_chunk_counts_settle_lines(spark, monkeypatch):
    """The documents counted by chunk decide: with one document less for each chunk, lines at the bound are lost."""
    notice = "all material on this site is protected and may not be reproduced without the written permission of the institute and its members"
    data = [(f"d{i}", "s", f"{notice}\nown line number {chr(97 + i) * 9} of this page\nshort") for i in range(5)]
    data += [(f"e{i}", "s", f"{chr(97 + i) * 9} begins a line whose end is not its own\n{chr(97 + i) * 7}\nshort {notice}") for i in range(5)]
    df = spark.createDataFrame(data, "id string, source_id string, text string")
    want = {(f"d{i}", n) for i in range(5) for n in (1, 3)} | {(f"e{i}", 3) for i in range(5)}
    assert {(r["id"], r["line_no"]) for r in repeated_lines.repeated_lines(df).collect()} == want
    whole = repeated_lines.frequent_chunks
    monkeypatch.setattr(repeated_lines, "frequent_chunks", lambda lines, sizes, least, share: whole(lines, sizes, least + 1, share))
    assert {(r["id"], r["line_no"]) for r in repeated_lines.repeated_lines(df).collect()} < want


def _vector_frame(spark, m):
    return spark.createDataFrame([(f"v{i:05d}", "p", v.tolist()) for i, v in enumerate(m)], "id string, embed_provider string, embedding array<float>")


def test_cells_against_brute_force():
    g = np.random.default_rng(1)
    code = np.sort(g.integers(0, 1 << 63, 400) >> g.integers(0, 40, 400) << 3)
    space = np.sort(g.integers(0, 3, 400))
    order = np.lexsort((code, space))
    space, code = space[order], code[order]
    for depth in (1, 7, 23, 63):
        want = [sum(space[i] == space[j] and code[i] >> (63 - depth) == code[j] >> (63 - depth) for j in range(400)) - 1 for i in range(400)]
        assert neighbours.cell_sizes(space, code, depth).tolist() == want


def test_ascent_decides_and_blocks_do_not(spark, monkeypatch):
    df = _vector_frame(spark, vectors(3000, 200))
    pairs = lambda: {tuple(r) for r in neighbours.neighbour_pairs(df, min_cosine=0.85, candidates=256).collect()}
    whole = pairs()
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 250)
    assert pairs() == whole  # thirteen blocks a tree; cells that reach over an end are looked up on both sides
    steps = neighbours.depths
    monkeypatch.setattr(neighbours, "depths", lambda *a: steps(*a).withColumn("depth", F.lit(63)))
    assert len(pairs()) < 0.9 * len(whole)  # without the ascent only equal strings meet


def test_boundaries_decide_what_is_oversized(spark, monkeypatch):
    df = spark.createDataFrame([("k", "one word and another " * 400), ("s", "short")], "id string, text string")
    assert rows(splitting.oversized(df), "id") == [("k",)]
    tables = splitting.boundary_tables
    monkeypatch.setattr(splitting, "boundary_tables", lambda *a, **o: tables(*a, **o).withColumn("starts", F.slice("starts", 1, 1)))
    assert splitting.oversized(df).count() == 0  # a text in which no cut is found isn't one to cut


def test_prefix_sums_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(splitting, "SUM_BLOCK", 3)
    df = spark.createDataFrame([("a", i, i * i) for i in range(11)] + [("b", 5, 7)], "key string, at int, n int")
    assert rows(splitting.sums_before(df, ["key"], "at", "n"), "key", "at", "before") == sorted([("a", i, sum(j * j for j in range(i))) for i in range(11)] + [("b", 5, 0)], key=repr)


def test_a_text_of_many_ranges_in_linear_time(spark):
    import time

    text = "Some words of a very long text. " * 1_000_000
    df = spark.createDataFrame([("k", text)], "id string, text string")
    t = time.time()
    got = splitting.split_items(df).agg(F.count("*"), F.max("piece_no"), F.max("n_tokens"), F.max("end_at")).first()
    assert got[0] == got[1] > 10_000 and got[2] <= 750 and got[3] == len(text) - 1 and time.time() - t < 60


def test_longest_matches_against_brute_force(monkeypatch):
    g = random.Random(8)
    for round_ in range(30):
        size = g.choice((2, 3, 12))
        text = lambda n: " ".join(f"w{g.randrange(size)}" for _ in range(n))  # noqa: E731, B023
        texts, items = [text(g.randrange(60)) for _ in range(8)], [text(g.randrange(40)) for _ in range(6)]
        side = leakage.Items(list(range(6)), items, 4)
        owner, words = leakage.split_words(leakage.pa.array(texts))
        numbers = leakage.pc.fill_null(leakage.pc.index_in(words, value_set=side.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        want = {}
        for d, t in enumerate(texts):
            for i, x in enumerate(items):
                a, b = t.split(), x.split()
                best = max((n for p in range(len(a)) for q in range(len(b)) for n in [next((m for m in range(len(a) + len(b)) if p + m >= len(a) or q + m >= len(b) or a[p + m] != b[q + m]))]), default=0)
                if best >= 4:
                    want[d, i] = best
        found = list(zip(*(x.tolist() for x in leakage.longest_matches(side, owner, numbers))))
        assert {(d, i): n for d, i, n, _, _ in found} == want and len(found) == len(want)
        for d, i, n, p, q in found:
            assert texts[d].split()[p : p + n] == items[i].split()[q : q + n]


def test_repetitive_texts_take_linear_time(spark):
    import time

    docs = spark.createDataFrame([(1, "again " * 10_000), (2, "again and " * 5_000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "again " * 10_000)], "item_id long, text string")
    t = time.time()
    assert [tuple(r) for r in leakage.leaked_items(docs, items).select("doc_id", "item_id", "n_words").collect()] == [(1, 7, 10_000)]
    assert time.time() - t < 20


SCRIPTS = {
    "fr": "Où est passé l’élève déçu ? Ça coûte 5 €.", "de": "Größe und Äpfel für Mädchen – schön", "es": "¿Dónde está el niño? ¡Qué año!", "hi": "यह एक हिन्दी वाक्य है",
    "ru": "Это русское предложение о погоде", "uk": "надії та мрії їхні дії", "el": "Αυτή είναι μια ελληνική πρόταση", "ar": "مرحبا بالعالم هذا نص", "he": "שלום עולם זה טקסט",
    "th": "ภาษาไทยเป็นภาษา", "ko": "한국어 문장입니다", "ja": "日本語の文章です。これは試験です。", "zh": "中文文本，这是测试", "ta": "தமிழ் மொழி வாக்கியம்", "emoji": "well done 😀🎉 indeed",
    "pl": "Zażółć gęślą jaźń", "cs": "Příliš žluťoučký kůň",
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_round_trips_over_all_encodings(name):
    text = SCRIPTS[name]
    assert encoding.restore(text) == (text, 0, 0)
    mixed = "A line of correct text.\n{}\nNoch eine Zeile, schön und gut."
    for wrong in encoding.WRONG:
        seen = encoding.read_as(text.encode(), wrong)
        if seen is None or seen == text:
            continue
        out, fixed, lost = encoding.restore(mixed.format(seen))
        assert fixed and (lost or out == mixed.format(text)), (wrong, out)
    for wrong in encoding.WIDE:
        try:
            seen = text.encode().decode(wrong)
        except UnicodeDecodeError:
            continue
        out, fixed, lost = encoding.restore(seen)
        assert not fixed or lost or out == text, (wrong, out)


def test_other_pairs_of_encodings():
    zh, ko, ru = "这是一个简单的测试文本，用于检查", "이것은 간단한 테스트 문장입니다", "Привет мир Это хороший текст"
    assert encoding.restore(zh.encode("gbk").decode("latin-1")) == (zh, 1, 0)
    assert encoding.restore(ko.encode("euc_kr").decode("latin-1"))[2] > 0  # found, but what it was can't be told from Chinese
    assert encoding.restore(ru.encode("koi8_r").decode("cp1251")) == (ru, 1, 0)
    assert encoding.restore(ru.encode("cp1251").decode("koi8_r")) == (ru, 1, 0)
    assert encoding.restore("café naïve Größe ‘x’s".encode().decode("gbk"))[0] == "café naïve Größe ‘x’s"
    for right in ("模型很好，iPhone模型", "3D模型", "ПРИВЕТ МИР", "iPHONE", "ÄÖÜäöü ßÀÉÈÊ", "«Élève» – ‘été’…", "not́e", "3 × 4 × 5", "ÀàÂâÇçÉéÈèÊê"):
        assert encoding.restore(right) == (right, 0, 0), right


def test_the_squares_fall_and_expected_shares_come_near(spark):
    """Documents of one source are of two kinds; those that look like what the mixture lacks are taken more often."""
    g = random.Random(5)
    kinds = {"a": "apple pear plum cherry", "b": "iron zinc lead copper"}
    text = lambda k: " ".join(g.choice(kinds[k].split()) for _ in range(40))
    docs = [(i, "a", text("a" if i % 3 else "b")) for i in range(1500)] + [(2000 + i, "b", text("b")) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 4), ("b", 0.7, 2)], "source string, target_share double, max_repeats int")
    mixed, plan = mixing.mixture(df, targets)
    kind = {d: "b" if "zinc" in t or "iron" in t else "a" for d, _, t in docs}
    taken = {k: sum(r["repeats"] for r in mixed.where("source = 'a'").collect() if kind[r["doc_id"]] == k) for k in "ab"}
    assert taken["a"] / 1000 < 0.8 * taken["b"] / 500 or taken["b"] / 500 < 0.8 * taken["a"] / 1000
    assert sum(p[-1] for p in plan) == pytest.approx(1, abs=0.01)


def test_nearest_of_a_stated_set_without_a_least_cosine(spark):
    m = vectors(3000, 200)
    df = _vector_frame(spark, m)
    found = neighbours.nearest(df, asked=F.substring("key", -1, 1) == "0")
    got = {}
    for r in found.collect():
        got.setdefault(r["key_a"], set()).add(r["key_b"])
    assert set(got) == {f"v{i:05d}" for i in range(0, 3000, 10)} and all(len(x) == 10 for x in got.values())
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    hit = 0
    for i in range(0, 3000, 10):
        s = u @ u[i]
        s[i] = -2
        hit += sum(f"v{j:05d}" in got[f"v{i:05d}"] for j in np.argsort(-s)[:10])
    assert hit >= 0.95 * 3000
