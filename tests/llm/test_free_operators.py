"""Operators on hand-made tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docsieve.llm import decontaminate, license_scan, simhash, token_counts, topk, toxicity

random.seed(5)
SYL = ["an", "the", "er", "tion", "of", "é", "x"]


def words(n, rng=random):
    return [rng.choice(SYL) + rng.choice(SYL) for _ in range(n)]


BASE = " ".join(words(400))
DOCS = [
    (1, BASE), (2, BASE), (3, BASE.replace("theer", "erthe", 1)), (4, None), (5, ""), (6, " \n\t "), (7, "One"), (8, "one two"),
    (9, " ".join(words(5000))), (10, "x" * 3000), (11, "Ünïcode ÀB cd\nline two\n\n\nend"), (11, "Ünïcode ÀB cd\nline two\n\n\nend"),
    (None, BASE.upper()), *[(100 + i, " ".join(words(30))) for i in range(30)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", "s", 3) for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, fp string, n long").repartition(3)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_simhash_against_all_pairs(spark, docs):
    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(s), 42) for s in (zip(w, w[1:], w[2:]) if len(w) > 2 else [w])]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in DOCS]
    near = [{j for j in range(len(DOCS)) if (fps[i] ^ fps[j]).bit_count() <= 3} for i in range(len(DOCS))]
    want = []
    for i in range(len(DOCS)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want.append((DOCS[i][0], f"{fps[i]:016x}", min((DOCS[j][0] for j in seen if DOCS[j][0] is not None), default=None)))
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_golay_keys_meet_at_distance_one():
    code = simhash.Golay()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 500)
    keys, fresh = code.keys(x)
    assert set(fresh.sum(1)) <= {1, 6}
    for bit in range(23):
        own = code.index(x ^ 1 << bit)
        assert all(o in k for o, k in zip(own, keys))


def test_fingerprint_links_are_complete(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:30]:
        g = f
        for _ in range(rng.randint(1, 6)):
            g ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.append(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {r["fp"]: r["root"] for r in simhash.links(spark.createDataFrame([(f,) for f in set(signed)], "fp long"), 3).collect()}
    parent = {f: f for f in signed}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            a, b = top(signed[a]), top(signed[b])
            parent[max(a, b)] = min(a, b)
    assert found == {f: top(f) for f in signed}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[i] == 1000 for i in range(1001, 1100))


ITEMS = [(1, " ".join(BASE.split()[50:90])), (2, "One two"), (3, None), (4, ""), (5, "..."), (6, " ".join(words(30))), (6, "line end"), (10, " ".join(BASE.split()[55:70]))]


def brute_windows(text, items, window=10):
    w = alnum(text)
    hit, found = set(), set()
    for item, body in items:
        b = alnum(body)
        m = min(window, len(b))
        for p in {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else ():
            for at in range(len(w) - m + 1):
                if tuple(w[at : at + m]) == p:
                    hit |= set(range(at, at + m))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 120])
def test_decontamination_against_all_windows(spark, docs, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r["id"], r["n_words"], r["n_hit"], r["items"], sum(s["last_word"] - s["first_word"] + 1 for s in r["spans"]))
           for r in decontaminate.contamination(docs, items, block_bytes=block, shard_words=300).collect()]
    want = [(i, *(b := brute_windows(t, ITEMS)), b[1]) for i, t in DOCS]
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = decontaminate.remove_spans(docs, items, block_bytes=block)
    assert clean.columns == docs.columns and clean.count() == len(DOCS)
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert kept[4] is None and kept[9] == DOCS[8][1] and kept[8] == ""
    assert len(alnum(kept[1])) == 400 - brute_windows(BASE, ITEMS)[1]


def test_decontamination_with_text_ids(spark, docs):
    items = spark.createDataFrame([(f"item-{i}", t) for i, t in ITEMS], "item_id string, text string")
    got = {(str(r["id"]), ",".join(r["items"])) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {(str(i), ",".join(sorted(f"item-{x}" for x in brute_windows(t, ITEMS)[2]))) for i, t in DOCS}


def test_decontamination_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.contamination(docs, none).collect()} == {0}
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 700)
    index = decontaminate.FMIndex(text)
    for m in (1, 2, 3, 6):
        phrases = np.array([text[i : i + m] for i in rng.integers(0, 600, 40)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            places = sorted(index.locate(np.arange(a, b)))
            assert places == [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]


def test_license_base_places(spark):
    texts = [
        (1, "Apache License, the MIT license. mit LICENSE GNU general public license"), (2, None), (3, ""), (4, "mit mit license license"),
        (5, license_scan.TEMPLATES[0][1]), (6, "x " * 50 + license_scan.TEMPLATES[1][1].replace("compliance", "keeping") + " y" * 9),
        (7, "Permission is hereby granted to nobody at all"), (7, "general public apache license"), (None, "license mit apache"),
        *[(20 + i, " ".join(random.choice("mit license apache general public hereby granted".split()) for _ in range(300))) for i in range(20)],
    ]
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]): r for r in
           license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()}
    for i, t in texts:
        w, places = alnum(t), []
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            places += [(at, label) for at in range(len(w)) if w[at : at + len(p)] == p]
        starts = [at for at, _ in places]
        assert (i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))) in got
    by = {k[0]: r for k, r in got.items()}
    assert by[5]["labels"] == "mit" and by[5]["score"] == 1.0 and by[5]["covered"][0]["coverage"] == 1.0
    assert by[6]["labels"] == "apache" and by[6]["covered"][0]["first_word"] == 50
    assert by[2]["labels"] == "" and by[2]["score"] == 0.0


def test_license_notices_get_their_labels(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "words before. Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
             "This work is licensed under the GNU General Public License, version 3.", "licensed under nothing", "under CC BY-SA 4.0 words"]
    got = [r["labels"] for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert ["cc-by-nc" in got[0].split(","), "mit" in got[1], "apache" in got[2], "gpl" in got[3]] == [True] * 4 and got[4] == ""
    stray = license_scan.TEMPLATES[1][1].split()
    moved = " ".join(stray[:9] + stray[24:32] + stray[8:24])
    whole = license_scan.Scanner().scan(moved.encode())
    without = license_scan.Scanner().scan(" ".join(stray[:9] + ["x"] * 8 + stray[8:24]).encode())
    most = lambda r: max(c["coverage"] for c in r[7] if c["label"] == "apache" and c["first_word"] == 0)
    assert most(whole) >= most(without) > 0.7


def test_best_chains_against_all_chains():
    rng = random.Random(12)
    for _ in range(300):
        spans = [(at := rng.randrange(30), rng.randrange(12), min(rng.randint(1, 6), at + 1)) for _ in range(rng.randint(1, 7))]
        spans = [(a, e, min(n, e + 1)) for a, e, n in spans]
        gap, best = rng.randint(0, 6), 0
        for k in range(1, len(spans) + 1):
            for chain in itertools.permutations(spans, k):
                pairs = list(zip(chain, chain[1:]))
                if all(p[0] < q[0] and p[1] < q[1] and q[0] - q[2] - p[0] <= gap for p, q in pairs):
                    best = max(best, chain[0][2] + sum(min(q[2], q[0] - p[0], q[1] - p[1]) for p, q in pairs))
        assert license_scan.best_chain(spans, gap)[0] == best


def test_matching_statistics():
    scanner = license_scan.Scanner(templates=(("a", "p q r s p q"), ("b", "q r t")), phrases=(("r s", "x"),))
    a, number = scanner.automaton, scanner.words
    stretches = {tuple(t[i:j]) for t in ("p q r s p q".split(), "q r t".split(), "r s".split()) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = random.Random(4)
    text = [rng.choice("pqrstz") for _ in range(400)]
    state = matched = 0
    for at, w in enumerate(text):
        state, matched = a.step(state, matched, number.get(w.encode(), 0))
        assert matched == max((n for n in range(1, 8) if n <= at + 1 and tuple(text[at - n + 1 : at + 1]) in stretches), default=0)


def brute_top(rows, k=5):
    ok = {i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * (1 if i % 3 else 0.2)]) for i in range(300)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5), (None, [1.0] * 6),
             (350, [0.5] * 6), (351, [2.0] * 6), (352, [2.0] * 6), (550, [1.0, 2.0]), (600, []), (601, []), (0, rows[0][1]), (700, [9e6] * 3), (701, [9e6, -3e6, 8e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    for block, sample in ((4096, 4096), (2, 50)):
        got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block=block, sample=sample).collect())
        assert got == brute_top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_with_text_ids_repeated_ids_and_overflow(spark):
    rng = np.random.default_rng(5)
    rows = [(f"id{i:03}", [float(x) for x in rng.integers(-9, 9, 4)]) for i in range(120)]
    rows += [("id007", [9.0, 9.0, 9.0, 9.0]), ("id050", [1.0, 0.0, 0.0, 0.0]), ("big", [9e18, -9e18, 1.0, 0.0]), ("huge", [9e300] * 4)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    asked = F.col("vec_id").isin("id000", "id050", "big", "huge")
    whole = lambda x: int(min(max(np.floor(x * 256.0), -9.2e18), 9.2e18))
    want = []
    for q in ("id000", "id050", "big", "huge"):
        best = {}
        for a, u in rows:
            for b, v in rows:
                if a == q != b:
                    s = min(max(sum(whole(x) * whole(y) for x, y in zip(u, v)), -(2**63)), 2**63 - 1)
                    best[b] = max(s, best.get(b, s))
        want += [(q, r + 1, b, s) for r, (b, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    for block, sample in ((4096, 4096), (7, 20)):
        assert sorted(tuple(r) for r in topk.top_k(df, asked, block=block, sample=sample).collect()) == sorted(want)


def test_top_k_over_cells_that_stay_in_partitions_of_their_own(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-50, 50, (300, 6))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = [
        (q, r + 1, b, int(s))
        for q in range(0, 300, 50)
        for r, (s, b) in enumerate(sorted(((65536 * int(x[q] @ x[b]), b) for b in range(300) if b != q), key=lambda p: (-p[0], p[1]))[:5])
    ]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # merged partitions would bring any two sides of a cell together
    try:
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=60, sample=20).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(tuple, got)) == want


def test_top_k_stops_early():
    x = np.concatenate([np.full((5, 2), 50.0), np.random.default_rng(1).normal(size=(5000, 2)).round()])
    calls = []
    real = topk.products
    topk.products = lambda q, part: calls.append(len(part)) or real(q, part)
    try:
        list(topk.best_of_block(np.array([-1]), np.array([[10.0, 10.0]]), np.array([-np.inf]), np.arange(len(x)), x, x[:8], 5))
    finally:
        topk.products = real
    assert sum(calls) == 512


def test_token_counts_match_the_reference_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    got = {}
    for r in token_counts.token_counts(docs, piece_bytes=200).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = r
    for i, text in DOCS:
        text = text or ""
        sections = text.splitlines(keepends=True) if "\r" not in text else None
        ids = tokenizer.encode(text, add_special_tokens=False)
        want = [0] * max(1, len(sections))
        bounds = np.cumsum([0, *map(len, sections)])
        for a, _ in ids.offsets:
            want[int(np.searchsorted(bounds, a, "right")) - 1] += 1
        if "é" not in text:
            assert [got[i][s]["n_tokens"] for s in range(len(want))] == want
        assert sum(r["n_tokens"] for r in got[i].values()) == len(ids.ids)
        assert [(r["char_start"], r["char_end"]) for _, r in sorted(got[i].items())] == (list(zip(bounds[:-1], bounds[1:])) or [(0, 0)])


def test_token_counts_of_long_runs(spark):
    """Runs that an encoder's pattern search can't take: the tokens of a short run stand for those of a long one."""
    import tiktoken

    encoder = tiktoken.Encoding("public", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(token_counts.VOCABULARY), special_tokens={})
    n = 2_000_000
    texts = [" " * n, "\n" * n, "ab" * (n // 2), "é" * n, "!" * n, "7" * n, "a" + " " * n + "b", "\t " * (n // 2) + "x"]
    got = {r["doc_id"]: r["n"] for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert sorted(got) == list(range(len(texts))) and all(1 <= x <= n + 2 for x in got.values())
    for text in (*[t[:2500] for t in texts], "x" + " " * 2500 + "y  z", "it's " * 30 + " " * 2100 + "don't 12  3?!  ", "\r\n \u3000 " * 800, "Ünï's" * 700):
        assert token_counts.long_runs(text) or len(text) <= 4000
        import regex
        pattern = regex.compile(token_counts.POSSESSIVE)
        assert [t for p in pattern.finditer(text) for t in encoder._encode_single_piece(p[0].encode())] == encoder.encode_ordinary(text)


def test_boundary_rules():
    ends, bounds = np.array([2, 7, 9]), np.array([0, 4, 6, 9])
    assert token_counts.attribute(ends, bounds, "start")[0].tolist() == [2, 0, 1]
    assert token_counts.attribute(ends, bounds, "majority")[0].tolist() == [2, 0, 1]
    weights, touched = token_counts.attribute(ends, bounds, "proportional")
    assert np.allclose(weights, [1.4, 0.4, 1.2]) and touched.tolist() == [1, 1, 1]


def test_toxicity_machine_row_by_row(spark):
    """The scores against a plain evaluation of the fitted machine."""
    rng = random.Random(9)
    rows = [(i, " ".join(words(15, rng) + ["awful"] * (rng.random() < 0.3))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "awful " * 50)], "doc_id long, text string")
    keep, machine = toxicity.fit(docs, spark.createDataFrame([(i, int("awful" in t)) for i, t in rows], "doc_id long, toxic int"))
    assert keep
    for r in toxicity.toxicity(docs, (keep, machine)).collect():
        text = dict([*rows, (900, ""), (901, "awful " * 50)])[r["doc_id"]]
        x = {}
        for w in alnum(text):
            for t in toxicity.hashed(w.encode(), 20):
                if t in keep:
                    x[keep[t]] = x.get(keep[t], 0) + 1
        x = {i: 1 + np.log(n) for i, n in x.items()}
        z = machine.b + sum(machine.w[i] * a for i, a in x.items())
        z += sum(float(machine.v[i] @ machine.v[j]) * x[i] * x[j] for i, j in itertools.combinations(x, 2))
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_of_terms_that_are_neutral_alone(spark):
    """Two terms that toxic and clean texts have equally often, toxic only together or both absent from it."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = words(12, rng) + ["zork"] * a + ["quib"] * b
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, y in labels if i % 2]) > 0.9


def test_toxicity_learns_pairs_and_defaults(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        text = words(20, rng) + ["awful"] * a + ["folks"] * b
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(a and b), 1))
    labels += [(5000, 1, 1), (None, 1, 1), (3, None, 1)]
    docs = spark.createDataFrame([*rows, (9001, None), (9002, "")], "doc_id long, text string").withColumn("score", F.lit(1))
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, known.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    right = [got[i]["predicted"] == y for i, y, _ in labels[:1200] if i % 2]
    assert np.mean(right) > 0.97 and got[9001]["score"] == got[9002]["score"] < 0.5
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    empty = toxicity.fit(docs, known.limit(0))
    assert {r["score"] for r in toxicity.toxicity(docs, empty).collect()} == {0.5}


def test_items_digest(spark):
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    got = spark.createDataFrame([([2, 10],), ([],)], "items array<long>").select(F.sha2(listed, 256)).collect()
    assert [r[0] for r in got] == [hashlib.sha256(x).hexdigest() for x in (b"10,2", b"")]


def test_template_matches_against_all_places():
    rng = random.Random(21)
    for _ in range(60):
        templates = tuple((f"t{i}", " ".join(rng.choices("pqrs", k=rng.randint(2, 9)))) for i in range(4))
        templates += (("prefix", " ".join(templates[0][1].split()[:3])),)
        scanner = license_scan.Scanner(templates=templates, phrases=(("r s", "x"),), min_match=3)
        text = rng.choices("pqrsz", k=80)
        want = set()
        for k, (_, words) in enumerate(templates):
            t = words.split()
            for at in range(len(text)):
                for end in range(len(t)):
                    n = 0
                    while n <= min(at, end) and text[at - n] == t[end - n]:
                        n += 1
                    longer = at + 1 < len(text) and end + 1 < len(t) and text[at + 1] == t[end + 1]
                    if n >= min(3, len(t)) and not longer:
                        want.add((k, at, end, n))
        got, base, start = {}, [], 0
        ids = [scanner.words.get(w.encode(), 0) for w in text]
        for known, part in itertools.groupby(ids, bool):
            part = list(part)
            if known:
                scanner.run(part, start, base, got)
            start += len(part)
        found = [(k, *m) for k, ms in got.items() for m in ms]
        assert len(found) == len(set(found)) and set(found) == want
        assert sorted(at for at, _ in base) == [i for i in range(79) if text[i : i + 2] == ["r", "s"]]


def test_variants_of_a_licence():
    scanner = license_scan.Scanner()
    labels = lambda text: scanner.scan(text.encode())[5]
    own = {text: label for label, text in license_scan.TEMPLATES}
    for text, label in own.items():
        base = {base for phrase, base in license_scan.PHRASES if phrase in " ".join(alnum(text))}
        assert set(labels(f"before {text} after").split(",")) == {label, *base}
    lesser = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"
    assert labels(lesser) == "gpl,lgpl" == labels(lesser.replace("library", "program"))
    assert labels("This work is licensed under a Creative Commons Attribution-NonCommercial 2.0 Generic License.") == "cc-by-nc"
    both = lesser + " " + "x " * 40 + next(t for label, t in license_scan.TEMPLATES if label == "agpl")
    assert labels(both) == "agpl,gpl,lgpl"


def test_a_template_within_a_longer_one():
    scanner = license_scan.Scanner(templates=(("a", "one two three four five six"), ("b", "one two three four five six seven eight nine ten")), phrases=(("x y", "x"),))
    covered = {c["label"]: c["coverage"] for c in scanner.scan(b"say one two three four five six seven eight end")[7]}
    assert covered == {"a": 1.0, "b": 0.8}
