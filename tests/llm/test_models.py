"""Neighbours, packing, leakage and subjects."""

import random
import re
from collections import Counter

import numpy as np

from marisma.llm import leakage, neighbours, packing, subjects


# ---------------------------------------------------------------- neighbours


def true_pairs(ids, vectors, k):
    m = np.array(vectors, dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return out


def test_recall_with_many_lists_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "MAX_BROADCAST_CLASSES", 1)
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(60, 32))
    vectors = [(centers[i % 60] + 0.3 * rng.normal(size=32)).astype(np.float32) for i in range(900)]
    vectors += [vectors[0]] * 300 + [vectors[1]] * 3
    ids = list(range(10, 10 + len(vectors)))
    data = [(i, v.tolist(), "x") for i, v in zip(ids, vectors)]
    bad = [(1, None, "x"), (2, [1.0] * 31, "x"), (3, [float("nan")] * 32, "x"), (4, [0.0] * 32, "x"), (10, vectors[0].tolist(), "x")]
    df = spark.createDataFrame(data + bad, "id long, embedding array<float>, h string")
    near = neighbours.nearest(df, "id", "embedding", 5, 32, list_size=40)
    got = {(min(r.id, r.vizinho), max(r.id, r.vizinho)) for r in near.collect()}
    want = true_pairs(ids, vectors, 5)
    assert len(got & want) / len(want) >= 0.98 and len(got & want) / len(got) >= 0.98
    copies = [i for i, v in zip(ids, vectors) if v is vectors[0]]
    assert {(a, b) for a, b in got if a in copies and b in copies} == {(min(a, b), max(a, b)) for a in copies for b in sorted(set(copies[:6]) - {a})[:5]}
    assert all(min(p) >= 10 for p in got)


def test_small_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [-1.0, 0.0])], "id long, embedding array<float>")
    assert {(r.id_a, r.id_b) for r in neighbours.neighbour_pairs(df, "id", "embedding", 1, 2).collect()} == {(1, 2), (2, 3)}
    assert neighbours.neighbour_pairs(df.limit(0), "id", "embedding", 1, 2).count() == 0
    assert neighbours.neighbour_pairs(df.limit(1), "id", "embedding", 1, 2).count() == 0


def test_graph_finds_the_nearest_centroid():
    rng = np.random.default_rng(1)
    centroids = neighbours._unit(rng.normal(size=(500, 16)))
    graph = neighbours.CentroidGraph(centroids)
    queries = neighbours._unit(rng.normal(size=(200, 16)))
    near, _ = graph.search(queries, 4)
    assert (near[:, 0] == (queries @ centroids.T).argmax(1)).mean() > 0.95


# ---------------------------------------------------------------- packing


def best_fit(counts, cap):
    """Best-fit decreasing, item by item: the space left in each container."""
    left = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [i for i, x in enumerate(left) if x >= size]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= size
            else:
                left.append(cap - size)
    return left


def test_plan_fills_every_item_once():
    random.seed(1)
    for _ in range(100):
        cap = random.choice([10, 20, 50])
        counts = {s: random.randint(1, 30) for s in random.sample(range(1, cap + 1), random.randint(1, cap // 2))}
        used, ranges = packing.fill_plan(counts, cap)
        load = Counter()
        for size, n in counts.items():
            own = sorted(ranges[size])
            for i in range(n):
                start, first = max(r for r in own if r[0] <= i)
                load[first + i - start] += size
        assert max(load.values()) <= cap and set(load) == set(range(used))
        assert used == len(best_fit(counts, cap))


def test_buckets_are_optimal():
    from itertools import combinations

    counts = {1: 9, 2: 4, 3: 7, 5: 2, 8: 3}
    cost = lambda bounds: sum(r[3] for r in packing.bucket_report(counts, list(bounds), 10))
    best = min(cost([*c, 8]) for k in range(3) for c in combinations([1, 2, 3, 5], k))
    assert cost(packing.length_buckets(counts, 3, 10)) == best


def test_containers(spark):
    data = [(i, n, 0) for i, n in enumerate([5, 5, 7, 3, 10, 25, 0, 5, 5])]
    sizes = spark.createDataFrame(data, "id long, tokens int, recipiente int").select("id", "tokens")
    items = packing.pieces(sizes, 10)
    out = packing.containers(items, 10).collect()
    load = Counter()
    for r in out:
        load[r.recipiente] += r.tokens
    assert max(load.values()) <= 10 and sum(load.values()) == sum(n for _, n, _ in data)
    whole = Counter(r.id for r in out)
    assert whole[5] == 3 and all(n == 1 for i, n in whole.items() if i != 5) and 6 not in whole
    assert packing.containers(items.limit(0), 10).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "uma frase curta"), (1, "uma frase curta"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.id, r.tokens > 0) for r in packing.token_counts(df, "doc_id", "text").collect()} == {(1, True), (3, False)}


# ---------------------------------------------------------------- leakage


def plain(text):
    import unicodedata

    text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text)


def test_leaks_against_brute_force(spark, rows):
    random.seed(6)
    vocabulary = [f"pal{i}ç" for i in range(80)]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.choice([5, 20, 40])))) for i in range(12)] + [(100, None), (101, "")]
    docs = []
    for d in range(60):
        words = [random.choice(vocabulary) for _ in range(50)]
        if d % 2:
            own = random.choice(items[:12])[1].split()
            n = random.choice([8, 14, 15, 18])
            at = random.randint(0, max(0, len(own) - n))
            words[20:20] = [w.upper() for w in own[at : at + n]]
        docs.append((d, random.choice([" ", " - ", "\n"]).join(words), 0))
    docs += [(500, None, 0), (501, "", 0), (502, "x " * 40_000 + items[1][1], 0), docs[1]]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id long").select("doc_id", "text")
    want = set()
    for d, t, _ in docs:
        have = plain(t or "")
        grams = {tuple(have[i : i + 15]) for i in range(len(have) - 14)}
        want |= {(i, d) for i, s in items for w in [plain(s or "")] if any(tuple(w[j : j + 15]) in grams for j in range(len(w) - 14))}
    assert set(rows(leakage.leaked(df, spark.createDataFrame(items, "item_id long, texto string")))) == want
    assert leakage.leaked(df.limit(0), spark.createDataFrame(items, "item_id long, texto string")).count() == 0


def test_joined_seeds_equal_shipped_ones(spark, monkeypatch):
    random.seed(21)
    vocabulary = [f"p{i}" for i in range(30)]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(25))) for i in range(6)]
    docs = [(d, " ".join([*random.choices(vocabulary, k=20), *items[d % 6][1].split()[3:20], *random.choices(vocabulary, k=9)])) for d in range(30)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, texto string")
    shipped = {tuple(r) for r in leakage.leaks(a, b).collect()}
    monkeypatch.setattr(leakage, "MAX_BROADCAST_SEEDS", 1)
    monkeypatch.setattr(leakage, "MAX_BROADCAST_DOCUMENTS", 1)
    assert shipped == {tuple(r) for r in leakage.leaks(a, b).collect()} and len(shipped) >= 30


def edited(words, share, vocabulary):
    """A copy in which a share of the words is replaced, dropped or preceded by another word."""
    out = []
    for w in words:
        kind = random.choice("rdi") if random.random() < share else ""
        out += {"r": [random.choice(vocabulary)], "d": [], "i": [random.choice(vocabulary), w]}.get(kind, [w])
    return out


def test_recall_of_edited_copies(spark):
    random.seed(16)
    vocabulary = [f"pal{i}" for i in range(400)]
    text = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [text(60) for _ in range(40)]
    docs, want = [], set()
    for d in range(400):
        words = text(120)
        if d % 2:
            words[50:50] = edited(items[d % 40], 0.15, vocabulary)
            want.add((d % 40, d))
        docs.append((d, " ".join(words)))
    found = leakage.edited_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, texto string"))
    got = {(r.item_id, r.doc_id) for r in found.collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.95 * len(got)
    assert any(r.corrida < leakage.RUN for r in found.collect())


def test_alignment():
    assert leakage.smith_waterman(np.array([1, 2, 3, 4]), np.array([9, 1, 2, 4, 9])) == 5
    assert leakage.longest_run(np.array([1, 2, 3, 4]), np.array([9, 2, 3, 7, 4])) == 2


# ---------------------------------------------------------------- subjects


def test_held_out_accuracy(spark):
    random.seed(8)
    words = {a: [f"{a}{chr(97 + i)}x" for i in range(12)] for a in ("cardio", "neuro", "sport")}
    sentence = lambda a: f"O texto compara {random.choice(words[a])} com {random.choice(words[a])} e conclui que {random.choice(words[a])} merece cautela."
    docs, labels = [], []
    for i in range(300):
        own = random.sample(list(words), random.choice([1, 1, 2]))
        docs.append((i, "\n".join(" ".join(sentence(a) for _ in range(3)) for a in own), "x"))
        labels += [(i, a) for a in own]
    df = spark.createDataFrame(docs + [(900, None, "x"), (901, "", "x"), docs[0]], "doc_id long, text string, area string")
    areas = spark.createDataFrame([(a, a) for a in words], "area string, descricao string")
    sample = spark.createDataFrame([x for x in labels if x[0] < 200] + [(77777, "cardio"), (1, "desconhecida")], "doc_id long, area string")
    found = [(r.doc_id, r.area) for r in subjects.subjects(df.drop("area"), sample, areas).collect()]
    assert len(found) == len(set(found))
    got, want = {x for x in found if x[0] >= 200}, {x for x in labels if x[0] >= 200}
    assert 2 * len(got & want) / (len(got) + len(want)) > 0.95
    assert {a for a, in ((r.area,) for r in subjects.composition(subjects.subjects(df.drop("area"), sample, areas)).collect())} == set(words)
    assert subjects.subjects(df.drop("area"), sample.limit(0), areas).count() == 0
