"""Operators on many documents or vectors: near copies, exact copies, mixing, URLs, embeddings, components."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from conftest import AWKWARD
from pyspark.sql import functions as F

from veilspark.llm import components, exact, jaccard, mixture, scratch, urlfilter, vectors


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(500, 560)] + [(900, k) for k in range(700, 899)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots({x for p in links for x in p}, links)
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k not in alone}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Near copies


def near_rows(rows, width, percent):
    """By definition, over all pairs of (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = roots(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return Counter((d, len(sets[i]), least.get(root[i]) if sets[i] else d) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    """Groups of copies with random edits around the threshold, a common passage, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(60))
    passage, rows = [word() for _ in range(30)], []
    while len(rows) < n:
        base = [word() for _ in range(rng.choice([2, 5, 40, 90]))] + (passage if rng.random() < 0.3 else [])
        for _ in range(rng.choice([1, 2, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t).title() if rng.random() < 0.3 else "\t".join(t))
    ids = rng.sample(range(10 * n), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("width", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_near_copies_match_brute_force(spark, width, percent, seed):
    rows = corpus(seed, 250)
    got = Counter(tuple(r) for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect())
    assert got == near_rows(rows, width, percent)


def crowd(seed, n, edits, width=60):
    """One group of near copies that link with some of the others only."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(width)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.choice(edits)):
            t[rng.randrange(width)] = f"x{rng.randrange(400)}"
        rows.append((n - i, " ".join(t)))
    return rows


@pytest.mark.parametrize(("hot", "tile"), [(40, 2048), (12, 16)])
def test_near_copies_of_a_crowd(spark, hot, tile):
    for rows in (crowd(4, 150, [1, 2, 3]), crowd(5, 120, [2, 3, 4, 5], 90)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert Counter(tuple(r) for r in jaccard.near_copies(df, 3, 75, hot=hot, tile=tile).collect()) == near_rows(rows, 3, 75)


def test_bitmaps_bound_overlaps():
    rng = np.random.default_rng(3)
    for a, b in ((5, 9), (90, 100), (700, 1500), (40, 6000)):
        pool = rng.integers(0, 1 << 63, 2 * b, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        x, y = ([np.unique(rng.choice(pool, k, replace=False)) for _ in range(6)] for k in (a, b))
        got = jaccard.bounds([jaccard.bitmap(s) for s in x], [jaccard.bitmap(s) for s in y], np.full(6, a), np.full(6, b))
        want = np.array([[len(np.intersect1d(s, t)) for t in y] for s in x])
        assert (got >= want).all() and (got <= a).all()
        assert (jaccard.bounds([jaccard.bitmap(x[0])], [jaccard.bitmap(x[0])], np.array([a]), np.array([a])) == a).all()


def test_spanning_links_join_what_all_links_join():
    rng = np.random.default_rng(1)
    for _ in range(50):
        comp = rng.integers(0, 12, 15)
        i, j = rng.integers(0, 15, (2, int(rng.integers(0, 30))))
        pick = jaccard.spanning(comp, i, j)
        own = [(int(comp[k]), int(comp[m])) for k, m in zip(i, j, strict=True)]
        assert roots(range(12), own) == roots(range(12), [own[k] for k in pick])
        assert len(set(pick.tolist())) == len(pick) <= 11


def test_one_document_of_each_group_stays(spark):
    near = "a b c d e f g h i j k l m n o p"
    rows = [(1, near, 0), (1, near + " q", 1), (1, near + " q", 2), (1, "other words than these", 3), (None, near, 4), (None, "words alone here", 5), (None, "words alone here", 6), (2, "", 7), (2, None, 8), (3, near, 9)]
    out = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string, near_hash long"), 3, 60)
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert out.columns == ["doc_id", "text", "near_hash"]
    assert [x for x in got if x[1].startswith("a b")] in ([(1, near)], [(1, near + " q")])
    assert sorted(x for x in got if not x[1].startswith("a b")) == [(0, "words alone here"), (1, "other words than these"), (2, ""), (2, "")]


def test_near_copies_awkward(spark, awkward, nothing):
    got = Counter(tuple(r) for r in jaccard.near_copies(awkward).collect())
    assert got == near_rows([r[:2] for r in AWKWARD], 4, 85)
    assert jaccard.near_copies(nothing).count() == 0
    # Document 8 has two rows: one is a near copy of document 1.
    assert sorted(r.doc_id for r in jaccard.representatives(awkward).filter("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 8, 10, 11]
    assert jaccard.representatives(awkward).columns == awkward.columns


# Exact copies


def exact_rows(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    by = defaultdict(list)
    for (d, _), t in zip(rows, norm, strict=True):
        by[t].append(d)
    first = {t: min(ds, key=lambda d: (d is None, d or 0)) for t, ds in by.items()}
    return Counter((d, first[t], len(by[t]), sha256(t.encode()).hexdigest()) for (d, _), t in zip(rows, norm, strict=True))


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("block", [4096, 3])
def test_exact_copies(spark, awkward, monkeypatch, weak, block):
    monkeypatch.setattr(exact, "BLOCK", block)
    # A hash with few values: names must not depend on hashes being unique.
    key = (lambda *c: F.pmod(F.xxhash64(*c), F.lit(5))) if weak else F.xxhash64
    rows = [(r[0], (r[1] or "")[:200] if r[1] is not None else None) for r in AWKWARD] + [(100 + i, "ab" * i) for i in range(12)] + [(200 + i, "ab" * i) for i in range(12)]
    found = exact.groups(spark.createDataFrame(rows, "doc_id long, text string"), key).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == exact_rows(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_awkward(spark, awkward, nothing):
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact.groups(awkward).collect()) == exact_rows([r[:2] for r in AWKWARD])
    assert exact.groups(nothing).count() == 0
    out = exact.deduplicated(awkward)
    assert out.columns == awkward.columns
    want = len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in AWKWARD})
    assert out.count() == want


# Mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    """Water filling by the words of the contract: share, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        t = {s: 2 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if t[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def test_mixture(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 20, 300, 3000]), None if s == 7 else f"s{s}") for i, s in enumerate(rng.choices(range(8), [30, 9, 5, 3, 2, 2, 1, 4], k=900))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixture.mixed(df, shard_rows=50).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        s = rows[r.doc_id][2]
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size and 0 <= r.copies <= 2
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        taken[s] += r.taken
    assert len(got) == len(rows)
    assert max(abs(taken[s] - want[s]) for s in sizes) <= 64  # within a block, in whatever source
    again = mixture.mixed(df.repartition(5), shard_rows=50).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_mixture_of_small_sources(spark):
    rows = [(i, "w " * 500, "big") for i in range(300)] + [(1000 + i, "w " * n, f"tiny{i}") for i, n in enumerate((40, 20, 10, 1, 3))] + [(2000 + i, "w " * 7, "some") for i in range(90)]
    got = mixture.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, want = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        want[r.source] = r.target
    assert all(abs(taken[s] - want[s]) <= 1 for s in want), (taken, want)


def test_repeated_is_what_copies_say(spark):
    rng = random.Random(8)
    rows = [(i if i % 9 else None, f"t{i} " * rng.choice([0, 1, 30, 200]), rng.choice(["a", "b", "b", "b", None]), i) for i in range(700)] + [(5, "again and again", "b", 900), (5, "again and again", "b", 901)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_plan long")
    want = Counter()
    for r in mixture.mixed(df, shard_rows=60).filter("doc_id is not null and doc_id <> 5").collect():
        want[r.doc_id] += r.copies
    out = mixture.repeated(df, shard_rows=60)
    assert out.columns == df.columns
    got = Counter(r.doc_id for r in out.collect())
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if k is not None and k != 5}


def test_mixture_awkward(spark, awkward, nothing):
    rows = mixture.mixed(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r.taken == 0 for r in rows if r.size == 0)
    assert mixture.mixed(nothing).count() == 0
    assert mixture.repeated(awkward).columns == awkward.columns
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixture.mixed(blank).collect()] == [(0.0, 0)] * 2


def test_sainte_lague(spark):
    rng = random.Random(9)
    groups = {g: [rng.choice([0, 1, 3, 50, 1000, 7]) for _ in range(rng.randint(1, 12))] for g in range(25)}
    house = {g: rng.randint(0, 60) for g in groups}
    rows = [(g, i, v, house[g]) for g, vs in groups.items() for i, v in enumerate(vs)]
    got = {(r.g, r.i): r.seats for r in mixture.seats(spark.createDataFrame(rows, "g int, i int, v long, house long"), ["g"], ["i"], "v", "house").collect()}
    for g, vs in groups.items():
        won = [0] * len(vs)
        for _ in range(house[g] if sum(vs) else 0):
            i = max(range(len(vs)), key=lambda i: (vs[i] / (2 * won[i] + 1), -i))
            won[i] += 1
        assert [got[g, i] for i in range(len(vs))] == won, (vs, house[g])


# URLs


def test_urls(spark):
    urls = [
        "http://www.example.com/en/x", "https://EXAMPLE.com/en/?q", "http://m.example.com/en/", "http://example.com/en", "http://foo.net/es/1", "http://net/fr/", "http://xnet/fr/",
        "http://a.example.org/fr/2#t", "no scheme", None, "", "x://", "ftp://h?x=/en/", "http://casino.example.org/play/slots",
    ]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.judged(df).collect()}
    rule = {0: "www.example.com/en/", 1: "example.com/en/", 2: "example.com/en/", 3: "com/", 4: "net/es/", 5: "net/fr/"}
    assert {i: r.rule for i, r in got.items() if r.rule} == rule
    assert [got[i].verdict for i in range(6)] == ["allow", "block", "block", "allow", "block", "block"]
    assert (got[1].host, got[1].path) == ("example.com", "/en/") and (got[12].host, got[12].path) == ("h", "")
    assert all((got[i].host, got[i].path) == ("", "") for i in (8, 9, 10, 11))
    assert got[13].verdict == "block" and got[7].verdict == "allow"
    assert urlfilter.judged(df.limit(0)).count() == 0


def test_url_model_matches_plain_gradient_steps(spark):
    rows = sorted((r.o, r.label, sorted(r.x)) for r in urlfilter.labelled(spark).limit(12).unionByName(spark.createDataFrame([(None, 1), ("no scheme", 0)], "url string, label int")).filter("url is not null").select(
        F.xxhash64("url").alias("o"), "label", urlfilter.buckets(urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url")), 64).alias("x")
    ).collect())
    examples = urlfilter.labelled(spark).limit(12).unionByName(spark.createDataFrame([(None, 1), ("no scheme", 0)], "url string, label int"))
    got = urlfilter.train(examples, 64, 3)
    w = [0.0] * 65
    for _ in range(3):
        for _, y, x in rows:
            g = (y - 1 / (1 + np.exp(-(w[64] + sum(w[b] for b in x))))) * 0.15
            w = [v * (1 - 0.15e-3) + (g if i in x or i == 64 else 0) for i, v in enumerate(w)]
    assert np.allclose(got, w)
    z = spark.range(1).select(urlfilter.probability(F.lit("casino.example.org"), F.lit("/play"), got).alias("p"), urlfilter.buckets(F.lit("casino.example.org"), F.lit("/play"), 64).alias("x")).first()
    assert np.isclose(z.p, 1 / (1 + np.exp(-(w[64] + sum(w[b] for b in z.x)))))


def test_url_model_on_other_urls(spark):
    blocked = ["http://online-casino.example.org/bonus", "https://pills-shop.example.net/cheap/order", "http://crack-download.example.org/keygen"]
    allowed = ["http://books.example.org/en/history", "https://city-museum.example.net/exhibits", "http://news.example.org/de/post/7"]
    df = spark.createDataFrame(list(enumerate(blocked + allowed)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judged(df, rules=()).collect()}
    assert [got[i] for i in range(6)] == ["block"] * 3 + ["allow"] * 3


def test_of_equal_rules_the_first_wins(spark):
    rule = urlfilter.rule_of(F.lit("a.example.org"), F.lit("/x"), (("block", "example.org", "/"), ("allow", "example.org", "/"), ("allow", "org", "/")))
    assert spark.range(1).select(rule.alias("r")).first().r.verdict == "block"


# Embeddings


def near_vectors(rows, threshold=0.95):
    unit = []
    for _, v in rows:
        ok = v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    n = Counter(x for p in links for x in p)
    root = roots(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], d), d)
    return Counter((d, n[i], least[root[i]], d == least[root[i]]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("tile", [2048, 16])
def test_vectors(spark, tile):
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for _ in range(60):
        base = rng.normal(size=32)
        for _ in range(int(rng.choice([1, 2, 30], p=[0.6, 0.3, 0.1]))):
            v = base + rng.normal(size=32) * rng.choice([0.0, 0.05, 0.2, 0.4])
            rows.append((1000 - i, [float(np.float32(x)) for x in v]))
            i += 1
    rows += [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [1.0, None]), (2004, []), (2005, [3.0, 4.0]), (2006, [6.0, 8.0]), (2007, [float("inf")] * 32)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (8, [2 * x for x in rows[3][1]])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, component_id string")
    got = Counter(tuple(r) for r in vectors.near_duplicates(df, recall=0.9999, tile=tile).collect())
    assert got == near_vectors([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b]) for a, b in rows])
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(8)
    rows = []
    for dim in [*range(1, 81), 200]:
        for _ in range(40 if dim == 200 else 1):
            base = rng.normal(size=dim)
            rows += [(len(rows) + k, [float(x) for x in base + k * 1e-3 * rng.normal(size=dim)]) for k in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = Counter(tuple(r) for r in vectors.near_duplicates(df, recall=0.9999).collect())
    assert got == near_vectors(rows)


def test_vector_recall(spark):
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(500, 48)), rng.integers(1, 14, 500), axis=0)
    x += rng.normal(size=x.shape) * rng.choice([0.05, 0.2, 0.3], size=(len(x), 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = df.toPandas().sort_values("vec_id")
    x = np.stack(rows["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(x[i : i + 1000] @ x.T >= 0.95).sum(1) - 1 for i in range(0, len(x), 1000)])
    got = vectors.near_duplicates(df).toPandas().sort_values("vec_id")["n_links"].to_numpy()
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum()


def test_scratch(spark):
    df = scratch.kept(spark.range(3), "x")
    assert df.count() == 3 and df._veilspark_path.startswith(scratch.folder(spark))
    scratch.dropped(df)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(df._veilspark_path).count()
