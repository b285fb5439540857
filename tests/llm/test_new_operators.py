"""Spelling variants, decontamination and hard negatives against brute force, and their defined results for odd input."""

import hashlib
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from watchfold.llm import decontaminate, langid, minhash, mining, packing, queries, variants
from watchfold.llm.components import components

DOCS = "doc_id long, text string, row string, words int, term int, doc long"
SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 30_000


def documents(spark, rows):
    """(doc_id, text) and columns that clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS).repartition(3)


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, LONG), (None, "null id here"), (5, "a\n\nb\n"), (6, " \t\n")]


# Spelling variants


def counted(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            n[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_groups(words, ratio=10):
    """By deleting every code point in turn."""
    near, shorter = defaultdict(set), defaultdict(list)
    for w in words:
        for k in range(len(w)):
            shorter[w[:k] + w[k + 1 :], k].append(w)
    for (rest, _), own in shorter.items():
        for a in own:
            near[a].update(b for b in own if b != a)
            if rest in words and rest != a:
                near[a].add(rest)
                near[rest].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return out


def grouped(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def vocabulary(seed, size=700):
    """Words of few letters, many with a common beginning or end, and copies with an error, of any script."""
    rng = np.random.default_rng(seed)
    out = set()
    while len(out) < size:
        letters = "abé" if rng.random() < 0.9 else "abcdefxyzéß漢"
        w = "".join(rng.choice(list(letters), int(rng.integers(7, 10))))
        w = ("aaaaaa" + w)[:12] if rng.random() < 0.3 else (w + "bbbbbb")[-12:] if rng.random() < 0.3 else w
        w = sorted(out)[int(rng.integers(0, len(out)))] if out and rng.random() < 0.6 else w
        for _ in range(int(rng.integers(0, 3))):
            k = int(rng.integers(0, len(w)))
            w = [w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :]][int(rng.integers(0, 3))]
        if len(w) >= 7:
            out.add(w)
    for w in ("q" * 300 + "rst" * 50, "q" * 299 + "rst" * 50, "q" * 300 + "rst" * 49 + "rs", "aaaaaaa", "aaaaaaaa", "aaaaaab"):
        out.add(w)
    return {w: int(n) for w, n in zip(sorted(out), 10 ** rng.uniform(0, 5, len(out)), strict=True)}


@pytest.mark.parametrize("seed, shard_words", [(1, None), (2, 40), (3, 150)])
def test_variants_against_brute_force(spark, seed, shard_words):
    """Shards of 40 words split the groups of common beginnings and ends."""
    words = vocabulary(seed)
    frame = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, best long").repartition(4)
    got = grouped(variants.group_variants(frame, shard_words=shard_words))
    assert got == brute_groups(words)
    assert sum(v[3] for v in got.values()) > len(got) and any(v[1] not in (v[0], w) for w, v in got.items())


def test_intervals_are_extended(monkeypatch):
    """Wide and narrow intervals, and symbols read or tried, give the same pairs."""
    words = sorted(vocabulary(5))
    exact = np.array([len(w) // 2 for w in words])
    expected = variants.Index(words).near(words, exact, False)
    for narrow, read in ((0, 96), (0, 0), (3, 8), (10**6, 96)):
        monkeypatch.setattr(variants, "NARROW", narrow)
        monkeypatch.setattr(variants, "READ", read)
        for a, b in zip(variants.Index(words).near(words, exact, False), expected, strict=True):
            assert a.tolist() == b.tolist()


def test_variants_query_against_brute_force(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    assert grouped(queries.QUERIES["op11_fm_index_variants"](spark, SF)) == brute_groups(counted(zip(table["doc_id"], table["text"], strict=True)))


def test_variants_odd(spark):
    rows = [*ODD, (None, "Wanderer wanderer"), (None, "WANDERER ÀÉcédille"), (7, "Wandeerer wandeerer Ààààààà ààààààà"), (8, "x" * 5000), (9, "x" * 5000 + " " + "x" * 4999), (10, "x" * 4999)]
    expected = brute_groups(counted(rows))
    assert grouped(variants.group_variants(variants.count_words(documents(spark, rows), variants.with_losses))) == expected and len(expected) > 3
    assert variants.group_variants(variants.count_words(documents(spark, []))).count() == 0


# Decontamination


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c <= "Z" else c for c in text or ""))


def brute_report(docs, items, width):
    grams = defaultdict(set)
    for item, text in items:
        w = tokens(text)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            grams[tuple(w[k : k + width])].add(item)
    out = []
    for doc_id, text in docs:
        w, hit, names = tokens(text), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in grams:
                    hit.update(range(k, k + size))
                    names |= {str(x) for x in grams[g] if x is not None}
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed, n=60):
    """Documents of few words, into which passages of items are put, whole, cut or with an error; a third of them are copies."""
    rng = np.random.default_rng(seed)
    known = [*"abcdefgh", "the", "été", "Ünd", "X9", "漢字"]
    text = lambda k: " ".join(rng.choice(known, k))
    items = [(int(k), text(int(rng.integers(0, 16)))) for k in range(12)] + [(3, text(9)), (None, text(8)), (50, None), (51, "rareone " + text(4)), (52, "unseen word")]
    docs = []
    for k in range(n):
        parts = [text(int(rng.integers(0, 40)))]
        for _ in range(int(rng.integers(0, 3))):
            own = (items[int(rng.integers(0, len(items)))][1] or "").split()
            a = int(rng.integers(0, 4))
            own = own[a:] if rng.random() < 0.5 else own
            if own and rng.random() < 0.3:
                own[len(own) // 2] = "zzz"
            parts += [", ".join(own).upper() if rng.random() < 0.3 else "  ".join(own), text(int(rng.integers(0, 9)))]
        docs.append((k, ". ".join(parts)))
    return docs + docs[: n // 3] + ODD, items


@pytest.mark.parametrize("seed, width, lists", [(1, 6, 2), (2, 3, 1), (3, 10, 3)])
def test_report_against_brute_force(spark, seed, width, lists):
    docs, items = corpus(seed)
    benchmark = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, word string")
    got = decontaminate.report(documents(spark, docs), benchmark, width, lists=lists)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_report(docs, items, width)
    assert got.where("contaminated").count() > 10


def test_report_odd(spark):
    benchmark = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert decontaminate.report(documents(spark, []), benchmark).count() == 0
    got = decontaminate.report(documents(spark, ODD), benchmark.limit(0)).collect()
    assert len(got) == len(ODD) and not any(r["contaminated"] for r in got)
    assert sorted(r["n_words"] for r in got) == sorted(len(tokens(t)) for _, t in ODD)


def test_spans_and_proximity(spark):
    docs, items = corpus(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = documents(spark, docs)
    got = Counter(tuple(r) for r in decontaminate.spans(frame, benchmark, 5).collect())
    expected = Counter()
    grams = {(k, g) for k, t in items for w in [tokens(t)] for g in (tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if g}
    for doc_id, text in docs:
        w = tokens(text)
        expected.update((doc_id, None if k is None else str(k), a, len(g)) for k, g in grams for a in range(len(w) - len(g) + 1) if tuple(w[a : a + len(g)]) == g)
    assert got == expected
    numbered = decontaminate.numbered(decontaminate.windows_of(benchmark, "item_id", "text", 5))
    index = decontaminate.build(frame, numbered)
    counts = {r["word"]: r["n"] for r in index.vocabulary.collect()}
    ids = {r["doc"]: r["doc_id"] for r in index.documents.collect()}
    assert Counter(ids.values()) == Counter(d for d, _ in docs)
    got = Counter((ids[r["doc"]], tuple(r["gram"]), r["pos"]) for r in decontaminate.proximities(index, numbered, 7, 3).join(numbered, "window").collect())
    rank = {(r["window"], r["term"]): r["rank"] for r in decontaminate.ordered_terms(index, numbered).orderBy("rank", ascending=False).collect()}
    terms = {r["term"]: r["word"] for r in index.vocabulary.collect()}
    expected = Counter()
    for r in numbered.collect():
        if min(counts[x] for x in r["gram"]) == 0:
            continue
        own = [terms[t] for _, t in sorted((n, t) for (w, t), n in rank.items() if w == r["window"])][:3]
        for doc_id, text in docs:
            w = tokens(text)
            expected.update((doc_id, tuple(r["gram"]), a) for a in range(len(w)) if w[a] == own[0] and all(x in w[max(0, a - 7) : a + 8] for x in own))
    assert got == expected
    index.drop()


def test_the_index_is_removed(spark):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir")
    decontaminate.report(documents(spark, ODD), spark.createDataFrame([(1, "one")], "item_id long, text string"))
    assert not glob.glob(f"{folder.removeprefix('file:')}/**/postings-*", recursive=True)


# Hard negatives


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (33, 64, 70), (65, 129, 257), (200, 37, 90), (64, 64, 64)):
        a, b = rng.integers(-(2**40), 2**40, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
        assert (mining.strassen(a, b) == a @ b).all()


def brute_negatives(rows, divisor, positives=5, negatives=10):
    known = {}
    for k, v, label in rows:
        if k is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            known[k] = min(known.get(k, (label, v)), (label, v))
    whole = {k: (label, [int(np.floor(256 * float(x))) for x in v]) for k, (label, v) in known.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % divisor:
            continue
        s = {k: sum(x * y for x, y in zip(v, w, strict=True)) for k, (_, w) in whole.items() if k != a and len(w) == len(v)}
        order = sorted(s, key=lambda k: (-s[k], k))
        for p in [k for k in order if whole[k][0] == label][:positives]:
            fits = [k for k in order if whole[k][0] != label and 30 * s[p] <= 100 * s[k] <= 90 * s[p]][:negatives]
            out += [(a, p, r + 1, k, s[p], s[k]) for r, k in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [None, 37, 400])
def test_negatives_against_brute_force(spark, shard_rows):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(900, 24)) + rng.normal(size=24)).round(1)
    x[100:140] = x[100]
    rows = [(k, v.tolist(), int(rng.integers(0, 3))) for k, v in enumerate(x)]
    rows += [(None, x[0].tolist(), 1), (1000, x[3].tolist(), None), (1010, None, 1), (1020, [], 1), (1030, [None, *x[3][1:].tolist()], 1), (1040, [np.nan] * 24, 1), (1050, [np.inf] * 24, 1)]
    rows += [(10, x[11].tolist(), 0), (10, x[10].tolist(), 0), (1060, [1.0, 2.0], 1), (1061, [2.0, 2.0], 1), (1062, [1.5, 0.5], 2), (1070, [5.0], 1), (1080, (-x[0]).tolist(), 7), (1081, x[0].tolist(), 7)]
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<double>, label int, dim int, part string").repartition(5)
    got = sorted(tuple(r) for r in mining.mine(frame, 10, shard_rows=shard_rows).collect())
    assert got == brute_negatives(rows, 10) and len(got) > 1000
    assert mining.mine(frame.limit(0), 10).count() == 0


PEAK = """
import resource, sys
import numpy as np
from watchfold.llm import {module} as m
dim = {dim}
n = min(m.SHARD_BYTES // (8 * dim), 1 << 19)
shard, ids = np.random.default_rng(1).integers(-500, 500, (n, dim)), np.arange(n)
rows = max(1, m.TILE_CELLS // n)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for a in range(2):
    asking = shard[a * rows : a * rows + rows]
    {work}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


@pytest.mark.parametrize("dim", [8, 64, 1024])
@pytest.mark.parametrize("module, work", [("topk", "m.tile(asking.astype(float), ids[:rows], shard.astype(float), ids, 10)"), ("mining", "s = m.strassen(asking, shard.T); m.best(s, s > 0, 10)")])
def test_memory_of_full_shards(module, work, dim):
    """Of a tile, beside its shard of 32 MB."""
    done = subprocess.run([sys.executable, "-c", PEAK.format(module=module, work=work, dim=dim)], capture_output=True, text=True, check=True, cwd=queries.__file__.rsplit("/watchfold", 1)[0])
    assert float(done.stdout) < 250


def test_memory_of_python_workers(spark):
    """Language identification, sets and packing get few texts at once, and language identification scores few bytes at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    sizes = lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches)
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('some words of text ', id) AS text", "'en' AS lang", "'a' AS source").coalesce(1)
    for work in (langid.identify, minhash.near_duplicates, packing.pack):
        spark.conf.unset(name)
        assert work(docs).count() >= 2000
        assert max(r["n"] for r in docs.mapInPandas(sizes, "n long").collect()) <= 512
    model = langid.Model(["a", "b", "c", "d"], pd.DataFrame({"lang": ["a"], "ord": [0], "key": [97], "n": [1]}))
    tracemalloc.start()
    model.lengths([b"some text " * 400_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


# Components


@pytest.mark.parametrize("kind", ["none", "pairs", "chain", "random"])
def test_components_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    links = {"none": [], "pairs": [(2, 1), (1, 2), (5, 5), (7, 9)], "chain": [(k, k + 1) for k in rng.permutation(300).tolist()], "random": rng.integers(0, 400, (230, 2)).tolist()}[kind]
    least = {x: x for a, b in links for x in (a, b) if a != b}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    out = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, out.collect())) == sorted(least.items())


def test_rounds_of_components(spark):
    """Stars around the least nodes are seen as such without a round; with links between them they take two rounds."""
    context, counted = spark.sparkContext, []
    stars = [(1000 * (k % 7), 1000 * (k % 7) + k) for k in range(7, 700)]
    for name, links in (("stars", stars), ("tied", [*stars, (3010, 5012), (2009, 4011)])):
        df = spark.createDataFrame(links, "a long, b long")
        context.setJobGroup(f"components-{name}", name)
        out = components(df)
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"components-{name}")]
        counted.append(len({s for j in jobs for s in j.stageIds if (i := tracker.getStageInfo(s)) and i.numCompletedTasks}))
        context.setLocalProperty("spark.jobGroup.id", None)
        assert out.where("component % 1000 = 0").count() == out.count()
    assert counted[0] <= 6 and counted[1] <= 30
