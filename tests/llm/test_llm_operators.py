"""The operators against brute force, and their defined results for odd input."""

import itertools
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from watchfold.llm import ann, langid, linededup, minhash, mixing, packing, pii, quotes, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 30_000


def documents(spark, rows):
    """(doc_id, text[, source[, lang]]) and columns that clash with the operators' own."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), "x", 1) for r in rows]
    return spark.createDataFrame(full, f"{DOCS}, row string, size int").repartition(3)


ODD = [(1, None, None), (2, "", "a"), (3, "one", "b"), (3, "one", "b"), (4, LONG, "a"), (None, "null id here", None), (5, "a\n\nb\n", "c"), (6, " \t\n", "c")]
EMPTY: list = []


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Mixing


def brute_targets(sizes):
    """By bisection for the level at which capped shares use up the total."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, low, high = sum(sizes.values()), 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * weight[s]) for s in sizes) < total else (low, mid)
    return {s: min(3 * sizes[s], high * weight[s]) for s in sizes}


def test_mix_targets_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 60))), [None, "b", "é", "zz", "a"][int(rng.integers(0, 5)) if k % 3 else 1]) for k in range(900)]
    out = mixing.mix_report(documents(spark, rows)).toPandas()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    targets, source = brute_targets(sizes), {k: s for k, _, s in rows}
    taken = defaultdict(int)
    for r in out.itertuples():
        assert r.size == len(words(rows[r.doc_id][1])) and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(targets[source[r.doc_id]], rel=1e-6)
        assert r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(0.05 * targets[s], 60)
    again = mixing.mix_report(documents(spark, rows)).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, out.values.tolist()))


def test_mix_odd(spark):
    docs = documents(spark, ODD)
    out = mixing.mix_report(docs).toPandas()
    assert len(out) == len(ODD) and (out.taken <= 3 * out["size"]).all()
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == out.copies.sum()
    assert mixing.mix_documents(documents(spark, EMPTY)).count() == 0


# Top-k and neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string").repartition(3)


def cloud(n, dim, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_topk_exact(spark):
    x = cloud(1500, 16)
    x[40:60] = x[40]
    rows = [(k, v.tolist(), 1, "s") for k, v in enumerate(x)]
    rows += [(5000, None, 1, "s"), (5100, [1.0] * 15 + [None], 1, "s"), (5200, [math.nan] * 16, 1, "s"), (5300, [math.inf] * 16, 1, "s"), (5400, [], 1, "s"), (0, x[0].tolist(), 2, "t")]
    out = topk.search(vectors(spark, rows), 100, k=10, shard_rows=60).toPandas()
    whole = np.floor(1024 * x.astype(float)).astype(np.int64)
    assert set(out.query_id) == set(range(0, 1500, 100))
    for q, own in out.groupby("query_id"):
        s = whole @ whole[q]
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-s[i], i))[:10]
        own = own.sort_values("rank")
        assert own.vec_id.tolist() == order and own.score.tolist() == [s[i] for i in order] and own["rank"].tolist() == list(range(1, 11))


def test_topk_few_and_wide(spark):
    rows = [(0, [1.0, 2.0], 1, ""), (1, [0.5, -1.0], 1, ""), (2, [3.0, 3.0, 3.0], 1, ""), (3, [1e9, 1e9], 1, "")]
    out = topk.search(vectors(spark, rows), 100).toPandas()
    assert out.vec_id.tolist() == [3, 1] and out.score.tolist() == [1024 * 1024_000_000_000 * 3, 512 * 1024 - 1024 * 2048]
    assert topk.search(vectors(spark, EMPTY), 100).count() == 0


def test_forest_recall_and_scores(spark):
    x = cloud(3000, 24)
    x[100:160] = x[100]
    rows = [(k, v.tolist(), 1, "s") for k, v in enumerate(x)] + [(9000, [0.0] * 24, 1, "s"), (9020, None, 1, "s"), (9040, [1.0] * 5, 1, "s"), (9060, [math.nan] * 24, 1, "s")]
    out = ann.search(vectors(spark, rows), 20, k=20, subtree_rows=300).toPandas()
    y, hits, all_ = x.astype(float), 0, 0
    assert set(out.query_id) == set(range(0, 3000, 20))
    for q, own in out.groupby("query_id"):
        s = y @ y[q]
        own = own.sort_values("rank")
        assert len(own) == 20 and q not in set(own.vec_id)
        np.testing.assert_allclose(own.score, s[own.vec_id], rtol=1e-12)
        assert sorted(zip(-own.score, own.vec_id)) == list(zip(-own.score, own.vec_id))
        best = sorted((i for i in range(3000) if i != q), key=lambda i: (-s[i], i))[:20]
        hits, all_ = hits + len(set(best) & set(own.vec_id)), all_ + 20
    assert hits / all_ >= 0.9
    own = out[out.query_id == 100].sort_values("rank")
    assert own.vec_id.tolist() == list(range(101, 121))


def test_forest_of_clustered_vectors_scores_few(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(100, 24)), 60, axis=0) + rng.normal(size=(6000, 24)) * 0.25
    rows = [(k, v.tolist(), 1, "s") for k, v in enumerate(x)]
    entries = spark.createDataFrame([(v.tolist(), [k]) for k, v in enumerate(x)], "vec array<double>, ids array<long>")
    forest = ann.Forest(x, ann.TREES, 7, float(np.linalg.norm(x, axis=1).max()))
    asked = vectors(spark, rows).select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).where("vec_id % 20 = 0")
    budget = ann.budget_for(forest, entries, asked, 300, 20, ann.TARGET, ann.PROBES)
    filed = forest.leaves(x)
    sizes = np.bincount(filed.ravel(), minlength=forest.trees << forest.depth)
    assert np.mean([sizes[v].sum() for v in forest.visits(x[::20], budget)]) < 6000 / 3
    out = ann.search(vectors(spark, rows), 20).toPandas()
    best = np.argsort(-(x[::20] @ x.T), axis=1, kind="stable")
    hits = sum(len(set(own.vec_id) & set([i for i in best[q // 20] if i != q][:20])) for q, own in out.groupby("query_id"))
    assert hits >= 0.9 * 20 * 300


def test_forest_ties_and_dimensions(spark):
    """60 permutations of one vector tie with the query; vectors of another dimension are searched by themselves."""
    base = np.zeros(64)
    base[:3] = [1.0, 0.5, 0.25]
    rows = [(0, np.ones(64).tolist(), 1, "s")] + [(k, np.roll(base, k).tolist(), 1, "s") for k in range(1, 61)]
    rows += [(100 + k, [1.0 + k, 2.0], 1, "t") for k in range(62)]
    out = ann.search(vectors(spark, rows), 20).toPandas()
    own = out[out.query_id == 0].sort_values("rank")
    assert own.vec_id.tolist() == list(range(1, 21)) and set(own.score) == {1.75}
    assert out[out.query_id == 100].sort_values("rank").vec_id.tolist() == list(range(161, 141, -1))
    entries = ann.Entries(np.tile(base, (90, 1)) + np.arange(90)[:, None] * 0.0, [np.array([k]) for k in range(90)][::-1])
    assert entries.best(np.array([7]), np.ones((1, 64)), 5).vec_id.tolist() == [0, 1, 2, 3, 4]


def test_forest_odd(spark):
    rows = [(0, [1.0, 0.0], 1, ""), (1, [0.5, 0.5], 1, ""), (2, [0.5, 0.5], 1, ""), (2, [0.5, 0.5], 1, ""), (None, [9.0, 9.0], 1, ""), (3, [], 1, "")]
    assert ann.search(vectors(spark, rows), 20).orderBy("rank").toPandas().vec_id.tolist() == [1, 2]
    assert ann.search(vectors(spark, EMPTY), 20).count() == 0


# Urls


PAGES = [
    ("http://a.net/es/x", "net/es/", "block"), ("http://NET/es/x", "net/es/", "block"), ("http://xnet/es/", None, "allow"), ("https://www.example.com/en/1", "www.example.com/en/", "allow"),
    ("https://m.example.com/en/", "example.com/en/", "block"), ("https://m.example.com/english", "com/", "allow"), ("https://m.example.com", None, "allow"), ("no scheme", None, "allow"), (None, None, "allow"),
    ("http://h.org/ads/1", None, "block"), ("http://h.org/a?utm_source=feed", None, "block"), ("http://ads.h.org/about/", None, "allow"), ("http://h.org:80/?://net/fr/", None, "allow"), ("x://y.net/fr/?a#b", "net/fr/", "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, (u, _, _) in enumerate(PAGES)], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in urls.filter_urls(pages).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    for k, (url, rule, verdict) in enumerate(PAGES):
        assert (out[k]["rule"], out[k]["verdict"]) == (rule, verdict), url
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups() if url and "://" in url else ("", "")
        assert (out[k]["host"], out[k]["path"]) == (host.lower(), path)
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_urls_without_a_scheme(spark):
    """Host and path are empty, so that no site rule fits; patterns see the whole url."""
    rows = [(1, "foo/ads/bar"), (2, "example.com/en/x"), (3, None), (4, ""), (5, "www.example.com/x.exe")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    assert got == {1: ("", "", None, "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "block")}
    rules = [urls.site_rule(*x) for x in urls.SITES] + [urls.pattern_rule(*x) for x in urls.PATTERNS]
    table = spark.createDataFrame([(r.rule, r.verdict, r.site, r.regex, sorted(r.keys)) for r in rules], "rule string, verdict string, site boolean, regex string, keys array<string>")
    joined = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_by_join(pages, table).collect() if r["url"] is not None}
    assert joined == {u: got[k] for k, u in rows if u is not None}


def test_url_rules_by_join(spark):
    pages = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate([*PAGES, *MORE_PAGES])], "page_id long, url string")
    patterns = (*urls.PATTERNS, ("zzz", urls.BLOCK))
    rules = [urls.site_rule(*x) for x in urls.SITES] + [urls.pattern_rule(*x) for x in patterns]
    assert sum(not r.keys for r in rules) == 1
    table = spark.createDataFrame([(r.rule, r.verdict, r.site, r.regex, sorted(r.keys)) for r in rules], "rule string, verdict string, site boolean, regex string, keys array<string>")
    one = urls.filter_urls(pages, patterns=patterns).where("row.url IS NOT NULL").select("row.url", "host", "path", "rule", "verdict", "pattern").distinct()
    two = urls.filter_by_join(pages, table)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


MORE_PAGES = [
    ("http://h.org/x.exe", ".exe", "block"), ("http://h.org/x.exec", ".exe", "block"), ("http://h.org/exe", None, "allow"), ("http://h.org/tracker7/a/clicks", "/track*/click", "block"),
    ("http://h.org/racks/click", None, "allow"), ("http://h.org/xzzzx", "zzz", "block"), ("http://h.org/" + "a/" * 100_000 + "?sessionid=1", "?sessionid=", "block"), ("http://h.org/ads/1", "/ads/", "block"),
]


def test_url_patterns_by_open_tokens(spark):
    """Rules with tokens open on one side have keys; long and repeated urls; only the pattern without a key runs on all."""
    patterns = (*urls.PATTERNS, ("zzz", urls.BLOCK), ("*roll.png", urls.BLOCK))
    assert [sorted(urls.pattern_rule(x, "").keys) for x in (".exe", "/track*/click", "zzz", "*roll.png", "//ads.*/about/")] == [["^exe"], ["^click", "^track"], [], ["$roll", "^png"], ["=about", "=ads"]]
    pages = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(MORE_PAGES * 2)], "page_id long, url string").repartition(3)
    out = {r["page_id"]: (r["pattern"], r["verdict"]) for r in urls.filter_urls(pages, patterns=patterns).select("row.page_id", "pattern", "verdict").collect()}
    assert [out[k] for k in range(len(out))] == [(p, v) for _, p, v in MORE_PAGES * 2]


# Quotes


def test_quote_threads(spark):
    first = "Shall we ship the release on Friday?\nI think the tests are green now.\n\nSecond paragraph with more detail here."
    rows = [
        (1, 0, "user", first),
        (1, 1, "assistant", "On Monday, A wrote:\n> Shall we ship the release on Friday?\n> I think the tests are green now.\n\nYes, please do that today."),
        (1, 2, "user", "An unrelated remark about lunch."),
        (1, 3, "user", "> > Shall we ship the release on friday?\n> >  I think the tests are green now.\n> Yes, please do that today.\nGreat, thanks to all."),
        (1, 4, "user", "> never said by anyone at all\nHm."),
        (2, 0, "user", None), (2, None, "user", "no turn"), (2, 1, "user", ""), (None, 0, "x", "alone"), (3, 0, "user", LONG),
        (4, 0, "user", "same text here"), (4, 0, "user", "same text here"),
    ]
    messages = spark.createDataFrame([(*r, "b") for r in rows], "conv_id long, turn long, role string, text string, body string").repartition(3)
    out = quotes.link_quotes(messages)
    got = {(r["conv_id"], r["turn"]): r for r in out.select("row.conv_id", "row.turn", *[c for c in out.columns if c != "row"]).collect()}
    assert out.count() == len(rows)
    assert [got[1, t]["reply_to"] for t in range(5)] == [None, 0, None, 1, None]
    assert [got[1, t]["thread"] for t in range(5)] == [0, 0, 2, 0, 4]
    assert [got[1, t]["depth"] for t in range(5)] == [0, 1, 0, 2, 0]
    assert [got[1, t]["position"] for t in range(5)] == [0, 1, 3, 2, 4]
    assert [got[1, t]["quotes"] for t in range(5)] == [0, 1, 0, 2, 1]
    assert [got[1, t]["linked"] for t in range(5)] == [0, 1, 0, 2, 0]
    assert got[1, 1]["body"] == "Yes, please do that today." and got[1, 3]["body"] == "Great, thanks to all." and got[1, 0]["body"] == first
    assert got[2, 0]["body"] is None and got[2, None]["position"] == 2
    assert quotes.link_quotes(messages.limit(0)).count() == 0


def test_quotes_of_a_missing_message(spark):
    rows = [
        (1, 0, "Shall we ship the release on Friday?"), (1, 1, "An unrelated remark about lunch."),
        (1, 3, "> > Shall we ship the release on Friday?\n> Yes, as the missing message says.\nGreat, thanks to all."),
        (1, 4, "> > > Shall we ship the release on Friday?\n> > An unrelated remark about lunch.\n> Edited since it was quoted.\nFine."),
        (1, 5, "> > Great, thanks to all.\n> An unrelated remark about lunch.\nOn we go."),
    ]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3))
    got = {r["turn"]: r[1:] for r in out.select("row.turn", "quotes", "linked", "reply_to", "thread", "depth").collect()}
    assert got == {0: (0, 0, None, 0, 0), 1: (0, 0, None, 1, 0), 3: (2, 1, 0, 0, 1), 4: (3, 2, 1, 1, 1), 5: (2, 2, 1, 1, 1)}


def brute_quotes(texts):
    """{turn: (quotes, linked, reply_to, thread, depth, position, body)} of one conversation, message by message."""
    flat = lambda x: " ".join(x.split()).lower()
    units, quoted, bodies = {}, {}, {}
    for turn, text in texts.items():
        lines = [(m[1].count(">"), m[2]) for m in (re.match(r"((?:[ \t]*>)*)(.*)", x) for x in text.split("\n"))]
        own = [lv == 0 and not (re.search(quotes.ANNOUNCE, x) and [*lines, (0, "")][k + 1][0]) for k, (lv, x) in enumerate(lines)]
        said = "\n".join(x if o else "" for o, (_, x) in zip(own, lines, strict=True))
        wordy = lambda p: [flat(x) for x in p.split("\n") if len(x.split()) >= quotes.MIN_WORDS]
        units[turn] = {flat(p) for p in re.split(quotes.BLANK, said)} | {flat(said)} | set(wordy(said))
        quoted[turn] = []
        for lv, run in itertools.groupby(((lv, x) for lv, x in lines), key=lambda x: (x[0], not x[1].strip())):
            part = "\n".join(x for _, x in run)
            if lv[0] and not lv[1]:
                quoted[turn] += [(lv[0], 0, flat(part)), *((lv[0], 1, x) for x in wordy(part))]
        kept = "\n".join(x for o, (_, x) in zip(own, lines, strict=True) if o)
        bodies[turn] = re.sub(r"\n{3,}", "\n\n", kept).strip() if any(lv for lv, _ in lines) else text
    out, parent = {}, {}
    for turn in texts:
        first = lambda x: min((t for t in texts if x in units[t]), default=turn)
        found = [(-lv, -kind, first(x), x) for lv, kind, x in quoted[turn] if first(x) < turn]
        parent[turn] = max(f[:3] for f in found)[2] if found else None
        root, depth = turn, 0
        while parent[root] is not None:
            root, depth = parent[root], depth + 1
        passages = sum(kind == 0 for _, kind, _ in quoted[turn])
        out[turn] = [passages, len({(f[0], f[3]) for f in found if f[1] == 0}), parent[turn], root, depth, None, bodies[turn]]
    for k, turn in enumerate(sorted(out, key=lambda t: (out[t][3], t))):
        out[turn][5] = k
    return {t: tuple(x) for t, x in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_against_brute_force(spark, seed):
    rng, talks = np.random.default_rng(seed), {}
    for conv in range(25):
        texts = {}
        for turn in range(int(rng.integers(1, 12))):
            lines = []
            for _ in range(int(rng.integers(0, 3)) if texts else 0):
                old = texts[list(texts)[int(rng.integers(0, len(texts)))]].split("\n")
                a = int(rng.integers(0, len(old)))
                lines += ["On Monday, B wrote:"] * int(rng.integers(0, 2)) + [[">", "> ", " >  "][int(rng.integers(0, 3))] + x.upper() for x in old[a : a + int(rng.integers(1, 6))]]
            for _ in range(int(rng.integers(0, 4))):
                lines += ["", " "][: int(rng.integers(0, 3))] + [" ".join(f"w{x}" for x in rng.integers(0, 6, rng.integers(1, 5)))]
            texts[turn] = "\n".join(lines)
        talks[conv] = {t: x for t, x in texts.items() if rng.random() < 0.8}
    rows = [(c, t, x) for c, own in talks.items() for t, x in own.items()]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(3))
    got = {(r[0], r[1]): tuple(r[2:]) for r in got.select("row.conv_id", "row.turn", "quotes", "linked", "reply_to", "thread", "depth", "position", "body").collect()}
    assert got == {(c, t): x for c, own in talks.items() for t, x in brute_quotes(own).items()}
    assert sum(x[1] for x in got.values()) > 20


def test_quotes_deep_and_long(spark):
    rows = [(1, 0, "say this once more"), (1, 1, ">" * 20_000 + " say this once more"), (1, 2, "\n".join(">" * k + f" line number {k}" for k in range(1, 1500))), (1, 3, "> say this once more\n" + " " * 200_000 + "x\n" * 50_000), (1, 4, "> a\x01\x02b c d\nyes")]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string"))
    got = {r["turn"]: r[1:] for r in out.select("row.turn", "quotes", "linked", "reply_to").collect()}
    assert got == {0: (0, 0, None), 1: (1, 1, 0), 2: (1499, 0, None), 3: (1, 1, 0), 4: (1, 0, None)}


# Line dedup


def brute_lines(docs, min_words):
    """By the longest run at each line that occurs before."""
    seqs = []
    for d, t in sorted(docs):
        lines = t.split("\n")
        seqs.append((d, lines, [k for k, x in enumerate(lines) if words(x)]))
    flat = [(s, j, lines[k], len(words(lines[k]))) for s, (_, lines, own) in enumerate(seqs) for j, k in enumerate(own)]
    seen, gone = defaultdict(list), defaultdict(set)
    for n, (s, j, line, _) in enumerate(flat):
        best = 0
        for m in seen[line]:
            size = 1
            while n + size < len(flat) and flat[n + size][0] == s and flat[m + size][0] == flat[m][0] and flat[n + size][2] == flat[m + size][2]:
                size += 1
            best = max(best, size)
        seen[line].append(n)
        if best and sum(flat[n + x][3] for x in range(best)) >= min_words:
            gone[s] |= set(range(j, j + best))
    out = {}
    for s, (d, lines, own) in enumerate(seqs):
        dead = {k for j in gone[s] for k in range(own[j], own[j + 1] if j + 1 < len(own) else len(lines))}
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in dead)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 9, rng.integers(0, 5))) for _ in range(25)]
    rows = [(int(k), "\n".join(pool[int(i)] for i in rng.integers(0, 25 if k % 3 else 3, rng.integers(1, 25)))) for k in rng.permutation(80)]
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(documents(spark, rows), 6).select("row.doc_id", "text").collect()}
    assert out == brute_lines(rows, 6)


def test_lines_without_white_space_at_the_end(spark):
    rows = [(1, "one two three\nfour five six\nmine"), (2, "yours\r\none two three\r\nfour five six\r\n"), (3, "one two three \t\nfour five six"), (4, " one two three\nfour five six")]
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(documents(spark, rows), 6).select("row.doc_id", "text").collect()}
    assert out == {1: rows[0][1], 2: "yours\r", 3: "", 4: rows[3][1]}


def test_lines_odd(spark):
    docs = documents(spark, ODD)
    out = linededup.dedup_lines(docs, 2).select("row.doc_id", "text", "lines", "deleted").toPandas()
    assert len(out) == len(ODD) and out.deleted.sum() == 0 and out[out.doc_id == 4].text.iloc[0] == LONG
    copies = documents(spark, [(2, "a b c\nd e"), (1, "a b c\nd e"), (3, "a b c")])
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_documents(copies, 3).collect()} == {1: "a b c\nd e"}
    assert linededup.dedup_documents(docs).columns == docs.columns
    assert linededup.dedup_documents(documents(spark, EMPTY)).count() == 0


# Near-duplicates


def brute_components(rows, width, percent=80):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_brute_force(spark, width):
    rng = np.random.default_rng(width)
    rows = []
    for k in range(40):
        base = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(3, 90))]
        for _ in range(int(rng.integers(1, 7))):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, max(1, len(own) // 12) + 1)):
                own[at] = f"x{rng.integers(0, 99)}"
            rows.append((len(rows), " ".join(own).upper() if k % 2 else " ".join(own)))
    out = minhash.near_duplicates(documents(spark, rows), width=width).toPandas().set_index("doc_id")
    component, size = brute_components(rows, width)
    assert {d: int(out.component_id[d]) for d in component} == component
    assert {d: int(out.n_shingles[d]) for d in size} == size
    kept = minhash.dedup_documents(documents(spark, rows), width=width).toPandas()
    assert sorted(kept.doc_id) == sorted(set(component.values()))


def test_a_bucket_of_many_components(spark):
    """Few bands and rows: buckets hold texts that are not alike, and pivots go on until all pairs are settled."""
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 12, 14))) for k in range(120)]
    out = minhash.near_duplicates(documents(spark, rows), width=1, percent=80, bands=24, rows=1).toPandas().set_index("doc_id")
    component, _ = brute_components(rows, 1)
    assert {d: int(out.component_id[d]) for d in component} == component


def test_near_duplicates_odd(spark):
    out = minhash.near_duplicates(documents(spark, ODD)).toPandas()
    assert len(out) == len(ODD)
    assert out[out.doc_id == 3].component_id.tolist() == [3, 3] and out[out.doc_id == 2].n_shingles.tolist() == [0]
    kept = minhash.dedup_documents(documents(spark, ODD))
    assert kept.columns == documents(spark, ODD).columns and kept.where("doc_id = 3").count() == 1 and kept.count() == len(ODD) - 1
    assert minhash.dedup_documents(documents(spark, EMPTY)).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(5)
    for n in (1, 7, 400):
        own = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        assert (minhash.sketch(own, 160) < 2**64 - 1).all()
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    agree = np.mean([np.mean(minhash.sketch(a[: 900 + k], 400) == minhash.sketch(a[100 - k :], 400)) for k in range(5)])
    assert abs(agree - 0.8) < 0.05


# Language


def test_language_accuracy_and_odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out[out.held_out].lang_pred == out[out.held_out].lang).mean() > 0.97 and out.score.between(0, 1).all()
    assert all(bool(h) == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(out.doc_id, out.held_out, strict=True))
    odd = documents(spark, [*ODD, (11, "12345 ...", "a", None), (12, "the cat", "a", "en"), (13, "el gato", "a", "es"), (15, "the dog", "a", "en")])
    got = langid.identify(odd).toPandas()
    assert len(got) == len(ODD) + 4 and set(got[got.doc_id.isin([1, 2, 6, 11])].lang_pred) == {"und"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and not set(kept.toPandas().doc_id.dropna()) & {1, 2, 6, 11}
    assert set(langid.identify(documents(spark, [(1, "text", "a", None)])).toPandas().lang_pred) == {"und"}
    assert langid.identify(documents(spark, EMPTY)).count() == 0


def test_language_lengths_do_not_depend_on_slices(spark, monkeypatch):
    model = langid.learn(documents(spark, [(k, "the cat sat on the mat and the hat", "a", "en") for k in range(9)]))
    texts = [b"the cat", b"x" * 50, "zürich".encode(), b"a", b"the mat sat on"] * 3
    whole = model.lengths(texts)
    for size in (1, 2, 7, 40):
        monkeypatch.setattr(langid, "SLICE", size)
        np.testing.assert_allclose(model.lengths(texts), whole)


def test_language_rejects_what_is_in_none(spark):
    import base64

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [(90_001, base64.b64encode(bytes(k * k * 7919 // 256 % 256 for k in range(900))).decode()), (90_002, "これは学習していない言語の文章です。" * 5), (90_003, "12345 ... !!!"), (90_004, None)]
    rows = docs.unionByName(spark.createDataFrame([(d, t, None, "x", 0) for d, t in junk], DOCS).select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    kept = {r["doc_id"] for r in langid.keep_identified(rows).collect()}
    assert kept == {r["doc_id"] for r in docs.where("text IS NOT NULL").collect()}


def brute_bits(train, text):
    """PPM of one language by dictionaries, byte by byte."""
    counts = defaultdict(lambda: defaultdict(int))
    for t in train:
        data = b"\n" * 3 + t.encode()
        for k in range(3, len(data)):
            for order in range(4):
                counts[data[k - order : k]][data[k]] += 1
    data, bits = b"\n" * 3 + text.encode(), 0.0
    for k in range(3, len(data)):
        for order in (3, 2, 1, 0):
            seen = counts.get(data[k - order : k]) or {}
            total = sum(seen.values()) + len(seen)
            if data[k] in seen:
                bits -= math.log2(seen[data[k]] / total)
                break
            bits -= math.log2(len(seen) / total) if seen else 0
        else:
            bits += 8
    return bits


def test_language_rates_on_planted_junk(spark):
    """Of planted texts in no language nearly all go, of the given documents hardly any."""
    rng = np.random.default_rng(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").toPandas()
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    kinds = [
        lambda: " ".join(pick("0123456789", int(rng.integers(1, 9))) for _ in range(120)), lambda: " ".join(pick("0123456789abcdef", 32) for _ in range(20)),
        lambda: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 600), lambda: " ".join(pick("абвгдежзийклмнопрстуфхцчшщ", 6) for _ in range(60)),
        lambda: pick("#$%&*!?-=_+|", 400) + " the", lambda: "\n".join(f"{pick('0123456789', 4)};{pick('0123456789', 3)};x{pick('0123456789', 2)}" for _ in range(60)),
    ]
    junk = [(100_000 + k, kinds[k % len(kinds)](), None, None) for k in range(300)]
    rows = [(int(d), t, "a", g) for d, t, g in docs.itertuples(index=False)] + junk
    kept = {r["doc_id"] for r in langid.keep_identified(documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 100_000, F.col("lang")))).select("doc_id").collect()}
    assert sum(d in kept for d in docs.doc_id) >= 0.995 * len(docs)
    assert sum(j[0] not in kept for j in junk) >= 0.99 * len(junk)
    only = langid.keep_identified(documents(spark, rows[:1000]), wanted=["fr"]).toPandas()
    assert 0.97 < (only.lang == "fr").mean() and len(only) > 0.9 * (docs.lang == "fr").sum()


def test_language_code_lengths_against_brute_force(spark):
    texts = ["the cat sat on the mat", "the dog ran to the cat", "that hat"]
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1][: len(texts)]
    model = langid.learn(documents(spark, [(k, t, "a", "en") for k, t in zip(ids, texts, strict=True)]))
    for probe in ("the rat sat", "zürich", "q", "the cat " * 50):
        assert model.lengths([probe.encode()])[0, 0] == pytest.approx(brute_bits(texts, probe), rel=1e-4)


# Packing


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    odd = ["a\tb  c\n\n d", "x   y \n z  ", "日本語 текст ", "it's\xa0I'll <|endoftext|> ok", "  lead", "", None, "é" * 9, "\x1c a \x85 b", "1234 56  7\n"]
    rows = [*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True), *((10_000 + k, t) for k, t in enumerate(odd)), (10_000, odd[0]), (None, "null id")]
    out = packing.pack(documents(spark, rows), part_pieces=64).toPandas()
    pieces = defaultdict(list)
    for r in out.itertuples():
        pieces[r.doc_id if r.doc_id == r.doc_id else None].append(r)
    for d, t in rows:
        ids = np.array([*(encode.encode(t, add_special_tokens=False).ids if t is not None else []), 0], "<u4")
        head = len(ids) % 2048 or 2048
        spans = {(0, 0, head)} | {(k + 1, a, a + 2048) for k, a in enumerate(range(head, len(ids), 2048))}
        assert {(r.piece, r.start, r.start + r.length) for r in pieces[d]} == spans, d
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces[d])
    assert len(out) == sum(max(1, -(-sum(r.length for r in pieces[d]) // 2048)) for d, _ in rows if d is not None and d != 10_000) + 3
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 2048
    bound = packing.lower_bound(np.bincount(out.length, minlength=2049))
    assert bound <= out.sequence_id.nunique() <= bound + 1
    assert packing.pack(documents(spark, EMPTY)).count() == 0


def test_packing_goes_on_until_nothing_is_gained(spark):
    """Lengths that leave gaps in small parts: as few bins as one best-fit decreasing over all pieces, nearly."""
    rows = [(k, "a " * int(n)) for k, n in enumerate(np.random.default_rng(4).integers(8, 40, 900))]
    out = packing.pack(documents(spark, rows), capacity=64, part_pieces=40).toPandas()
    assert len(out) == len(rows) and out.groupby("sequence_id").length.sum().max() <= 64
    alone = packing.best_fit(out.length.to_numpy(), 64)[0].max() + 1
    assert packing.lower_bound(np.bincount(out.length, minlength=65)) <= out.sequence_id.nunique() <= alone * 1.02 + 1


#: Text that libraries could cut in different ways: white space of all kinds and in runs, letters and digits of several
#: scripts, joiners, marks, emoji, contractions, and the name of a special token.
SCRAPS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u3000", "\x85", "\x1c", "a", "the", "Don't", "É", "ß", "日本", "123", "½", "²", "!", "...", "’", "😀", "👩\u200d🔬", "\u0301", "<|endoftext|>", "_", "٣", "Ⅷ", "\u2028", "ſ", "'LL", "'s"]


def test_ids_against_tokenizers():
    encode = packing.Ids("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    table = pq.read_table(f"{SF.replace('0.001', '0.01')}/documents.parquet", columns=["text"])["text"].to_pylist()
    rng = np.random.default_rng(9)
    made = ["".join(SCRAPS[int(k)] for k in rng.integers(0, len(SCRAPS), rng.integers(1, 9))) for _ in range(30_000)]
    for text in [*filter(None, table), *made, *(chr(k) for k in range(0x3100))]:
        assert encode(text) == np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_bounds_hold_against_exhaustion():
    from functools import lru_cache

    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.integers(1, 11, 7)

        @lru_cache(None)
        def fewest(left, room):
            if not left:
                return 0
            return min((fewest(left[:k] + left[k + 1 :], room - n) if n <= room else 1 + fewest(left[:k] + left[k + 1 :], 10 - n)) for k, n in enumerate(left))

        best = fewest(tuple(sorted(lengths.tolist())), 0)
        bins, _ = packing.best_fit(lengths, 10)
        assert packing.lower_bound(np.bincount(lengths, minlength=11)) <= best <= bins.max() + 1
        assert max(np.bincount(bins, lengths)) <= 10


# Surrogates


def test_surrogates(spark):
    rows = [
        (1, "Mail Ann.Lee@mail.acme.com or call +1 (743) 555-3824, 743-555-3824. From 10.0.0.7 and 227.5.221.1."),
        (2, "ann.lee@MAIL.acme.com wrote; card 4111 1111 1111 1111 and 4111111111111111, not 3.1415.92"),
        (3, "Mrs. Maria Keller met Mr Keller. token = \"04dbebab91ab85687d33eea\" SSN 123-45-6789"), (4, "clean text, nothing here at all"), (5, None), (6, ""),
    ]
    out = {r["doc_id"]: r for r in pii.pseudonymise(documents(spark, rows)).select("row.doc_id", "text", "n_entities").collect()}
    kinds = {d: [e.kind for e in pii.entities(t)] for d, t in rows if t}
    assert kinds[1] == ["email", "phone", "phone", "ip", "ip"] and kinds[2] == ["email", "account", "account"] and kinds[3] == ["name", "name", "name", "secret", "ssn"]
    assert out[4]["text"] == rows[3][1] and out[5]["text"] is None and out[6]["text"] == ""
    one, two, three = (pii.entities(out[d]["text"]) for d in (1, 2, 3))
    assert [e.kind for e in one] == kinds[1] and [e.kind for e in two] == kinds[2]
    assert one[0].norm == two[0].norm and one[1].norm == one[2].norm and two[1].norm == two[2].norm
    assert out[1]["text"].startswith("Mail ") and "+1 (" in out[1]["text"] and one[0].norm.endswith(".com") and pii.luhn(two[1].norm)
    assert pii.network(one[3].norm) == "private" and pii.network(one[4].norm) == "multicast"
    given = re.search(r"Mrs\. (\w+) (\w+) met Mr (\w+)\.", out[3]["text"])
    assert given[1].lower() in pii.LISTS[0][1] and given[2] == given[3] and given[2][-1] == "r"
    for d, t in rows:
        for e in pii.entities(t or ""):
            assert t[e.start : e.end] not in out[d]["text"] or e.kind == "name"
    assert pii.pseudonymise(documents(spark, EMPTY)).count() == 0


def test_names_are_found_whole():
    text = "Mrs Laura Weber met Dr. Anna Maria Schmidt-Vogel. Weber said: WEBER, not Webers web. Herr Dr. McDonald and Laura Keller, Lauraville. Schmidt left"
    found = pii.entities(text)
    assert [text[e.start : e.end] for e in found] == "Laura Weber Anna Maria Schmidt Vogel Weber WEBER McDonald Laura Keller Schmidt".split()
    out, number = pii.replaced(text, {}, "k")
    assert number == 12 and not re.search(r"(?i)\b(Weber|Schmidt|Vogel|McDonald|Keller)\b", out)
    weber = re.search(r"^Mrs \w+ (\w+) met", out)[1]
    assert f" {weber} said: {weber.upper()}, not Webers web. Herr Dr. " in out and "Lauraville" in out
    assert not pii.entities("Anna went home. JoAnna Smith, Paula said, anna Smith")


def test_surrogates_are_distinct(spark):
    checked = lambda digits: next(digits + d for d in pii.DIGITS if pii.luhn(digits + d))
    rows = [(k, f"from 192.168.{k // 256}.{k % 256} to u{k}@x{k % 7}.example.com {checked(str(1000000000000 + k))}") for k in range(1200)]
    found = pii.found_in(documents(spark, rows))
    again = {(r["kind"], r["norm"]): r["attempt"] for r in pii.drawn_again(found, "k").collect()}
    norms = {(r["kind"], r["norm"]) for r in found.select("kind", "norm").distinct().collect()}
    values = {(kind, pii.surrogate(kind, norm, again.get((kind, norm), 0), "k")) for kind, norm in norms}
    assert len(norms) == 3600 and len(values) == 3600 and not values & norms
    assert all(a["text"] == b["text"] for a, b in zip(*[pii.pseudonymise(documents(spark, rows)).orderBy("row.doc_id").collect() for _ in range(2)], strict=True))


def test_surrogates_of_full_forms(spark):
    names = ["Bo", "Co", "Do", "Fo", "Go", "Ho", "Jo", "Ko", "Lo", "Mo", "No", "Po", "Qo", "Ro", "So", "To", "Vo", "Wo", "Xo", "Yo", "Zo"]
    rows = [(k, f"Mr {x} wrote.") for k, x in enumerate([*names, "Öo", *(x.title() for _, own in pii.LISTS for x in own)])]
    rows += [(100 + k, f"to {x}@b.com") for k, x in enumerate("aeiou")] + [(200 + k, f"to a@{x}.com") for k, x in enumerate("bcdfghjklmnpqrstvwxyz")]
    found = pii.found_in(documents(spark, rows))
    again = {(r["kind"], r["norm"]): r["attempt"] for r in pii.drawn_again(found, "k").collect()}
    norms = {(r["kind"], r["norm"]) for r in found.select("kind", "norm").distinct().collect()}
    values = {x: (x[0], pii.surrogate(*x, again.get(x, 0), "k")) for x in norms}
    listed = {("name", x) for _, own in pii.LISTS for x in own}
    assert len(set(values.values())) == len(norms) and not set(values.values()) & (norms - listed) and all(x != y for x, y in values.items())
    assert any(n > pii.TRIES for n in again.values()) and not listed & set(again)


def test_lengthened_surrogates():
    for kind, norm in (("phone", "5558243555"), ("account", "4111111111111111"), ("account", "4111111111111112"), ("ssn", "123456789"), ("iban", "DE12345678"), ("secret", "0a1b2c3d4e5f"), ("secret", "Zz1_2c3d4e5f")):
        assert len(pii.surrogate(kind, norm, pii.TRIES + 2, "k")) == len(norm) + 2
    assert pii.luhn(pii.surrogate("account", "4111111111111111", pii.TRIES + 1, "k"))
    assert pii.written("phone", "55512345678", "(743) 555-3824") == "(555) 123-45678"


#: What a value of each kind looks like, and must look like still.
FORMS = {
    "ssn": ("123-45-6789 078-05-1120 000-12-3456 919-00-0000 123456789", r"(\d{3})-?(\d\d)-?(\d{4})"),
    "secret": ("123456789012 00000000000000 04dbebab91ab85687d33eea deadbeefdead Zz1_2c3d4e5f A-B/C+d9e8f7", None),
    "phone": ("+1 (743) 555-3824 (743) 555-3824 743-555-3824 +44 20 7946 0958", r"[+\d ().-]+"),
    "account": ("4111111111111111 4111-1111-1111-1111 5500005555555559", r"\d{4}-?\d{4}-?\d{4}-?\d{4}"),
    "ip": ("10.0.0.7 192.168.3.4 172.20.1.1 8.8.8.8 227.5.221.1 127.0.0.1", r"(\d{1,3}\.){3}\d{1,3}"),
    "iban": ("DE89370400440532013000 GB29NWBK60161331926819", r"[A-Z]{2}\d{2}[A-Z0-9]+"),
    "email": ("ann.lee@mail.acme.com x_1@a-b.org", r"[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+"),
}


def shape(text):
    """Digits, letters by case, and everything else as it is."""
    return re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "9", text)))


def test_surrogates_keep_their_kind():
    for kind, (values, form) in FORMS.items():
        seen = set()
        for value in re.findall(r"\+\d+ \(\d+\) \S+|\(\d+\) \S+|\+44 \d\d \d+ \d+|\S+", values):
            norm = pii.normal(kind, value)
            for key in map(str, range(40)):
                out = pii.written(kind, pii.surrogate(kind, norm, 0, key), value)
                seen.add(out != value)
                if form:
                    assert re.fullmatch(form, out), (kind, value, out)
                if kind == "secret" and re.fullmatch("[0-9a-f]+", value) and not value.isdigit():
                    assert re.fullmatch("(?=.*[a-f])[0-9a-f]+", out) and len(out) == len(value)
                elif kind != "ip":
                    assert shape(out) == shape(value), (kind, value, out)
                if kind == "ssn":
                    lone = lambda x: (lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000")(re.sub(r"\D", "", x))
                    assert lone(out) == lone(value)
        assert True in seen
    text = "SSN 123-45-6789 and 078-05-1120."
    out = pii.replaced(text, {}, pii.KEY)[0]
    assert re.fullmatch(r"SSN \d{3}-\d{2}-\d{4} and \d{3}-\d{2}-\d{4}\.", out) and [e.kind for e in pii.entities(out)] == ["ssn", "ssn"] and "6789" not in out


def test_permutation_is_one():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permuted(k, size, b"key") for k in range(size)) == list(range(size))
    assert len({pii.respelled(f"{a}{b}" + "x" * 40 + c, "k") for a in "ab" for b in "xyz" for c in "aeiou"}) == 30


def brute_surrogates(texts, key):
    """All entities in one set; whoever has a value that is taken, or that another has drawn before, draws again."""
    norms = {(e.kind, e.norm) for t in texts if t for e in pii.entities(t)}
    listed, drawn = {x for _, own in pii.LISTS for x in own}, dict.fromkeys(norms, 0)
    for attempt in range(1, 100):
        owners = defaultdict(list)
        for (kind, norm), n in drawn.items():
            owners[kind, pii.surrogate(kind, norm, n, key)].append((n, norm))
        again = [(kind, norm) for (kind, value), own in owners.items() for _, norm in (own if (kind, value) in norms and value not in listed else sorted(own)[1:])]
        if not again:
            return [t if t is None else pii.replaced(t, drawn, key)[0] for t in texts]
        drawn |= dict.fromkeys(again, attempt)


def test_surrogates_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    rows += [(10_000 + k, f"Mr {x} wrote to {y}@b.com from 10.0.0.{k}.") for k, (x, y) in enumerate(zip("Al El Il Ol Ul Al Ab".split(), "aeiouae", strict=True))]
    rows += [(20_000, "Мария Иванова, Андрей Петров, Елена Смирнова, Пётр Попов"), (20_001, rows[5][1]), (20_001, rows[5][1])]
    out = pii.pseudonymise(documents(spark, rows)).select("row.doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted(zip([d for d, _ in rows], brute_surrogates([t for _, t in rows], pii.KEY), strict=True))
    names = next(r["text"] for r in out if r["doc_id"] == 20_000)
    assert all(a != b for a, b in zip(names.split(), rows[-3][1].split(), strict=True))


def test_surrogates_of_long_entities_and_look_alikes(spark):
    blob = "".join("Ab9+/c_-"[k * k % 8] for k in range(200_000))
    rows = [(1, f"password={blob} end"), (2, f"token: {'0123456789abcdef' * 20_000}"), (3, LONG + " mail me@x.org " + LONG), (4, "Version 1.2.3.4, v10.0.0.1 and card 4111 1111 1111 1112 stay"), (5, f"Mr {'X' + 'y' * 50_000} left")]
    out = {r["doc_id"]: r for r in pii.pseudonymise(documents(spark, rows)).select("row.doc_id", "text", "n_entities").collect()}
    assert [out[k]["n_entities"] for k in range(1, 6)] == [1, 1, 1, 0, 1] and out[4]["text"] == rows[3][1]
    for k in (1, 2, 5):
        assert len(out[k]["text"]) == len(rows[k - 1][1]) and sum(a == b for a, b in zip(out[k]["text"], rows[k - 1][1])) < 0.4 * len(out[k]["text"])
