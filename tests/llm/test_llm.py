"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its defined cases."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, raw string, block int, word string, rep long"
ODD = [None, "", " ", "\n", "x", "A a A", "one two three four", "one two three four five", "ünï cødé 日本 🙂", "a\0b c", "  lead and  twin \n\n spaces ", "=" * 3000, "so it goes " * 2000]


def docs(spark, texts, langs=None):
    """Documents with extra columns whose names an operator might use itself, a repeated row and a null id."""
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or ""), -i, "raw", 1, "word", 7) for i, t in enumerate(texts)]
    rows += [rows[-1], (None, "a null id has this text of seven words", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def sample_texts(n=120, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# --- language-model scoring


def test_elias_fano():
    from pomona.llm.ef_trie import STEP, EliasFano, Level, Trie, quantise, restore

    rng = np.random.default_rng(1)
    for n, u in ((1, 1), (5, 40), (1000, 1000), (2000, 10**9), (300, 7), (700, 1 << 50)):
        v = np.sort(rng.integers(0, u, n)).astype(np.uint64)
        e = EliasFano(v, u)
        assert (e.access(np.arange(n)) == v).all()
        x = np.r_[rng.integers(0, u, 500).astype(np.uint64), v]
        at, hit = e.next_geq(x)
        assert (at == np.searchsorted(v, x)).all() and (hit == np.isin(x, v)).all()
    p = rng.random(1000) ** 9 + 1e-9
    assert np.abs(np.log10(restore(quantise(p))) - np.log10(p)).max() <= STEP / 2 + 1e-9
    pairs = sorted(set(zip(rng.integers(0, 30, 900).tolist(), rng.integers(0, 2**32, 900).tolist())))
    of, symbol = (np.array(x) for x in zip(*pairs))
    level = Level(40, of, symbol.astype(np.uint32), np.arange(len(of)).astype(np.uint8))
    assert (level.find(of, symbol) == np.arange(len(of))).all()
    assert (level.find((of + 1) % 30, symbol) == -1).all() and (level.find(np.array([-1, 35]), symbol[:2]) == -1).all()
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    assert (level.find(of[first], symbol, np.diff(np.r_[first, len(of)])) == np.arange(len(of))).all()
    none = np.zeros(0, np.int64)
    trie = Trie(np.array([5, 9], np.uint64), np.array([0, 0]), (none, none, none), (none, none, none, none), 1.0, 1.0)
    assert trie.context(np.array([9, 7], np.uint64)).tolist() == [1, -1]
    assert (trie.successors.code(trie.successors.find(np.array([0, 1]), np.array([3, 4]))) == 255).all()


def test_lm_scores(spark, monkeypatch):
    from pomona.llm import lm_score

    texts = sample_texts() + ODD
    df = docs(spark, texts)
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in df.collect()]
    c = Counter(w for i, t in rows if crc(i, 7) != 2 for w in t)
    n, v = sum(c.values()), len(c)
    got = sorted(lm_score.score_texts(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    for r, (i, t) in zip(got, rows):
        assert r.doc_id == i and r.held_out == (crc(i, 7) == 2) and r.train_tokens == n
        assert r.n_tokens == len(t) and r.n_known == sum(c[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs=1e-7)
    # many blocks, shards and hot words give the same
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 2000)
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 900)
    monkeypatch.setattr(lm_score, "HOT_PART", 30)
    again = sorted(lm_score.score_texts(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.score for r in again] == pytest.approx([r.score for r in got], abs=1e-6)
    assert lm_score.score_texts(empty(spark)).count() == 0


@pytest.mark.parametrize("shard_tokens", [2_000_000, 300])
def test_lm_is_brute_force_trigram(spark, monkeypatch, shard_tokens):
    """Scores are those of the model's formula with fixed discounts and the tries' rounding, in one shard or many."""
    from pomona.llm import lm_score
    from pomona.llm.ef_trie import quantise, restore

    monkeypatch.setattr(lm_score, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 1000 if shard_tokens == 300 else 10**6)
    df = docs(spark, sample_texts(60) + ODD)
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in df.collect()]
    uni, one, two, big, tri = Counter(), Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        if crc(i, 7) != 2:
            t = ["<s>", "<s>", *t, None]
            for a, b, c in zip(t, t[1:], t[2:]):
                uni[c] += 1
                one[b] += 1
                two[a, b] += 1
                big[b, c] += 1
                tri[a, b, c] += 1
    total = sum(uni.values()) + len(uni) + 1
    rounded = lambda p: float(restore(quantise(np.array([p])))[0]) if p else 0.0
    got = {r.doc_id: r.score for r in lm_score.score_texts(df).collect()}
    for i, t in rows:
        t, score = ["<s>", "<s>", *t, None], 0.0
        for a, b, c in zip(t, t[1:], t[2:]):
            p = rounded(big[b, c] / (one[b] + lm_score.K2)) + lm_score.K2 / (one[b] + lm_score.K2) * (uni[c] + 1) / total
            p = rounded(tri[a, b, c] / (two[a, b] + lm_score.K3)) + rounded(lm_score.K3 / (two[a, b] + lm_score.K3)) * p
            score += math.log10(p)
        assert got[i] == pytest.approx(score, abs=1e-6)


# --- url filters

URLS = [None, "", "no scheme/here", "http://A.Example.COM/en/1", "https://www.example.com/en/x?q#f", "https://www.example.com/de/", "ftp://x.net/es/9", "http://net/es/9", "http://x.net/es", "http://x.net?es", "http://a://b/c", "//x", "http://sub.x.net/fr/a/b/c/d/e/f/g", "http://notexample.com/en/2", "http://h/" + "z" * 5000, "http://q.org/en/1\n2?x"]


def url_brute(u):
    from pomona.llm.url_filter import RULES

    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for _, r in RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    from pomona.llm.url_filter import RULES, judge_urls

    verdicts = {r: v for v, r in RULES}
    urls = URLS + [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame([(i, u, "h", "p", "t") for i, u in enumerate(urls)] + [(None, "http://x.net/es/", "", "", "")] * 2, "page_id long, url string, host string, path string, template string")
    got = judge_urls(df).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule) == url_brute(urls[r.page_id])
            assert r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert judge_urls(df.where("false")).count() == 0


def test_url_templates_learn(spark):
    from pomona.llm.url_filter import judge_urls

    rows = [(i, f"http://{h}/{p}/{i}") for i in range(300) for h, p in (("a.net", "es"), ("a.net", "en"))] + [(9000 + i, f"http://a.net/w{i}/x") for i in range(60)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=(("block", "net/es/"), ("allow", "net/en/1"))).collect()
    free = [r for r in got if r.rule is None]
    assert {r.template for r in free if r.path.startswith("/en/")} == {"/en/*"} and all(r.verdict == "allow" for r in free)
    assert {r.template for r in got if r.page_id >= 9000} == {"/*/x"}


def test_url_templates_deep(spark):
    """Branches part and merge at any depth; a shared run of segments costs one round, however long."""
    from pomona.llm.url_filter import judge_urls, template_tree

    deep = "/".join(["a"] * 300)
    rows = [(f"http://h.org/{deep}/{kind}/x{'' if i % 2 else '/y'}", kind) for kind in ("good", "fine", "bad") for i in range(20)]
    shapes = [(u.split("/")[2], u.split("/")[3:], int(k == "bad")) for u, k in rows]
    tree = {tuple(r["shape"])[300:]: r for r in template_tree(spark.createDataFrame(shapes, "host string, shape array<string>, blocked int")).collect()}
    assert {k: r.rejected for k, r in tree.items()} == {(k, "x", *y): k == "bad" for k in ("good", "fine", "bad") for y in ((), ("y",))}
    # good and fine are merged: their leaves pool 20 labels; bad's have 10
    assert tree["good", "x"].purity == tree["fine", "x"].purity == pytest.approx((20 + 4 * 0.8) / 24)
    assert tree["bad", "x"].purity == pytest.approx(4 * 0.8 / 14)
    urls = [(i, f"http://h.net/s/{'es' if i % 2 else 'en'}/{i}") for i in range(40)] + [(100, "http://sub.h.net/s/es/1")]
    got = judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules=(("block", "h.net/s/es/"), ("allow", "h.net/s/en/1")))
    assert {r.verdict for r in got.where("page_id % 2 = 0 and page_id < 100").collect()} == {"allow"}


# --- toxicity


def test_toxicity(spark):
    from pomona.llm.toxicity import isotonic, score_toxicity

    rng = random.Random(2)
    bad = ["idiot", "wretch", "blockhead"]
    texts, toxic = [], []
    for t in sample_texts(600, 3):
        y = rng.random() < 0.3
        w = t.split() + ["filler"]
        for _ in range(3 * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append(" ".join(w))
        toxic.append(int(y))
    df = docs(spark, texts + ODD)
    labels = spark.createDataFrame([(i, y, "x") for i, y in enumerate(toxic)] + [(None, 1, "x"), (3, None, "x"), (5, toxic[5], "x")], "doc_id long, toxic int, raw string")
    got = score_toxicity(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc(r.doc_id, 5) == 0) for r in got)
    held = [(r.predicted, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < len(toxic)]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    # labels of the held-out fold change nothing
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in score_toxicity(df, other).collect()} == {(r.doc_id, r.score) for r in got}
    assert score_toxicity(empty(spark), labels).count() == 0
    assert {r.score for r in score_toxicity(df, labels.where("false")).collect()} == {0.0}
    x, y = isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(y) >= 0).all()


def plain_features(text, lexicon):
    """The dense features of one text, word by word and byte by byte."""
    from pomona.llm import toxicity as T

    raw = text.encode()
    w = [x for x in raw.lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split() if x]
    hits = [max(lexicon.get(u, 0.0) for u in T.units(x)) for x in w]
    you = [T.units(x)[0] in T.SECOND_PERSON for x in w]
    at = [i for i, h in enumerate(hits) if h > 0]
    inner = [x.strip(T._STRIP) for x in w]
    odd = [not x.isalpha() and x.isascii() and any(97 <= c <= 122 for c in x) and any(c in b"0134578@$*!_" for c in x[1:]) for x in inner]
    n, size = max(len(w), 1), max(len(raw), 1)
    is_in = lambda a, z: [a <= c <= z for c in raw]
    cap, low = is_in(65, 90), is_in(97, 122)
    punct = [33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in raw]
    share = sum(cap) / size, sum(low) / size
    return [
        len(at), len(at) / n, sum(hits), sum(hits) / n, max(hits, default=0), len({w[i] for i in at}), sum(any(you[j] for j in range(max(0, i - 4), min(len(w), i + 5))) for i in at),
        sum(you) / n, share[0] / max(sum(share), 1e-9), sum(a and b for a, b in zip(cap, cap[1:])) / size, sum(punct) / size, sum(c in b"!?" for c in raw) / size,
        sum(odd) / n, sum(a == b for a, b in zip(raw, raw[1:])) / size, math.log1p(len(w)), sum(map(len, w)) / n, sum(is_in(48, 57)) / size, sum(c > 127 for c in raw) / size,
    ]


def test_toxicity_features_are_plain():
    """A text's features are its own, whatever stands before it in a batch."""
    from pomona.llm.toxicity import dense

    rng = random.Random(16)
    lexicon = {b"rotten": 4.0, b"^fool": 3.5, b"idiot": 5.0}
    bits = ["rotten", "FOOLISH", "fools", "you", "Your", "1d10t", "id*ot", "AAA", "A", "aa!!", "fine", "dich", "ünï", "a1b2", "x\x1cy", "\x0b", "...", "7"]
    texts = ["", "A", "AAB", "B", "zz", "z"] + [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["rotten you " * 3000]
    got = dense(pa.array(texts), lexicon)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_features(t, lexicon), abs=1e-9), t
        assert (dense(pa.array([t]), lexicon)[0] == got[i]).all()


def test_boosted_trees_and_isotonic_are_plain():
    from pomona.llm import toxicity as T

    rng = np.random.default_rng(17)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = T.boost(x, y)
    for row, raw in zip(x[:50], m.raw(x[:50])):  # trees walked node by node
        total = m.prior
        for f, c, leaf in zip(m.feature, m.cut, m.leaf):
            node = 0
            while node < 2**T.DEPTH - 1:
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += leaf[node - 2**T.DEPTH + 1]
        assert raw == pytest.approx(total)
    # the first split is the best of all by exhaustive search over the same cuts
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p) + 1e-6)
    gain = lambda k: sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (k, ~k)) - g.sum() ** 2 / (h.sum() + 1)
    best = max(gain(x[:, f] <= c) for f, e in enumerate(T._edges(x)) for c in e)
    assert gain(x[:, m.feature[0][0]] <= m.cut[0][0]) == pytest.approx(best)
    assert ((m.raw(x) > 0) == y).mean() > 0.95
    # isotonic regression against its min-max formula
    p, y = rng.random(60), (rng.random(60) < 0.5).astype(float)
    order = np.argsort(p)
    q = y[order]
    fit = [max(min(q[a : z + 1].mean() for z in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    xs, ys = T.isotonic(p, y)
    assert np.abs(np.interp(p[order], xs, ys) - fit).max() < 0.04 and (np.diff(ys) >= 0).all()


def test_lexicon_prefers_telling_entries(spark, monkeypatch):
    """Frequent entries that say little must not crowd out rare ones that say all."""
    from pomona.llm import toxicity

    monkeypatch.setattr(toxicity, "LEXICON", 6)
    monkeypatch.setattr(toxicity, "LEAST_ODDS", 1.0)
    rows = []
    for i in range(600):
        y = int(i % 6 == 0)
        w = ["calm", "words", "here"] + [f"vague{k}x" for k in range(12) if (i * 7 + k) % (3 if y else 9) == 0] + ["rotten"] * (y and i % 12 == 0)
        rows.append((i, " ".join(w), y))
    found = toxicity._lexicon(spark.createDataFrame(rows, "doc_id long, raw string, toxic int"))
    assert b"rotten" in found and len(found) == 6


# --- nearest neighbours


def neighbours_brute(rows, k=20):
    """All candidates of each query row by exact inner products; one row stands for itself alone."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = np.lexsort((ids, -np.round(s, 9)))
        out.append((int(ids[i]), [(int(ids[j]), s[j]) for j in order if j != i][:k]))
    return out


def test_neighbours(spark):
    from pomona.llm.ann import neighbours

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist(), "a", "b", 1, 2, 3, [1], 4) for i, v in enumerate(x)]
    rest = ("a", "b", 1, 2, 3, [1], 4)
    bad = [(5000, None, *rest), (5020, [0.0] * 16, *rest), (5040, [float("nan")] + [1.0] * 15, *rest), (5060, [None] + [1.0] * 15, *rest), (5080, [1.0, 2.0], *rest), (5100, [float("inf")] * 16, *rest), (5120, [], *rest), (None, [1.0] * 16, *rest)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, list string, v string, chunk int, query_id int, h1 long, ids array<int>, class long")
    got = neighbours(df).collect()
    hits = 0
    for q, best in neighbours_brute(rows):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and len({r.vec_id for r in own}) == 20 and q not in {r.vec_id for r in own}
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        assert np.allclose([r.score for r in own], s[[r.vec_id for r in own]], atol=1e-12, rtol=0)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({i for i, _ in best} & {r.vec_id for r in own})
        if 100 <= q < 140:  # copies come in the order of their ids
            assert [r.vec_id for r in own] == [i for i, _ in best]
    assert hits / (60 * 20) >= 0.9 and {r.query_id for r in got} == set(range(0, 1200, 20))
    assert len(neighbours(df.where("vec_id < 6")).collect()) == 5
    assert neighbours(df.where("false")).count() == 0


def test_neighbours_of_repeated_rows(spark):
    """Every row but the query's own is a candidate, whatever id or vector it shares."""
    from pomona.llm.ann import neighbours

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(12)]
    rows += [rows[0], rows[0], (0, rows[3][1]), rows[5]] + [(40 + i, rows[1][1]) for i in range(60)]
    got = Counter((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == Counter((q, n + 1, i, round(s, 6)) for q, near in neighbours_brute(rows) for n, (i, s) in enumerate(near))


def test_neighbours_in_tight_clusters(spark):
    """A small list far from all others still answers with k rows."""
    from pomona.llm.ann import neighbours

    rng = np.random.default_rng(6)
    centres = np.eye(16) * 10
    x = np.concatenate([centres[i] + rng.normal(size=(700 if i else 6, 16)) * 0.01 for i in range(6)]).astype(np.float32)
    got = neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert Counter(r.query_id for r in got) == {q: 20 for q in range(0, len(x), 20)}


def test_index_with_two_levels():
    """Lists grow with the rows; routes hold the best sums of both levels, and recall is kept."""
    from pomona.llm import ann

    assert ann.levels(1000, 1000) == (2, 1) and ann.levels(512 * 256, 16000) == (256, 1)
    a, b = ann.levels(512 << 14, 16000)
    assert (a, b) == (256, 64) and ann.levels(10**12, 16000) == (1024, 1024)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16)) + rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 2
    index = ann.fit(x, 512 * 2000)
    assert len(index.second) > 1
    lists = index.list_of(x)
    sizes = np.bincount(lists, minlength=index.lists)
    q = x[:200]
    found = {i: set() for i in range(200)}
    for rows, at in index.route(q, sizes, 20):
        for r, l in zip(rows.tolist(), at.tolist()):
            found[r].add(l)
    every = index.centroid(np.arange(index.lists)) @ q.T
    hits = 0
    for i in range(200):
        best = np.argsort(-every[:, i], kind="stable")[: index.probes]
        assert {l for l in best.tolist() if sizes[l]} <= found[i]
        s = x @ q[i]
        s[i] = -np.inf
        hits += sum(lists[j] in found[i] for j in np.argsort(-s)[:20])
    assert hits / 4000 >= 0.95


# --- near-duplicates


def near_brute(pairs, percent=85):
    sets = {}
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in ids}


def test_near_groups(spark, monkeypatch):
    from pomona.llm import near_dup

    rng = random.Random(5)
    texts = sample_texts(60, 6) + ODD
    for base in [" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) for _ in range(3)]:
        for _ in range(25):
            w = base.split()
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[70].upper()]
    df = docs(spark, texts)
    sets, root = near_brute([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None])
    for small in (8, 2):  # with 2, buckets are finished in blocks
        monkeypatch.setattr(near_dup, "SMALL", small)
        monkeypatch.setattr(near_dup, "BLOCK", 5 if small == 2 else 256)
        monkeypatch.setattr(near_dup, "HOT_MEMBERS", 4 if small == 2 else 512)  # and hot buckets are joined by broadcast
        monkeypatch.setattr(near_dup, "HUB_PAIRS", 3 if small == 2 else 512)
        got = near_dup.near_groups(df).collect()
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id][0]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert near_dup.near_groups(empty(spark)).count() == 0


def test_near_groups_from_another_threshold(spark):
    """Pairs at 0.802 and 0.835 are linked by the pipeline's stage, not at 85 %; pairs at 0.786 never are."""
    import corpus_pipeline
    from pomona.llm.near_dup import banding, near_groups

    assert banding(85) == (32, 8) and banding(80) == (42, 6)
    texts = []
    for i in range(90):  # 100 shingles each, of which the second text changes the last 11, 9 or 12
        w = [f"w{i}x{k}" for k in range(104)]
        texts += [" ".join(w), " ".join(w[: -(11, 9, 12)[i % 3]] + [f"z{i}x{k}" for k in range((11, 9, 12)[i % 3])])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_groups(df).where("kept").count() == 180
    linked = {2 * i + 1 for i in range(90) if i % 3 < 2}
    assert {r.doc_id for r in near_groups(df, percent=80).where("not kept").collect()} == linked
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()} == set(range(180)) - linked


def test_superminhash_estimates():
    from pomona.llm.near_dup import superminhash

    rng = np.random.default_rng(7)
    for n, common in ((40, 30), (400, 300), (3, 2)):
        errors = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 2 * n - common).astype(np.uint64)
            s = superminhash(np.r_[x[:n], x[-n:]], np.array([n, n]))
            errors.append((s[0] == s[1]).mean() - common / (2 * n - common))
        assert abs(np.mean(errors)) < 0.03
        assert (s >> np.uint64(48) < 256).all()


def test_components(spark):
    from pomona.llm.near_dup import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 105: 100, 103: 100}


# --- byte-level BPE and packing


def test_bpe(spark):
    import tiktoken

    from pomona.llm.bpe import load_ranks, round_trip

    path = P.path("byte_bpe_50k.tiktoken")
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choice(" \nabté'12.\t Ж🙂the\x1c") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    reference = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_ranks(path).tokens, special_tokens={})
    df = docs(spark, texts)
    source = {r.doc_id: r.text or "" for r in df.collect()}
    for r in round_trip(df, path, P.PATTERN, keep_ids=True).collect():
        ids = reference.encode_ordinary(source[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(source[r.doc_id].encode()).hexdigest()
    assert round_trip(empty(spark), path, P.PATTERN).count() == 0


def test_slices_read_their_own_texts():
    """Arrow slices must not be read from the start of their buffers."""
    from pomona.llm.common import text_slices, words

    b = pa.RecordBatch.from_arrays([pa.array(sample_texts(200))], names=["raw"])
    parts = list(text_slices(iter([b]), "raw", 500))
    assert len(parts) > 5 and sum(p.num_rows for p in parts) == 200
    for p in parts:
        offsets, ids, distinct = words(p.column("raw"))
        values = distinct.to_pylist()
        for a, z, t in zip(offsets[:-1], offsets[1:], p.column("raw").to_pylist()):
            assert [values[i] for i in ids[a:z]] == t.encode().split()


def test_every_token_encodes_to_itself():
    """What the packing's encoder rests on, for the library and file in use."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path).model
    for token, i in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items():
        if token != "<|endoftext|>":
            assert [t.id for t in model.tokenize(token)] == [i]


def test_packing(spark):
    from tokenizers import Tokenizer

    from pomona.llm.packing import pack_texts

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ODD + ["a<|endoftext|>b"] + sample_texts(300, 9) + ["word " * 5000]
    df = docs(spark, texts).repartition(3)
    got = pack_texts(df, path, P.PATTERN, keep_ids=True).collect()
    ids_of = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in df.collect()}
    rows = Counter(r.doc_id for r in df.collect())
    seen, places = Counter(), {}
    for r in got:
        ids = ids_of[r.doc_id][r.start : r.start + r.length]
        assert r.ids == ids and r.doc_tokens == len(ids_of[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(seen[d, k] == n for d, n in rows.items() for k in range(len(ids_of[d])))
    for runs in places.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert pack_texts(empty(spark), path, P.PATTERN).count() == 0


def test_packing_keeps_added_tokens(spark):
    """The library's ids by its default, which knows the file's added token inside a text."""
    from tokenizers import Tokenizer

    from pomona.llm.packing import pack_texts, token_ids

    path, end = P.path("byte_bpe_50k.json"), "<|endoftext|>"
    t = Tokenizer.from_file(path)
    texts = [f"a {end} b", end, end * 3, f"{end}a", f"a  {end}  ", f"\n{end}\n\n{end} x", "<|endoftext|", f"<|{end}|>", f"日本{end}🙂\0{end} lead"]
    texts = [x for pair in zip(texts, ["plain words here", "", None, " ", "\n", "x  y", "=" * 50, "it's", "ünï"]) for x in pair]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 220, 50256, 275]
    for end_id in (None, 1):
        for at in (0, 3):
            flat, begin = token_ids(pa.array(texts).slice(at), path, P.PATTERN, end_id)
            assert [flat[a:z].tolist() for a, z in zip(begin[:-1], begin[1:])] == [w + [1] * (end_id is not None) for w in want[at:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in pack_texts(df, path, P.PATTERN, keep_ids=True).orderBy("doc_id", "start").collect():
        assert r.doc_tokens == len(want[r.doc_id]) + 1
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: w + [1] for i, w in enumerate(want)}


def test_packer_limits():
    from pomona.llm.packing import Packer, Piece

    rng = np.random.default_rng(10)
    packer, out, total = Packer(0, 128, 4, 60, 16), [], 0
    for i in range(300):
        n = int(rng.integers(1, 200))
        total += n
        out += packer.add(Piece(i, 0, np.arange(n, dtype="<u4"), np.arange(n) >= n // 2, n))
    out += packer.finish()
    by = {}
    for p, s, at in out:
        by.setdefault(s, []).append(p)
    assert sum(len(p.ids) for p, _, _ in out) == total
    for pieces in by.values():
        assert sum(len(p.ids) for p in pieces) <= 128 and len(pieces) <= 4 and sum(int(p.loss.sum()) for p in pieces) <= 60


# --- media columns


def test_jpeg(spark):
    from pomona.llm import jpeg

    rng = np.random.default_rng(11)
    payloads = [b"", b"a", b"x" * 64, b"\0" * 200, bytes(range(256)) * 3, rng.integers(0, 256, 70000).astype(np.uint8).tobytes(), b"\xff" * 999, b"\0" * 63 + b"a", b"a" + b"\0" * 62 + b"b"]
    files = jpeg.encode(payloads)
    for p, m, (frame, coef) in zip(payloads, files, jpeg.decode(files)):
        assert m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9"
        assert jpeg.payload(frame, coef) == p + b"\0" * (max(64, -(-len(p) // 64) * 64) - len(p))
        thumb = jpeg.thumbnail(frame, coef)
        assert thumb.shape == (frame.height // 8, frame.width // 8) and thumb[0, 0] == min(255, (p[:1] or b"\0")[0] // 8 + 128)
    df = docs(spark, ODD)
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    for r in jpeg.store_text(df, keep_media=True).collect():
        p = texts[r.doc_id]
        padded = p + b"\0" * (r.payload_bytes - len(p))
        assert r.n_bytes == len(p) and r.payload_bytes == max(64, -(-len(p) // 64) * 64)
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert jpeg.store_text(empty(spark)).count() == 0


def test_jpeg_long_payloads(monkeypatch):
    """Long payloads are coded and decoded some blocks at a time, with the same bytes; any length has a grid."""
    from pomona.llm import jpeg

    for n in (1, 600 << 20, 3 << 30, jpeg.SIDE**2 * 64):
        w, h = jpeg._grid(-(-n // 64))
        assert w * h * 64 >= n and jpeg._header(n, w, h)
    rng = np.random.default_rng(15)
    payloads = [b"a", rng.integers(0, 256, 90000).astype(np.uint8).tobytes(), b"b" * 70, b"\xff" * 70000]
    files = jpeg.encode(payloads)
    monkeypatch.setattr(jpeg, "BLOCKS", 100)
    assert jpeg.encode(payloads) == files
    for p, (frame, coef) in zip(payloads, jpeg.decode(files)):
        assert jpeg.payload(frame, coef).rstrip(b"\0") == p


def test_jpeg_without_restarts_and_with_signs():
    """A file of one interval, with differential DC and negative values, made bit by bit."""
    from pomona.llm import jpeg

    rng = np.random.default_rng(12)
    coef = np.where(rng.random((6, 64)) < 0.2, rng.integers(-200, 200, (6, 64)), 0)
    bits, last = "", 0
    put = lambda code, length: format(int(code), f"0{int(length)}b")
    value = lambda v, s: format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""
    for block in coef.tolist():
        d, last = block[0] - last, block[0]
        s = abs(d).bit_length()
        bits += put(jpeg.DC_CODE[s], jpeg.DC_LEN[s]) + value(d, s)
        run = 0
        for v in block[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits, run = bits + put(jpeg.AC_CODE[0xF0], jpeg.AC_LEN[0xF0]), run - 16
            s = abs(v).bit_length()
            bits, run = bits + put(jpeg.AC_CODE[run << 4 | s], jpeg.AC_LEN[run << 4 | s]) + value(v, s), 0
        if run:
            bits += put(jpeg.AC_CODE[0], jpeg.AC_LEN[0])
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    head = jpeg._header(384, 3, 2).replace(b"\xff\xdd\0\4\0\1", b"")
    ((frame, got),) = jpeg.decode([head + scan + b"\xff\xd9"])
    assert frame.restart == 0 and (got == coef).all()


# --- language ID


def test_language_id(spark):
    from pomona.llm.lang_id import identify

    rng = random.Random(13)
    parts = {"aa": ["ka", "to", "mi", "su"], "bb": ["sch", "ver", "ung", "öl"], "cc": ["ció", "ada", "ón", "llo"]}
    texts, langs = [], []
    for i in range(240):
        lang = sorted(parts)[i % 3]
        texts.append(" ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 30))))
        langs.append(lang)
    odd = [None, "", "123 ...", "!?", "語"]
    df = docs(spark, texts + odd, langs + [None] * 5)
    got = {r.doc_id: r for r in identify(df).collect()}
    assert len(got) == len(texts) + 6
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.held_out == (crc(i, 4) == 2)
    assert [got[len(texts) + k].lang_pred for k in range(4)] == ["und"] * 4 and got[len(texts) + 4].lang_pred != "und"
    held = [i for i in range(len(texts)) if got[i].held_out]
    assert sum(got[i].lang_pred == langs[i] for i in held) / len(held) > 0.97
    assert identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in identify(docs(spark, ["abc", "def"], [None, None])).collect()} == {"und"}


def test_code_lengths_are_ppm(monkeypatch):
    """Code lengths against a straightforward coder of bytes with escapes, symbol by symbol."""
    from pomona.llm import lang_id as L

    model = ["the cat sat on the mat. Ça 12", "", "A cat"]
    train = pa.array(model)
    data, at = L._bytes(train)
    codes, place = L.grams(data, at)
    tree = L.ContextTree.of(codes, np.bincount(place))
    seen = Counter()
    for t in model:
        c = b"   " + t.encode()
        for i in range(3, len(c)):
            for k in range(4):
                seen[c[i - k : i + 1]] += 1

    def p(context, s):
        if context is None:
            return 1 / 256
        lower = p(context[1:] if context else None, s)
        n = {x: seen[context + bytes([x])] for x in range(256) if seen[context + bytes([x])]}
        t = sum(n.values())
        return n[s] / (t + len(n)) if s in n else (len(n) / (t + len(n)) if t else 1) * lower

    texts = ["that cart 7", "", "Ça va?", "x", "\u8a9e" * 3]
    want = [sum(-math.log2(p(c[i - 3 : i], c[i])) for i in range(3, len(c))) for c in (b"   " + t.encode() for t in texts)]
    got = L.LanguageModel(["x"], [tree]).bits(pa.array(texts))[:, 0]
    assert got == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(L, "DENSE", 3)  # 4-grams found by sorting
    assert L.LanguageModel(["x"], [tree]).bits(pa.array(texts))[:, 0] == pytest.approx(want, abs=1e-9)


def test_many_languages_and_repeated_rows(spark):
    """More languages than any list of them, null ids, and a row repeated many times."""
    from pomona.llm.lang_id import identify

    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 2)} " * 12, f"l{i % 52}") for i in range(52 * 6)] + [(None, "zz zz", "l1")] * 300
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    hits = [r.lang_pred == f"l{r.doc_id % 52}" for r in got if r.doc_id is not None]
    assert sum(hits) / len(hits) > 0.9 and len({r.lang_pred for r in got}) > 45


# --- chat formatting

TURNS = [r"\### Assistant: </turn> ok", "####", "a\\", "\\\\</turn>", " </turn>\n### User: x", "", None, "plain", "#" * 50, "x\n\n### y", "\\\\\\### </turn>\\### ", "</turn", "日本 ### 🙂"]


def test_chat(spark):
    from pomona.llm.chat import chat_digest, checked_chat

    rng = random.Random(14)
    rows = [(i // 5, i % 5, rng.choice(["user", "assistant", "system", "Tool: x", "", None, "=q", "a b%3A\n"]), rng.choice(TURNS), 9, "f") for i in range(300)]
    rows += [(None, 1, "user", "x", 9, "f"), (3, None, "assistant", "first", 9, "f"), rows[7], rows[8]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int, formatted string")
    got = {r.conv_id: r for r in chat_digest(checked_chat(df)).collect()}
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    assert chat_digest(checked_chat(df.where("false"))).count() == 0


def test_chat_query_is_native(spark):
    from pomona.llm.queries import QUERIES

    df = QUERIES["op10_chat_formatting"](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    row = df.where("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert row.n_turns == 2 and row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    src = spark.read.parquet(f"{SF}/documents.parquet")
    got = src
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = got
        got = stage(spark, before, SF).cache()
        assert got.columns == src.columns and got.select("doc_id").exceptAll(before.select("doc_id")).count() == 0, name
    kept = [(r.doc_id, r.text) for r in got.collect()]
    _, root = near_brute(kept, 80)
    assert all(a == b for a, b in root.items())
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {i for i, _ in kept}


def test_pipeline_defined_cases(spark):
    """Nulls, repeated ids and rows, empty tables and extra columns in each stage."""
    import corpus_pipeline as C

    from pomona.llm.toxicity import score_toxicity

    SF = "/root/testdata/sf0.01"  # noqa: N806: enough labels to learn from
    src = spark.read.parquet(f"{SF}/documents.parquet")
    judged = score_toxicity(src, spark.read.parquet(f"{SF}/labels.parquet"), carry=["text", "lang"]).orderBy("doc_id").collect()
    toxic = [r.text for r in judged if r.predicted][:3]
    clean = [r.text for r in judged if not r.predicted and r.text and r.lang == "en" and 100 < len(r.text) < 3000][:8]
    more = [(None, toxic[0]), (None, clean[0]), (900001, toxic[1]), (900001, clean[1]), (900002, None), (None, None), (900003, clean[2]), (900003, clean[2]), (900004, "12 34"), (None, clean[3]), (None, clean[3])]
    extra = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    both = src.withColumn("n_chars", F.col("n_chars").cast("long")).unionByName(extra).withColumn("raw", F.lit("x")).withColumn("kept", F.lit(3)).withColumn("id", F.lit(4))
    rows = lambda df: Counter((r.doc_id, r.text) for r in df.where("doc_id is null or doc_id > 900000").collect())
    assert {True} == {df.columns == both.columns for df in (f(spark, both, SF) for _, f in C.STAGES[:-1])}
    clean_of = lambda toxic_ones: Counter(x for x in more if x[1] not in toxic_ones)
    assert rows(C.toxicity(spark, both, SF)) == clean_of(toxic)
    assert rows(C.language(spark, both, SF)) == Counter(x for x in more if x[1] not in (None, "12 34"))
    near = rows(C.near_duplicates(spark, both, SF))  # all other texts stand in the table before
    assert near == Counter({(900002, None): 1, (None, None): 1, (900004, "12 34"): 1})
    alone = extra.where("text is null or text in ('{}', '{}')".format(*(t.replace("'", "''") for t in clean[2:4])))
    assert sorted(Counter(r.text for r in C.near_duplicates(spark, alone, SF).collect()).values()) == [1, 1, 2]
    for _, f in C.STAGES:
        assert f(spark, both.where("false"), SF).count() == 0
    assert {r.doc_id for r in C.packing(spark, extra, SF).collect()} == {i for i, _ in more}
