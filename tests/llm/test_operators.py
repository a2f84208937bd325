"""Each operator against a brute-force version, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash

from tesserspark.llm import decontamination, html, licenses, mixing, ngram_lm, quality, sharding, simhash, tokens, toxicity

LONG = " ".join(f"word{k % 97} the of" for k in range(4000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and the cat sat on the mat with the hat of a bat in the house that is big.", "en", "s1"),
    (2, "The quick brown fox jumps over the lazy dog and the cat sat on the mat with the hat of a bat in the house that is big.", "en", "s1"),
    (3, None, "en", "s1"),
    (4, "", None, None),
    (5, " \n\t ", "xx", "s2"),
    (6, LONG, "en", "s2"),
    (7, "ÄÖÜ éÉ İ 漢字 😀 \x1c mixed space", "de", "s3"),
    (7, "ÄÖÜ éÉ İ 漢字 😀 \x1c mixed space", "de", "s3"),
    (None, "a row without an id but with words of its own in it", "en", None),
    (9, "a b c d e f g h i j k l m n o p q r s t\na b c d e f g h i j k l m n o p q r s t", "en", "s3"),
    (10, "one\ntwo\none\n\n\ntwo", "fr", "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or ""), k, "x", k) for k, r in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, key string, n_words int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def space_words(t):
    return (t or "").encode().split() if t else []


def test_quality(docs, none):
    r = quality.quality(docs)
    want = []
    for i, t, *_ in TEXTS:
        w = [x for x in (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        wins = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if wins[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        n = len(w)
        want.append((i, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n))
    assert rows_of(r, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert quality.quality(none).count() == 0
    kept = quality.keep_good(docs, quality.QualityRules(min_words=120))  # one long text is the reference of the short ones here
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {1, 2}


def test_short_junk_goes(spark):
    rng = np.random.default_rng(8)
    common = "the of and to in is it that for on with as was by at this from they are be".split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.45 else "w" + "".join(rng.choice(list("aeinorst"), 6)) for _ in range(n))
    junk = lambda n: " ".join("x" + "".join(rng.choice(list("aeinorst"), 6)) for _ in range(n))
    rows = [(k, prose(int(rng.integers(60, 400))), "en") for k in range(200)] + [(1000 + k, junk(60 + 5 * k), "en") for k in range(10)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[k] for k in range(200)) >= 198 and not any(got[1000 + k] for k in range(10))


def test_quality_distance_matches_numpy(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    got = spark.range(1).select(quality.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def brute_components(fps, ids):
    fps = np.array(fps, np.uint64)
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
                low = min(label[i], label[j])
                changed |= label[i] != low or label[j] != low
                label[i] = label[j] = low
    least = {}
    for k, i in zip(label, ids):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return [least.get(k) for k in label]


def test_simhash(docs, none):
    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t, *_ in TEXTS]
    want = [(i, f"{f:016x}", c) for (i, *_), f, c in zip(TEXTS, fps, brute_components(fps, [x[0] for x in TEXTS]))]
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(none).count() == 0
    assert rows_of(simhash.near_duplicates(docs, hot=1), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)  # every key counts as crowded
    for hot in (simhash.HOT, 1):
        one = simhash.one_of_each(docs, hot=hot)
        assert one.columns == docs.columns and one.count() == len({c for *_, c in want})
    assert simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("hot", [10**6, 3])
def test_trie_join_finds_every_link(spark, hot):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = lambda n: (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    v = np.unique(np.concatenate([base ^ flips(12) ^ flips(12) for _ in range(12)]))
    ids = list(range(len(v)))
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    roots = dict(simhash.components(simhash.links(df, hot)).collect())
    label = [roots.get(int(x), int(x)) for x in v.view(np.int64)]
    first = {}
    for i, k in zip(ids, label):
        first.setdefault(k, i)
    assert [first[k] for k in label] == brute_components(v, ids)


def contamination(texts, items):
    import re

    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) if w]
    out = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for item, u in items:
            v = words(u)
            n = min(13, len(v))
            for k in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        if item is not None:
                            found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, none):
    passage = " ".join(f"p{k}" for k in range(20))
    texts = [(r[0], r[1]) for r in TEXTS] + [(20, "x " + passage.upper() + ". y"), (21, "p3 p4 p5, p6 p7"), (22, passage[:40] + " zz " + passage), (23, "tiny item here " * 9)]
    items = [(2, passage), (10, passage + " tail of it"), (3, "tiny ITEM"), (None, "the quick"), (5, None), (6, "..."), (3, "tiny ITEM"), (11, " ".join(["aa bb"] * 20))]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, mark int")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for small in (decontamination.BROADCAST_ROWS, 0):
        assert rows_of(decontamination.decontaminate(d, b, small=small), *columns) == contamination(texts, items)
    assert decontamination.decontaminate(none, b).count() == 0
    assert not [r for r in decontamination.decontaminate(docs, b.where("false")).collect() if r.contaminated]
    assert decontamination.drop_contaminated(d, b).count() == sum(not x[-1] for x in contamination(texts, items))


def test_decontamination_of_repeated_words(spark):
    """Every place of the document meets every place of the item; the work does not grow with their product."""
    import time

    def seconds(n):
        d = spark.createDataFrame([(1, "same " * n + "other"), (2, "same " * 12)], "doc_id long, text string")
        b = spark.createDataFrame([(1, "same " * (n // 2)), (2, "same " * 13)], "item_id long, text string")
        begun = time.perf_counter()
        got = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.decontaminate(d, b).collect()}
        assert got == {1: (n, 2), 2: (0, 0)}
        return time.perf_counter() - begun

    seconds(100)
    assert seconds(80_000) < 4 * seconds(4_000) + 5


def test_decontamination_runs(spark):
    p = " ".join(f"p{k}" for k in range(15))
    d = spark.createDataFrame([(1, f"a b {p} c {p}"), (2, p)], "doc_id long, text string")
    got = {r.key: [(x["b"], x["e"]) for x in r.runs] for r in decontamination.contaminations(d, spark.createDataFrame([(1, p)], "item_id long, text string")).collect()}
    assert got == {1: [(2, 17), (18, 33)], 2: [(0, 15)]}


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header class="site-header"><a href=/>Logo name</a></header><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div><article><h1>Main &amp; title</h1><p>First <b>bo</b>ld   paragraph of the story goes here, it is long enough.<p>Second one &lt;x&gt; &#233;.</p>
    <div class="ad">Buy this thing now, it is cheap.</div></article><aside><h3>Related</h3><ul><li><a href=c>Other</a></li></ul></aside><section id="comments"><h2>Comments</h2><div class="comment"><p>I think that this is a great story, thank you for it.</p></div></section>
    <form><label>Mail</label><input><p>Sign up for our news.</p></form><footer>&copy; Example 2020</footer><script>var a="<p>no</p>";</script></body></html>"""
    rows = [(1, "u", page, "z"), (2, "u", None, "z"), (3, None, "", "z"), (3, None, "", "z"), (None, "u", "<p>cut off <a hre", "z"), (5, "u", "<div>" * 3000 + "deep text of the page." + "</div>" * 3000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html.extract(df)
    got = {r.page_id: r for r in out.collect()}
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 6
    assert got[1].text == "Main & title First bold paragraph of the story goes here, it is long enough. Second one <x> é."
    assert got[2].text == "" and got[3].n_chars == 0 and html.extract(df.where("false")).count() == 0


def test_html_marginals_equal_enumeration():
    import itertools

    model = html.Model({"tag=p": 0.7, "tag=nav": -1.1, "run=3,0,0": 0.4}, {"block": [[0.2, -0.5], [-0.3, 0.6]], "heading": [[0.3, -0.1], [-0.9, 0.8]], "run": [[0.1, -2.0], [-0.7, 0.5]]}, 0.3)
    nodes, parents = html.walk(html.parse("<nav><p>a b c d</p></nav><h2>i</h2><p>e f g h</p>"))
    own = [sum(model.feature.get(f, 0) for f in html.features(x, nodes[p] if p >= 0 else None, k)) for k, (x, p) in enumerate(zip(nodes, parents))]
    total, ones = 0.0, np.zeros(len(nodes))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = model.prior * y[0] + sum(o for o, v in zip(own, y) if v) + sum(model.edge[html.kind(nodes[k])][y[parents[k]]][y[k]] for k in range(1, len(nodes)))
        total += math.exp(s)
        ones += math.exp(s) * np.array(y)
    assert np.allclose(model.marginals(nodes, parents), ones / total)


def test_licences(spark, docs, none):
    lines = [(1, "intro\nLicensed under the Apache License, Version 2.0.\nend"), (2, "Released under the MIT License."), (3, "He lost his driving license."), (4, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."), (5, None), (5, None)]
    got = rows_of(licenses.scan(spark.createDataFrame(lines, "doc_id long, text string")), "doc_id", "families")
    assert got == sorted([(1, "apache"), (2, "mit"), (3, ""), (4, "cc-by-nc,gpl"), (5, ""), (5, "")], key=repr)
    assert licenses.scan(docs).count() == len(TEXTS) and licenses.scan(none).count() == 0


@pytest.mark.parametrize("head", [0, 3, 10_000])
def test_tokens_equal_the_library(spark, docs, none, head):
    d = docs.select("doc_id", "text").union(spark.createDataFrame([(30, "a<|endoftext|>b  <|endoftext|> "), (31, "I'm we'LL don't \n\n x\n"), (32, "٠௰ Ⅷ ½ ǅ x y")], "doc_id long, text string"))
    tok = tokens._tokenizer(tokens.TOKENIZER)
    n = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    want = [(r.doc_id, len((r.text or "").encode()), n(r.text), n(r.text) > 1024) for r in d.collect()]
    assert rows_of(tokens.count_tokens(d, head=head), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert tokens.count_tokens(none, head=head).count() == 0


def test_toxicity_learns_only_from_its_rows(spark, docs, none):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows, marks = [], []
    for k in range(600):
        bad = int(k % 4 == 0)
        w = [word() for _ in range(30)]
        if bad:
            w[rng.integers(30)] = rng.choice(["vilest", "zounds"])
        rows.append((k, " ".join(w)))
        marks.append((k, bad if zlib.crc32(str(k).encode()) % 4 != 2 else 1 - bad))  # held-out labels are wrong on purpose
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.toxicity(d, spark.createDataFrame(marks, "doc_id long, toxic int")).toPandas()
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in got.doc_id]).all()
    test = got[got.held_out]
    assert ((test.predicted == 1) == (test.doc_id % 4 == 0)).mean() > 0.97 and got.score.between(0, 1).all()
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(TEXTS) and toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("false")).count() == len(TEXTS)


@pytest.mark.parametrize("n", [0, 1, 5, 9000])
def test_elias_fano(n):
    rng = np.random.default_rng(n)
    for top in (10, 2**20, 2**63):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        e = ngram_lm.EliasFano(v)
        assert (e.at(np.arange(len(v))) == v).all() and (e.at(np.arange(0, len(v), 7)) == v[::7]).all()
        q = np.sort(np.concatenate([rng.integers(0, top, 200, dtype=np.uint64), v[:100]]))
        place, equal = e.successor(q)
        assert (place == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()


def test_codes_keep_their_bound():
    v = np.random.default_rng(1).normal(size=5000)
    c = ngram_lm.Codes(v)
    assert np.abs(c.at(np.arange(5000)) - v).max() <= c.error * (1 + 1e-9) and c.error < 1e-4
    assert (ngram_lm.Codes(np.full(3, 0.25)).at(np.arange(3)) == 0.25).all()


@pytest.mark.parametrize("shard_tokens, hot_part", [(4_000_000, 4), (500, 4), (500, 1e9), (4_000_000, 1e-9)])
def test_language_model(docs, none, shard_tokens, hot_part):
    """Against counts in plain Python, with no words, some and all words dealt over shards."""
    data = [(r.doc_id, r.text) for r in docs.collect()]
    words = [[x for x in (t or "").encode().lower().split()] + [b" end"] for _, t in data]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data]
    assert any(held)
    c, pairs = collections.Counter(), collections.Counter()
    for w, h in zip(words, held):
        if not h:
            c.update(w)
            pairs.update(zip([b" start", *w[:-1]], w))
    context = collections.Counter()
    for (a, _), n in pairs.items():
        context[a] += n
    total, v, k = sum(c.values()), len(c), ngram_lm.KAPPA
    base = lambda x: (c[x] + 1) / (total + v + 1)
    p = lambda a, b: (pairs[a, b] + k * base(b)) / (context[a] + k)
    for a in (b" start", b"the", b"never seen"):  # after any context the words and the unknown one have a probability of one together
        assert abs(sum(p(a, b) for b in c) + p(a, b"unknown") - 1) < 1e-12
    want = sorted(((i, h, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10(base(x)) for x in w), sum(math.log10(p(a, b)) for a, b in zip([b" start", *w[:-1]], w))) for (i, _), w, h in zip(data, words, held)), key=repr)
    got = sorted((tuple(r) for r in ngram_lm.score_texts(docs, shard_tokens=shard_tokens, hot_part=hot_part).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-10)
    # logarithms lie between that of k p(unknown) and that of the most frequent pair: half a step of the codes a token
    reach = math.log10(max(pairs.values()) + k) - math.log10(k / (total + v + 1))
    assert all(abs(g[6] - w[6]) <= w[2] * reach / 2 / ngram_lm.Codes.TOP + 1e-9 for g, w in zip(got, want))
    assert ngram_lm.score_texts(none).count() == 0


def test_long_text_and_frequent_pair(spark):
    d = spark.createDataFrame([(1, "a " * 1000 + "b " * 70_000), (2, "a b"), (5, "c")], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.score_texts(d, shard_tokens=1000).collect()}
    assert got[1].n_tokens == 71_001 and got[2].n_tokens == 3
    assert got[2].n_known == 3 and got[2].score > got[2].base_score


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s in TEXTS:
        sizes[s] += len(space_words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        level = (total - sum(capped.values())) / max(1, sum(w for s, w in weight.items() if s not in capped))
        over = [s for s in names if s not in capped and level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        capped |= {s: 3 * sizes[s] for s in over}
    target = {s: capped.get(s, level * weight[s]) for s in names}
    by_id = {(i, t): s for i, t, _, s in TEXTS}
    assert len(got) == len(TEXTS) and all(r.taken <= 3 * r.size for r in got)
    assert sorted(round(r.target, 6) for r in got) == sorted(round(target[s], 6) for s in by_id_values(by_id))
    assert mixing.mix(none).count() == 0
    big = spark.createDataFrame([(k, "w " * (1 + k * 7919 % 300), f"s{k % 5 if k % 3 else 0}") for k in range(3000)], "doc_id long, text string, source string")
    out = mixing.mix(big, cell_rows=100).toPandas().merge(big.select("doc_id", "source").toPandas(), on="doc_id")
    for _, part in out.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) < 0.02 * part.target.iloc[0]
    again = mixing.mix(big.repartition(7), cell_rows=100).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    spread = mixing.mix(big, cell_rows=100, broadcast_rows=0, hot=500).toPandas()  # nothing is broadcast but crowded sources
    assert out.sort_values("doc_id").taken.tolist() == spread.sort_values("doc_id").taken.tolist()
    assert mixing.mixed_documents(big, cell_rows=100, broadcast_rows=0, hot=500).count() == (out.taken // out["size"]).sum()
    repeated = mixing.mixed_documents(big, cell_rows=100)
    assert repeated.columns == big.columns and repeated.count() == (out.taken // out["size"]).sum()


def by_id_values(by_id):
    return [s for _, _, _, s in TEXTS]


def test_schedule_is_longest_first():
    assert sharding.schedule([(7, "a"), (5, "b"), (4, "c"), (3, "d"), (1, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_sharding(spark, docs, none):
    big = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, f"text {k % 400} " * (k % 37 + 1)) for k in range(1500)], "doc_id long, text string"))
    out = sharding.shard(big).toPandas()
    texts = [(r.text or "") for r in big.collect()]
    assert sorted(out["size"]) == sorted(len(t.encode()) + 8 for t in texts) and sorted(out.text_crc32) == sorted(zlib.crc32(t.encode()) for t in texts)
    assert (out.groupby("text_crc32").shard.nunique() == 1).all() and out.shard.between(0, 23).all()
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    small = out[out["size"] < 5000].groupby("shard")["size"].sum()
    assert small.max() < 2 * out["size"].sum() / 24 + out["size"].max()
    assert sharding.shard(none).count() == 0
    carried = sharding.sharded_documents(docs)
    assert carried.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "n_words", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and carried.count() == len(TEXTS)
