import base64
import hashlib
import math
import random
import string
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prismframe.llm import common, components, digest, jaccard, langid, lmscore, mixing, packing, preference, topk, toxicity, urlrules
from prismframe.llm.common import held_out


# 1: top-k


def brute_top_k(rows, queries, k):
    out = set()
    for q, x in queries:
        best = sorted((-int(np.dot(x, y)), v) for v, y in rows if v != q)[:k]
        out |= {(q, n + 1, v, -s) for n, (s, v) in enumerate(best)}
    return out


def test_top_k_matches_brute_force_with_ties_and_nulls(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.integers(-3, 4, 10).tolist()) for i in range(300)] + [(i, [1] * 10) for i in range(300, 340)]
    table = spark.createDataFrame([*rows, (1000, None)], "vec_id long, v array<long>").withColumn("score", F.lit("x"))
    queries = [x for x in rows if x[0] % 20 == 0]
    got = topk.top_k(table, table.where("vec_id % 20 = 0"), k=7, block=64, query_block=8)
    assert {tuple(x) for x in got.collect()} == brute_top_k(rows, queries, 7)


def test_top_k_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1, 2]), (1, [3])], "vec_id long, v array<long>")
    assert [tuple(x) for x in topk.top_k(table, table.where("vec_id = 0")).collect()] == [(0, 1, 1, 3)]
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_top_k_of_repeated_rows_and_queries(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (1, [5, 1]), (2, [4, 2]), (2, [4, 2]), (3, [1, 1])]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    for block in (2, 100):
        got = Counter(tuple(x) for x in topk.top_k(table, table.where("vec_id = 0"), k=3, block=block).collect())
        assert got == Counter({(0, 1, 1, 5): 2, (0, 2, 2, 4): 2, (0, 3, 2, 4): 2})


def test_coarse_levels_leave_few_pairs_of_structured_vectors():
    r = np.random.default_rng(3)
    centres = np.repeat(r.integers(-60, 60, (40, 4)), 16, axis=1)  # four flat segments each
    rows = (centres[r.integers(0, 40, 4000)] + r.integers(-2, 3, (4000, 64))).astype(np.int64)
    left: list[int] = []
    got = topk.top_k_block(rows[:50], np.arange(50), rows, np.arange(4000), 10, alive_by_level=left)
    want = brute_top_k(list(enumerate(rows)), list(enumerate(rows[:50])), 10)
    assert {(q, v, s) for q, v, s in got.itertuples(index=False)} == {(q, v, s) for q, _, v, s in want}
    assert left[0] > left[1] >= left[2] >= left[3] and left[2] < 0.2 * left[0]


def test_top_k_is_exact_for_large_numbers():
    big = 2**29
    rows = np.array([[big, 1], [big, 2], [big, 0], [3, 3]], dtype=np.int64)
    got = topk.top_k_block(rows[:1], np.array([9]), rows, np.arange(4), 3)
    assert got["score"].tolist() == [big * big + 2, big * big + 1, big * big] and got["vec_id"].tolist() == [1, 0, 2]
    with pytest.raises(OverflowError):
        topk.top_k_block(rows * 2**10, np.array([9] * 4), rows, np.arange(4), 3)


def test_quantised_leaves_out_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5, -0.01]), (2, None), (3, [nan]), (4, [inf]), (5, [None]), (None, [1.0])]
    got = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    assert [(x["vec_id"], x["v"]) for x in got] == [(1, [32, -1])]


def test_segment_statistics_bound_the_inner_product():
    r = np.random.default_rng(1)
    x, y = r.normal(size=(50, 64)), r.normal(size=(40, 64))
    for s in topk.LEVELS:
        assert (topk.segment_statistics(x, s) @ topk.segment_statistics(y, s).T >= x @ y.T - 1e-9).all()


# 2: toxicity


def test_network_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network(hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = r.normal(size=(5, 4, 3)), np.array([1, 0, 1, 0.0])
    mask = (np.arange(5)[:, None] < np.array([5, 3, 1, 4])).astype(float)

    def loss():
        p = 1 / (1 + np.exp(-net.forward(x, mask)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in net.gradients(x, mask, y).items():
        w = net.w[name]
        for i in list(np.ndindex(*w.shape))[:10]:
            old = w[i]
            w[i] = old + 1e-5
            up = loss()
            w[i] = old - 1e-5
            down = loss()
            w[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-7


def test_gradients_of_learned_vectors():
    r = np.random.default_rng(1)
    words = [b"one", b"two", b"a", b"seventeen"]
    parts = toxicity.Parts.of(words)
    net = toxicity.Network(size=toxicity.INPUTS, hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    odds, word, y = r.normal(size=(4, 3, 3)), r.integers(0, 4, (4, 3)), np.array([1, 0, 1.0])
    mask = (np.arange(4)[:, None] < np.array([4, 2, 3])).astype(float)
    rows = np.vstack([parts.take(np.array([j])).vectors(net.w) for j in range(4)])
    assert np.allclose(rows, parts.vectors(net.w))
    owner, gram = toxicity.grams(words)
    assert np.allclose(rows[3, toxicity.VECTOR :], net.w["eg"][(gram[owner == 3] >> toxicity.TABLE_BITS - toxicity.VECTOR_BITS)].mean(axis=0), atol=1e-6)

    def vectors():  # in full precision
        w, n = net.w, np.bincount(parts.owner)
        means = np.stack([np.bincount(parts.owner, weights=w["eg"][parts.gram, i]) for i in range(toxicity.VECTOR)], axis=1) / n[:, None]
        return np.hstack([w["ew"][parts.word], means])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(np.concatenate([odds, vectors()[word]], axis=2), mask)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    x = np.concatenate([odds, vectors()[word]], axis=2)
    d_x = np.zeros_like(x)
    net.gradients(x, mask, y, d_x)
    d = np.stack([np.bincount(word.ravel(), weights=d_x[:, :, 3 + i].ravel(), minlength=4) for i in range(2 * toxicity.VECTOR)], axis=1)
    for name, g in parts.gradients(d).items():
        w = net.w[name]
        for i in [tuple(j) for j in np.argwhere(g != 0)[:12]]:
            old = w[i]
            w[i] = old + 1e-5
            up = loss()
            w[i] = old - 1e-5
            down = loss()
            w[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-7


def test_a_network_learns_from_word_vectors_alone():
    r = np.random.default_rng(2)
    words = [f"w{i}".encode() for i in range(400)]
    word = r.integers(0, 400, (toxicity.WINDOW, 600))
    word[5, :300] = 7  # about five in nine windows have the word
    label = (word == 7).any(axis=0).astype(np.float32)
    mask = np.ones(word.shape, np.float32)
    net = toxicity.Network(size=toxicity.INPUTS)
    none = np.zeros((*word.shape, 3), np.float32)
    held = np.arange(600) % 3 == 0
    net.train(none[:, ~held], word[:, ~held], toxicity.Parts.of(words), mask[:, ~held], label[~held], epochs=150)
    x = np.concatenate([none, toxicity.Parts.of(words).vectors(net.w)[word]], axis=2)
    assert abs(label.mean() - 0.5) < 0.1  # a guess is right about half of the time
    assert ((net.forward(x[:, held], mask[:, held]) > 0) == (label[held] > 0)).mean() > 0.75


def test_windows_cover_every_word():
    counts = np.array([0, 1, 47, 48, 49, 80, 81, 500])
    owner, start, size = toxicity.windows(counts)
    first = np.cumsum(counts) - counts
    for i, n in enumerate(counts):
        seen = {int(s - first[i]) + j for s, m in zip(start[owner == i], size[owner == i]) for j in range(m)}
        assert seen == set(range(n))
        assert (size[owner == i] > 0).all()


def test_toxicity_learns_and_scores_held_out_rows(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(r.randint(20, 150))]
        toxic = int(i % 5 == 2)
        if toxic:
            words[r.randrange(len(words))] = f"vile{r.choice('xyz')}!"
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x["doc_id"]: x["score"] for x in toxicity.assess(docs, marks).collect()}
    test = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(labels[i][1]) for i in test) >= 0.97 * len(test)


def naive_toxicity(model, text):
    """The score of a text: window by window, step by step, number by number."""
    w, k = {name: x.astype(np.float64) for name, x in model.network.w.items()}, model.network.hidden
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def enters(word):
        b = word.lower().strip(string.punctuation + string.digits).encode()
        marked = b"<" + b + b">" + b"\0" * (2 - len(b))
        codes = [int.from_bytes(marked[i : i + 4], "big") for i in range(len(marked) - 3)]
        slots = [((c ^ c >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - toxicity.TABLE_BITS for c in codes]
        own, less = xxhash.xxh32_intdigest(b) >> 32 - toxicity.TABLE_BITS, toxicity.TABLE_BITS - toxicity.VECTOR_BITS
        odds = [float(model.gram_odds[i]) for i in slots]
        return np.array([float(model.word_odds[own]), max(odds), sum(odds) / len(odds), *w["ew"][own >> less], *np.mean([w["eg"][i >> less] for i in slots], axis=0)])

    def states(d, xs):
        h, out = np.zeros(k), []
        for x in xs:
            a, g = x @ w[f"{d}w"] + w[f"{d}b"], h @ w[f"{d}u"]
            z, r = sigmoid(a[:k] + g[:k]), sigmoid(a[k : 2 * k] + g[k : 2 * k])
            h = (1 - z) * h + z * np.tanh(a[2 * k :] + r * g[2 * k :])
            out.append(h)
        return out

    words, best, at = text.split(), -np.inf, 0
    while words:
        xs = [enters(x) for x in words[at : at + toxicity.WINDOW]]
        both = [np.concatenate(s) for s in zip(states("f", xs), states("b", xs[::-1])[::-1], strict=True)]
        weight = np.exp([float((s @ w["att"])[0]) for s in both])
        pooled = sum(a * s for a, s in zip(weight / weight.sum(), both, strict=True))
        best = max(best, float((pooled @ w["out"])[0] + w["bias"][0]))
        at += toxicity.WINDOW - toxicity.OVERLAP
        if at + toxicity.OVERLAP >= len(words):
            break
    return float(sigmoid(best)) if words else 0.0


def test_scores_are_those_of_a_naive_network():
    r = random.Random(8)
    make = lambda n, toxic: " ".join("".join(r.choice("abcdeé!9") for _ in range(r.randint(1, 6))) for _ in range(n)) + (" vile stuff" if toxic else "")
    texts = [make(r.randint(5, 120), i % 3 == 0) for i in range(60)]
    model = toxicity.fit(texts, np.array([int(i % 3 == 0) for i in range(60)]))
    shown = [make(n, n % 2) for n in (1, 2, 16, 17, 47, 48, 49, 80, 81, 200)] + ["", " ", "!!", "é"]
    assert np.allclose(model.score(shown, toxicity.WordTable()), [naive_toxicity(model, t) for t in shown], atol=1e-4)


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 0), (3, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.assess(odd_docs, labels)
    assert got.columns == [c for c in odd_docs.columns if c != "score"] + ["score"]
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(0 <= x["score"] <= 1 for x in rows)
    assert all(x["score"] == 0 for x in rows if not (x["text"] or "").split())
    assert {x["score"] for x in toxicity.assess(odd_docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.assess(no_docs, labels).count() == 0


# 3: mixing


def brute_targets(sizes, weights, cap=3):
    """The excess of capped sources is shared again by weight until none is above, in fractions."""
    targets, left, open_ = {}, Fraction(sum(sizes.values())), dict(weights)
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > cap * sizes[s]]
        if not over:
            return targets | share
        for s in over:
            targets[s] = Fraction(cap * sizes[s])
            left -= targets[s]
            del open_[s]
    return targets


def test_highest_quotients_matches_brute_force(spark):
    r = random.Random(2)
    rows = [(g, i, r.choice([1, 3, 10, 1000, r.randint(1, 10_000)]), 97 + 300 * g, 400) for g in range(4) for i in range(3 + 9 * g)]
    got = mixing.highest_quotients(spark.createDataFrame(rows, "g long, k long, w long, seats long, most long"), ["g", "k"], ["g"], "w", "seats", "most")
    got = {(x["g"], x["k"]): x["quota"] for x in got.collect()}
    for g in range(4):
        own = [x for x in rows if x[0] == g]
        listed = sorted((Fraction(-w, 2 * n + 1), k) for _, k, w, _, most in own for n in range(most))[: own[0][3]]
        won = Counter(k for _, k in listed)
        assert {k: got[g, k] for _, k, *_ in own} == {k: won[k] for _, k, *_ in own}


@pytest.mark.parametrize("sizes", [[300, 5, 5, 2000, 0, 40, 41], [1], [0, 0], [10_000, 10, 10, 10]])
def test_mix_targets_and_taken(spark, sizes):
    r = random.Random(1)
    rows = []
    for s, total in enumerate(sizes):
        while total:
            n = min(total, r.randint(1, 400))
            rows.append((len(rows), " ".join(["w"] * n), f"s{s}"))
            total -= n
        rows.append((len(rows), "", f"s{s}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block=1, shard_words=500).collect()
    assert len(got) == len(rows)
    names = sorted({x[2] for x in rows})
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want = brute_targets({s: sum(len(x[1].split()) for x in rows if x[2] == s) for s in names}, weights)
    for s in names:
        own = [x for x in got if x["source"] == s]
        assert all(0 <= x["taken"] <= 3 * x["size"] and math.isclose(x["target"], float(want[s]), abs_tol=1e-6) for x in own)
        assert abs(sum(x["taken"] for x in own) - want[s]) <= 2 + 0.01 * want[s]
    assert sorted(got) == sorted(mixing.mix(docs, block=1, shard_words=500).collect())


def test_mix_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(x["size"] == 0 for x in rows if x["doc_id"] in (4, 5, 6))
    assert {x["source_size"] for x in rows if x["source"] is None} == {3}
    assert mixing.mix(no_docs).count() == 0


# 4: urls


def brute_verdict(host, path, rules):
    fits = [(len(h.split(".")), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


def test_rule_trie_matches_brute_force():
    r = random.Random(5)
    hosts = [".".join(r.choice(["a", "b", "c"]) for _ in range(r.randint(1, 4))) for _ in range(40)]
    paths = ["", *["/" + "/".join(r.choice(["x", "xy", "y", ""]) for _ in range(r.randint(0, 4))) for _ in range(60)]]
    rules = list({(h, p): (r.choice(["allow", "block"]), h, p) for h, p in ((r.choice(hosts), r.choice(paths)) for _ in range(60))}.values())
    trie = urlrules.RuleTrie(rules)
    for h in [*hosts, ""]:
        for p in paths:
            assert trie.find(h, p) == brute_verdict(h, p, rules), (h, p)


def test_judge_odd_urls(spark):
    data = [(1, "HTTPS://WWW.Example.COM/en/1?x"), (2, None), (3, "no scheme"), (4, "http://a.net"), (5, "http://a.net/fr/#x"), (None, "x://y://z"), (7, "http://É.com/"), (7, "http://É.com/"), (8, "")]
    got = urlrules.judge(spark.createDataFrame(data, "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(1)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.net", "", None, "allow"), (5, "a.net", "/fr/", "net/fr/", "block"), (None, "y:", "//z", None, "allow"), (7, "É.com", "/", "com/", "allow"), (7, "É.com", "/", "com/", "allow"), (8, "", "", None, "allow")], key=repr)


def test_rules_that_contradict_each_other_are_refused(monkeypatch):
    rule = ("allow", "a.com", "/x")
    assert urlrules.RuleTrie([rule, rule]).find("b.a.com", "/xy") == ("a.com/x", "allow")
    with pytest.raises(ValueError, match="two verdicts"):
        urlrules.RuleTrie([rule, ("block", "a.com", "/x")])
    monkeypatch.setattr(urlrules, "MOST_CHARACTERS", 12)
    with pytest.raises(ValueError, match="characters"):
        urlrules.RuleTrie([rule, ("block", "b.com", "/x")])


def test_judge_long_repeated_and_no_urls(spark):
    rows = [(1, "http://example.com/en/" + "a/" * 200_000), (1, "http://example.com/en/" + "a/" * 200_000), (2, "http://" + "a." * 50_000 + "net/es/"), (3, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("x"))
    got = Counter((x["page_id"], x["rule"], x["verdict"]) for x in urlrules.judge(pages).collect())
    assert got == Counter({(1, "example.com/en/", "block"): 2, (2, "net/es/", "block"): 1, (3, None, "allow"): 1})
    assert urlrules.judge(pages.limit(0)).count() == 0


# 5: language


def test_code_lengths_are_those_of_the_trees():
    """Against escape probabilities worked out symbol by symbol from counts in a dictionary."""
    texts = {"x": [b"abracadabra", b"abc"], "y": [b"bbbb cab"]}
    trees = langid.fit(texts, order=2)
    n = int(trees.symbol.max()) + 1
    for j, lang in enumerate(trees.langs):
        stream = [int(trees.symbol[b]) for b in b"\n\n" + b"\n\n".join(texts[lang])]
        counts = {}
        for k in range(3):
            for i in range(k, len(stream)):
                counts.setdefault(tuple(stream[i - k : i]), Counter())[stream[i]] += 1

        def p(context, s):
            below = (lambda t: 1 / n) if not context else (lambda t: p(context[1:], t))
            own = counts.get(context)
            if not own:
                return below(s)
            total, distinct = sum(own.values()), len(own)
            if s in own:
                return own[s] / (total if distinct == n else total + distinct)
            return distinct / (total + distinct) * below(s) / (1 - sum(below(t) for t in own))

        text = b"abrcab zq"
        told = [int(trees.symbol[b]) for b in b"\n\n" + text]
        want = -sum(math.log2(p(tuple(told[i - 2 : i]), told[i])) for i in range(2, len(told)))
        assert math.isclose(trees.lengths([b"pad", text])[1, j], want, rel_tol=1e-4)
        for context in [(), (told[2],), tuple(told[2:4])]:
            assert math.isclose(sum(p(context, s) for s in range(n)), 1, rel_tol=1e-9)


def test_language_of_held_out_documents(real_docs):
    got = langid.identify(real_docs).where(held_out(F.col("doc_id"), 5, 0)).collect()
    assert len(got) > 20 and all(x["lang"] == x["lang_pred"] for x in got)


def test_language_odd_rows(odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all((x["lang_pred"] == "und") == (x["doc_id"] in (4, 5, 6, 9)) for x in rows)
    assert all(0 <= x["score"] <= 1 for x in rows)
    assert langid.identify(no_docs).count() == 0
    assert {x["lang_pred"] for x in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 6: digests


def test_window_costs_and_sliding_least():
    r = np.random.default_rng(0)
    x = r.integers(97, 105, 400).astype(np.uint8)
    want = [digest._COST[np.bincount(x[i : i + digest.WINDOW])].sum() for i in range(len(x) - digest.WINDOW + 1)]
    assert digest.window_costs(x).tolist() == want
    k = r.integers(0, 50, 300)
    assert digest.sliding_least(k, 7).tolist() == [k[i : i + 7].min() for i in range(294)]


def test_digests_do_not_depend_on_neighbours(real_docs):
    texts = [x["text"].encode() for x in real_docs.limit(60).collect()] + [b"", b"short", b"a" * 500]
    ranks = digest.rarity(digest.entropy_counts(texts))
    alone = [digest.digests([t], ranks)[0] for t in texts]
    big = digest.digests([*texts, b"".join(texts) * 4, *texts], ranks)
    for i, d in enumerate(alone):
        assert np.array_equal(d, big[i]) and np.array_equal(d, big[len(texts) + 1 + i])


def test_digests_are_alike_on_both_sides_of_every_part_of_a_wide_input():
    part, r = (1 << 20) - digest.WINDOW, np.random.default_rng(5)
    rank = r.integers(0, 50, 3 * part + 5000)
    best = digest.sliding_least((rank << 32) | np.arange(len(rank)), digest.WINDOW)
    assert (digest._least_wide(rank) == (best >> 32 << 20) | (best & ((1 << 20) - 1))).all()
    text = " ".join("".join(r.choice(list("etaoinshrdlu"), 5)) for _ in range(400)).encode()
    ranks = digest.rarity(digest.entropy_counts([text]))
    alone = digest.digests([text], ranks)[0]
    for border in (2 * part, 3 * part):
        for shift in range(100, 2300, 500):
            got = digest.digests([text, b"x" * (border - shift - len(text) - 3 * digest.WINDOW), text, text], ranks)
            assert all(np.array_equal(got[i], alone) for i in (0, 2, 3))


def test_fingerprint_follows_descending_doc_id(odd_docs, no_docs):
    import hashlib

    got = digest.fingerprint(odd_docs, chunk=3000).collect()
    rows = sorted(((x["doc_id"], x["text"] or "") for x in odd_docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = Counter()
    for i, (doc_id, text) in enumerate(rows):
        half = len(text) // 2
        want[doc_id, len(text), hashlib.sha256((text[: len(text) - half] + rows[(i + 1) % len(rows)][1][:half]).encode()).hexdigest()] += 1
    assert Counter((x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in got) == want
    assert all(0 <= v <= 1 for x in got for v in (x["near_edited"], x["near_next"]))
    assert len({x["fingerprint"] for x in got if x["doc_id"] in (1, 2)}) == 1
    assert digest.fingerprint(no_docs).count() == 0
    one = digest.fingerprint(odd_docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def naive_features(text, ranks):
    """Hashes of the features of a text, window by window."""
    mask, w = (1 << 64) - 1, digest.WINDOW
    if len(text) < w:
        return [int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")] if text else []
    never, order = 1 << 60, []
    for i in range(len(text) - w + 1):
        counts = Counter(text[i : i + w]).values()
        cost = int(sum(digest._COST[c] for c in counts))
        bits = -sum(c / w * math.log2(c / w) for c in counts)
        order.append(int(ranks[cost >> digest._GRAIN]) if bits >= digest.LEAST_BITS - 1e-6 else never)
    padded = [never] * w + order + [never] * w  # the gaps between texts are no features
    times, last, out = Counter(), [], []
    for a in range(len(padded) - w + 1):
        best = min(range(a, a + w), key=lambda j: (padded[j], j))
        if padded[best] < never:
            times[best - w] += 1
            if not last or last[-1] != best - w:
                last.append(best - w)
    for at in last:
        if times[at] >= digest.POPULAR:
            h = 0
            for j in range(0, w, 8):
                h = ((h ^ int.from_bytes(text[at + j : at + j + 8], "little")) * 0x9E3779B97F4A7C15) & mask
                h ^= h >> 31
            out.append(h)
    return out


def naive_digest(text, ranks):
    found, out = naive_features(text, ranks), []
    for a in range(0, len(found), digest.FILTER_FEATURES):
        out.append({(h >> 11 * i) % digest.FILTER_BITS for h in found[a : a + digest.FILTER_FEATURES] for i in range(digest.HASHES)})
    return out


def naive_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    for x in a:
        share = []
        for y in b:
            most, chance = min(len(x), len(y)), len(x) * len(y) / digest.FILTER_BITS
            chance += digest.CUT * (most - chance)
            share.append((len(x & y) - chance) / max(most - chance, 1e-9))
        total += len(x) * max(0.0, max(share))
    return min(1.0, total / sum(map(len, a)))


def test_fingerprints_are_those_of_a_naive_digest(spark, real_docs):
    texts = [x["text"] or "" for x in real_docs.orderBy("doc_id").limit(40).collect()] + ["", "tiny", "ab" * 300, "é" * 40, "".join(chr(33 + (i * i) % 90) for i in range(9000))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = Counter()
    for t in texts:
        b = t.encode()
        for i in range(len(b) - digest.WINDOW + 1):
            counts[int(sum(digest._COST[c] for c in Counter(b[i : i + digest.WINDOW]).values())) >> digest._GRAIN] += 1
    by_count = sorted(range(digest._KINDS), key=lambda k: (counts[k], k))
    ranks = np.empty(digest._KINDS, np.int64)
    ranks[by_count] = np.arange(digest._KINDS)
    assert np.array_equal(digest.measured_rarity(docs), ranks)
    own = [naive_digest(t.encode(), ranks) for t in texts]
    for x in digest.fingerprint(docs, chunk=20_000).collect():
        i = x["doc_id"]
        changed = naive_digest(digest.edited(texts[i], texts[i - 1]).encode(), ranks)
        for name, want in (("fingerprint", own[i]), ("edited_fingerprint", changed)):
            n, body = x[name].split(":")
            rows = np.unpackbits(np.frombuffer(base64.b64decode(body), np.uint8)).reshape(int(n), digest.FILTER_BITS)
            assert [set(np.nonzero(r)[0].tolist()) for r in rows] == want
        assert math.isclose(x["near_edited"], naive_likeness(own[i], changed), abs_tol=1e-9) and math.isclose(x["near_next"], naive_likeness(own[i], own[i - 1]), abs_tol=1e-9)


def test_null_ids_follow_each_other_in_many_buckets(spark):
    rows = [(None, f"text {i} " * 9) for i in range(300)] + [(i, f"known {i}") for i in range(50)] + [(None, None), (None, "text 1 " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    met = digest.with_neighbour(docs)
    assert met.where("extra = 0").select("bucket").distinct().count() > 20
    got = digest.fingerprint(docs).collect()
    assert Counter((x["doc_id"], x["n_chars"]) for x in got) == Counter((i, len(t or "")) for i, t in rows)
    # each text is followed by one text, in one round: the edited texts take each text's start once
    order = sorted(met.where("extra = 0").collect(), key=lambda x: (x["bucket"], -(x["doc_id"] or 0), x["hash"] or 0, x["text"]))
    want = Counter(hashlib.sha256(digest.edited(x["text"], order[(i + 1) % len(order)]["text"]).encode()).hexdigest() for i, x in enumerate(order))
    assert Counter(x["edited_sha256"] for x in got) == want


def test_likeness_tells_edited_from_other_texts(real_docs):
    got = digest.fingerprint(real_docs).where("n_chars > 300").collect()
    assert np.mean([x["near_edited"] for x in got]) > 0.3 + np.mean([x["near_next"] for x in got])


# 7: language model


def test_attention_gradients_and_forward():
    r = np.random.default_rng(0)
    net = lmscore.Attention(10, 6)
    net.w = {k: v.astype(np.float64) * 2 for k, v in net.w.items()}
    x, y = r.integers(0, 10, (3, 7)), r.integers(0, 6, (3, 7))
    weight = (r.random((3, 7)) < 0.6).astype(float)
    loss, grads = net.gradients(x, y, weight)
    every = np.tile(np.arange(7), (3, 1))
    own = net.log_classes(net.states(x, every, net.tables()), y.ravel())
    assert math.isclose(loss, -(weight.ravel() * own).sum() / weight.sum())
    for name, g in grads.items():
        w = net.w[name]
        for _ in range(6):
            i = tuple(r.integers(0, s) for s in w.shape)
            old = w[i]
            w[i] = old + 1e-5
            up = net.gradients(x, y, weight)[0]
            w[i] = old - 1e-5
            down = net.gradients(x, y, weight)[0]
            w[i] = old
            assert abs((up - down) / 2e-5 - g[i]) < 1e-7
    again = lmscore.Attention(10, 6, seed=9)
    again.set_flat(net.flat())
    assert all(np.allclose(again.w[k], net.w[k]) for k in net.w)


def naive_class_log(net, inputs, wanted):
    """The log probability of a class after some inputs, one position and one number at a time."""
    w, d = net.w, lmscore.WIDTH
    h = [w["e"][i] + w["p"][j] for j, i in enumerate(inputs)]
    q = h[-1] @ w["q"]
    scores = [float(q @ (x @ w["k"])) / math.sqrt(d) for x in h]
    e = [math.exp(s - max(scores)) for s in scores]
    mean = sum(x / sum(e) * (v @ w["v"]) for x, v in zip(e, h))
    y = h[-1] + mean @ w["o"]
    y = y + np.maximum(y @ w["m1"] + w["m1b"], 0) @ w["m2"]
    z = (y @ w["c"] + w["cb"]).tolist()
    return z[wanted] - max(z) - math.log(sum(math.exp(v - max(z)) for v in z))


def naive_step(spelling, topic, before, own):
    """A step of the spelling chain from the listed pairs, order by order."""
    pairs = [(k // (lmscore.END_ID + 1) ** 2, k // (lmscore.END_ID + 1) % (lmscore.END_ID + 1), k % (lmscore.END_ID + 1), c) for k, c in zip(spelling.keys.tolist(), spelling.counts.tolist())]
    p = 1 / (lmscore.END_ID + 1)
    for fits in (lambda t, b: True, lambda t, b: t == topic, lambda t, b: b == before, lambda t, b: t == topic and b == before):
        some = Counter()
        for t, b, o, c in pairs:
            if fits(t, b):
                some[o] += c
        p = (some[own] + (len(some) + 1e-6) * p) / (sum(some.values()) + len(some) + 1e-6)
    return p


def test_scores_are_those_of_a_naive_model(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "STEPS", 60)
    r = random.Random(5)
    words = ["".join(r.choice(["ba", "ne", "tion", "qu", "xo", "é"]) for _ in range(r.randint(1, 4))) for _ in range(40)]
    texts = [" ".join(r.choice(words[: 10 + i % 30]) for _ in range(r.choice([3, 20, 70]))) for i in range(40)] + ["", None, "zebra ba"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = lmscore.score(docs, F.col("doc_id") >= 30).collect()
    model, counts = lmscore.fit(docs.where("doc_id < 30"))
    known = {bytes(x["word"]): x["n"] for x in counts.collect()}
    encode = lmscore.subwords().encode
    for x in rows:
        own = (texts[x["doc_id"]] or "").encode().lower().split()
        coded = [encode(" " + w.decode()) for w in own] + [[lmscore.END_ID]]
        ids = [j for c in coded for j in c]
        before, total, at = [lmscore.END_ID, *ids[:-1]], 0.0, 0
        for w, c in zip([*own, None], coded):
            step = lmscore.WINDOW - lmscore.CONTEXT
            nth = 0 if at < lmscore.WINDOW else -(-(at + 1 - lmscore.WINDOW) // step)
            inputs = [int(model.input_of[j]) for j in before[nth * step : at + 1]]
            k = int(model.class_of[c[0]])
            log_a = naive_class_log(model.net, inputs, k) - model.log_mass[k]
            n = model.ends if w is None else known.get(w, 0)
            spelt = 0.0
            if w is not None:
                spelt = math.exp(model.log_left[k]) * model.spelling.begin_share[c[0]]
                for b, o in zip(c, [*c[1:], lmscore.END_ID]):
                    spelt *= naive_step(model.spelling, int(model.spelling.topic_of[c[0]]), b, o)
            p = math.exp(log_a) * (max(n - lmscore.DISCOUNT, 0) + spelt)
            share = (n + 0.5) / model.room if n or w is None else 0.5 / model.room * spelt / sum(math.exp(x) for x in model.log_left)
            total += math.log10(model.mixture * share + (1 - model.mixture) * p)
            at += len(c)
        assert math.isclose(total, x["score"], rel_tol=2e-4), x


def test_spelling_and_classes_are_probabilities(spark, real_docs, monkeypatch):
    monkeypatch.setattr(lmscore, "STEPS", 20)
    model, counts = lmscore.fit(real_docs.select("doc_id", "text"))
    own = np.arange(lmscore.END_ID + 1)
    for before in (int(model.spelling.keys[0] // len(own) % len(own)), 17):
        assert math.isclose(np.exp(model.spelling.steps(np.zeros_like(own), np.full_like(own, before), own)).sum(), 1, rel_tol=1e-6)
    listed = np.nonzero(model.class_of >= 0)[0]
    share = np.bincount(model.class_of[listed], weights=model.spelling.begin_share[listed], minlength=lmscore.CLASSES)
    assert np.allclose(share[share > 0], 1)
    # discounted counts and what they leave make up the tokens of each class
    table, rows = lmscore.subwords(), [(bytes(x["word"]), x["n"]) for x in counts.collect()]
    first = model.class_of[table.flat[table.first[:-1][table.look_up([w for w, _ in rows])]]]
    kept = np.bincount(first, weights=[n - lmscore.DISCOUNT for _, n in rows], minlength=lmscore.CLASSES)
    kept[model.class_of[lmscore.END_ID]] += model.ends - lmscore.DISCOUNT
    assert np.allclose(kept + np.exp(model.log_left), np.exp(model.log_mass))


def test_the_model_tells_known_words_better_than_their_corpus_shares(real_docs):
    test = held_out(F.col("doc_id"), 5, 1)
    model, counts = lmscore.fit(real_docs.where(~test).select("doc_id", "text"))
    known = {bytes(x["word"]): x["n"] for x in counts.collect()}
    log_a, log_b, _, words = model.score([x["text"].encode() for x in real_docs.where(test & F.col("text").isNotNull()).collect()])
    n = np.array([c for ws in words for c in [*[known.get(w, 0) for w in ws], model.ends]], dtype=float)
    base, own = np.log10((n + 0.5) / model.room), np.log10(model.probability(log_a, log_b, n))
    assert own[n > 3].mean() > base[n > 3].mean() + 0.1
    even = np.log10(model.share(log_b, n))  # the base score's own unseen words have more than the share of all together
    assert np.all(even <= base + 1e-9) and model.mixed(log_a, log_b, n).mean() > even.mean() + 0.1


def test_mixed_probabilities_sum_to_one_at_most(real_docs, monkeypatch):
    monkeypatch.setattr(lmscore, "STEPS", 20)
    model, counts = lmscore.fit(real_docs.select("doc_id", "text"))
    known = {bytes(x["word"]): x["n"] for x in counts.collect()}
    fresh = [f"{a}{b}{c}".encode() for a in "abcdefghij" for b in "klmnopqrst" for c in ("", "a", "ion", "ing")]
    words = [*known, *[w for w in fresh if w not in known]]
    # every word as the first one of a text: the probabilities of one place
    log_a, log_b, _, _ = (x if i == 3 else x[np.cumsum([2] * len(words)) - 2] for i, x in enumerate(model.score(words)))
    end = model.score([None])
    n = np.array([known.get(w, 0) for w in words], dtype=float)
    total = (10 ** model.mixed(log_a, log_b, n)).sum() + (10 ** model.mixed(end[0], end[1], np.array([model.ends]))).sum()
    assert 0.8 < total <= 1 + 1e-4  # the rest is for words that are not asked for


def test_each_id_is_scored_once():
    sizes = np.array([1, 2, 31, 32, 33, 56, 57, 300])
    start, length, first = lmscore.spans(sizes)
    seen = Counter(int(s) + j for s, n, f in zip(start, length, first) for j in range(f, n))
    assert seen == Counter(range(sizes.sum()))


def test_lm_base_scores_match_brute_force(real_docs, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(lmscore, "STEPS", 20)
    for docs in (real_docs, odd_docs):
        rows = docs.select("doc_id", "text").collect()
        words = [(x["doc_id"], [*(x["text"] or "").encode().lower().split(), None]) for x in rows]
        test = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
        c = Counter(w for i, ws in words if not test(i) for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), test(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in words)
        got = lmscore.score(docs, held_out(F.col("doc_id"), 5, 1)).collect()
        assert sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 4)) for x in got) == want
        assert all(math.isfinite(x["score"]) and x["score"] < 0 for x in got)
    assert lmscore.score(no_docs, held_out(F.col("doc_id"), 5, 1)).count() == 0


def test_weights_and_topics_come_from_all_training_documents(real_docs, monkeypatch):
    monkeypatch.setattr(lmscore, "STEPS", 1)
    monkeypatch.setattr(lmscore, "START_DOCS", 5)
    seen, topics = [], lmscore.topic_counts
    monkeypatch.setattr(lmscore, "refined", lambda net, docs, *more: seen.append(docs.count()))
    monkeypatch.setattr(lmscore, "topic_counts", lambda docs, told: seen.append(docs.count()) or topics(docs, told))
    lmscore.fit(real_docs.select("doc_id", "text"))
    assert seen == [real_docs.where("text IS NOT NULL").count()] * 2


def test_each_window_and_id_is_trained_on_once(monkeypatch):
    texts = [b"one two three four " * 30, b"", b"five"]
    own = np.arange(lmscore.END_ID + 1)
    x, _, weight = lmscore.windows_of(texts, own, own % 7, 0)
    assert weight.sum() == sum(len(ids) for ids in lmscore.ids_of(texts))
    seen = []
    monkeypatch.setattr(lmscore.Attention, "gradients", lambda self, x, target, weight: seen.extend(x[:, 0].tolist()) or (0.0, {}))
    lmscore.Attention(1, 1).train_on_all(np.arange(1000)[:, None], np.zeros((1000, 1)), np.zeros((1000, 1)), 0.1, 0)
    assert sorted(seen) == list(range(1000))


def test_gradients_of_groups_are_those_of_all_windows(monkeypatch):
    r = np.random.default_rng(3)
    net = lmscore.Attention(300, 6)
    net.w = {k: v.astype(np.float64) * 2 for k, v in net.w.items()}
    x, y, weight = r.integers(0, 300, (11, 9)), r.integers(0, 6, (11, 9)), (r.random((11, 9)) < 0.4).astype(float)
    weight[[0, 4, 5]] = 0
    loss, grads = net.gradients(x, y, weight)
    monkeypatch.setattr(lmscore, "GROUP", 2)  # one group has no position that counts
    again, some = net.gradients(x, y, weight)
    assert math.isclose(loss, again) and all(np.allclose(grads[k], some[k], atol=1e-12) for k in net.w) and set(some) == set(net.w)
    large = lmscore.Attention(300, 6)  # so large that exponents are kept in range
    large.w = {k: v * (12 if k in "eqk" else 1) for k, v in net.w.items()}
    loss, grads = large.gradients(x, y, weight)
    own = large.log_classes(large.states(x, np.tile(np.arange(9), (11, 1)), large.tables()), y.ravel())
    assert large.tables()["most"] > 80 and math.isclose(loss, -(weight.ravel() * own).sum() / weight.sum())
    assert all(np.isfinite(g).all() for g in grads.values())


def test_words_and_topics_are_counted_in_one_pass(real_docs, odd_docs, monkeypatch):
    monkeypatch.setattr(lmscore, "CACHED_WORDS", 50)  # tables of words are begun anew often
    for docs in (real_docs, odd_docs):
        docs = docs.where("text IS NOT NULL").select("text")
        texts = [x["text"].encode() for x in docs.collect()]
        topics = lmscore.Topics.fit(lmscore.ids_of(texts), k=3)
        by_topic, counts = lmscore.topic_counts(docs, topics)
        assert Counter({bytes(x["word"]): x["n"] for x in counts.collect()}) == Counter(w for t in texts for w in t.lower().split())
        want = np.zeros_like(by_topic)
        for ids in lmscore.ids_of(texts):
            np.add.at(want, (ids, topics.of(ids, np.array([len(ids)]))[0]), 1)
        assert np.array_equal(by_topic, want)


# 8: similarity join


def brute_join(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    first = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        first[r] = min(first.get(r, (True, 0)), (d is None, d or 0))
    return Counter((d, None if first[find(i)][0] else first[find(i)][1], links[i]) for i, (d, _) in enumerate(rows)), len(first)


def test_join_matches_brute_force(spark, odd_docs, no_docs, real_docs):
    r = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(r.choice([8, 40, 150]))]
        for _ in range(25):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows), " ".join(own)))
    passage = " ".join(words[:60])
    rows += [(len(rows) + i, passage + " " + " ".join(r.choice(words) for _ in range(r.randint(5, 60)))) for i in range(60)]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string"), odd_docs, real_docs):
        want, classes = brute_join([(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()])
        got = jaccard.join_documents(docs).collect()
        assert Counter((x["doc_id"], x["class_id"], x["links"]) for x in got) == want
        assert sum(x["kept"] for x in got) == classes
    assert jaccard.join_documents(no_docs).count() == 0


def test_splitting_large_buckets_loses_no_link(spark, monkeypatch):
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"v{r.random()}" if r.random() < 0.012 else w for w in base)) for i in range(150)]
    monkeypatch.setattr(jaccard.buckets, "__defaults__", (jaccard.DEPTH, 20))
    for name in ("BLOCK", "FAMILY_BLOCK"):
        monkeypatch.setattr(jaccard, name, 16)
    want, _ = brute_join(rows)
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = Counter((x["doc_id"], x["class_id"], x["links"]) for x in got)
    assert sum(x["links"] for x in got) >= 0.999 * sum(n * k for (_, _, n), k in want.items()) and sum((have - want).values()) <= 1


def test_near_copies_of_very_long_texts_are_linked(spark):
    n, r = 3_500_000, np.random.default_rng(8)
    words = np.array([f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"], dtype=object)
    text = r.choice(words, n)
    near = text.copy()
    near[::60] = "-"  # about 11 of 12 shingles stay, a similarity of 0.85
    rows = [(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(r.choice(words, 1000)))]
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["class_id"], x["links"]) for x in got} == {(1, 1, 1), (2, 1, 1), (3, 3, 0)}


def test_recall_of_runs_and_rare_words_covers_every_level():
    missed = 1 - (1 - math.exp(-0.8 * jaccard.FAN)) * (1 - math.exp(-0.8 * jaccard.DEEP_FAN)) ** (jaccard.DEPTH - 1)
    assert missed ** jaccard.runs_for(0.999) <= 0.001 < missed ** (jaccard.runs_for(0.999) - 1)


@pytest.mark.parametrize("limit", [0, common.MOST_BITMAP_BYTES])
def test_counted_rows_by_bitmap_and_by_join(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "MOST_BITMAP_BYTES", limit)
    keys = [0, 1, 7, 8, 32_767, 32_768, 32_769, 1 << 33, (5 << 33) + 11]
    rows = spark.createDataFrame([(k, f"r{k}") for k in keys], "k long, text string")
    counts = spark.createDataFrame([(0, 1), (7, 3), (8, 2), (32_768, 1), (1 << 33, 2), (99, 1)], "key long, n int")
    got = {(x["k"], x["_count"]) for x in common.counted(rows, "k", counts, 3).collect()}
    assert got == {(0, 1), (7, 3), (8, 2), (32_768, 1), (1 << 33, 2)}
    assert {x["k"] for x in common.marked(rows, "k", counts.select("key")).collect()} == {k for k, _ in got}
    assert common.marked(rows, "k", counts.select("key").where("key < 0")).count() == 0


def test_skewed_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(60)], "k long, i long")
    table = rows.groupBy(F.col("k").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("key <> 5")
    got = Counter((x["i"], x["n"]) for x in common.join_skewed(rows, table, {"k": "key"}, "n", 60).collect())
    assert got == Counter((x["i"], x["n"]) for x in rows.join(table, F.col("k") == F.col("key")).collect())


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with common.scratch(spark) as keep:
        inner = common.settle(spark.range(5))
        outer = keep(inner)
    assert outer.count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        inner.agg(F.sum("id")).collect()


@pytest.mark.parametrize("chunk", [3, 40, 500_000])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 50)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)] + [(7, 7), (500, 500)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 9: packing


def test_fullest_is_the_largest_reachable_sum():
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randint(1, 40): r.randint(1, 3) for _ in range(r.randint(0, 8))}
        room = r.randint(0, 100)
        reach = {0}
        for x, n in counts.items():
            reach = {a + x * k for a in reach for k in range(n + 1) if a + x * k <= room}
        got = packing.fullest(counts, room)
        assert sum(got) == max(reach) and all(got.count(x) <= counts[x] for x in got)


def test_word_encoder_equals_the_library(real_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [x["text"] for x in real_docs.limit(80).collect()] + ["", "a  b", "  x", "x \n y", "a\n\n b", "tab\tx y", " \x1c y z", "end ", "<|endoftext|> x", "a\u00a0b c", "x\n y", " ", "don't we'll"]
    encode = packing.WordEncoder()
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack_round_trip(odd_docs, no_docs, real_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs, capacity in ((odd_docs, 2048), (real_docs, 300)):
        got = packing.pack(docs, capacity=capacity).collect()
        want = Counter()
        total = 0
        for x in docs.select("doc_id", "text").collect():
            ids = [*library.encode(x["text"] or "", add_special_tokens=False).ids, 0]
            total += len(ids)
            cut = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
            for n, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                want[x["doc_id"], n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        assert Counter(tuple(x)[:5] for x in got) == want
        bins = {}
        for x in got:
            bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) <= 1.02 * total / capacity + 1
    assert packing.pack(no_docs).count() == 0


# 10: preferences


def test_pairs_share_a_prompt_and_mask_the_assistant(spark):
    turn = lambda r, t: (r, t)
    data = [
        (1, [turn("user", "hi"), turn("assistant", "yes")], [turn("user", "hi"), turn("assistant", "no")]),
        (2, [turn("user", "hi")], [turn("user", "hi")]), (3, [], [turn("assistant", "x")]), (4, None, None),
        (5, [turn("a", "1"), turn("assistant", "2"), turn("user", "3"), turn("assistant", "")], [turn("a", "1")]), (5, [turn("user", "é")], [turn("assistant", "é")]),
    ]
    kind = "array<struct<role:string,text:string>>"
    got = preference.format_pairs(spark.createDataFrame(data, f"k long, chosen {kind}, rejected {kind}").withColumn("prompt", F.lit(1)), "k").collect()

    def shown(turns):
        return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)

    want = []
    for k, a, b in data:
        a, b = a or [], b or []
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        want.append((k, n, shown(a[:n]), shown(a[n:]), shown(b[n:])))
        row = next(x for x in got if tuple(x)[:5] == want[-1])
        for turns, text, spans in ((a[n:], row["chosen"], row["chosen_spans"]), (b[n:], row["rejected"], row["rejected_spans"])):
            cut = [text[int(s.split(":")[0]) : int(s.split(":")[1])] for s in spans.split()]
            assert cut == [f"{t}<|end|>" for r, t in turns if r == "assistant"]
    assert len(got) == len(want)


def test_pairs_of_odd_conversations(spark):
    data = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (2, 0, "user", None), (None, 0, None, "x"), (None, 1, "assistant", None), (3, 0, "assistant", "b"), (3, 1, "assistant", "c"), (3, 1, "assistant", "c"), (4, None, "assistant", "d")]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("chosen", F.lit(1))
    got = {x["conv_id"]: x for x in preference.format_pairs(preference.pairs_of(table), "conv_id").collect()}
    assert set(got) == {1, None, 3, 4}
    assert (got[1]["prompt"], got[1]["chosen"], got[1]["rejected"]) == ("<|user|>\nq<|end|>\n", "<|assistant|>\na<|end|>\n", "<|assistant|>\n<|end|>\n")
    assert got[None]["prompt_turns"] == 2 and got[None]["chosen"] == ""
    assert got[3]["rejected"] == "<|assistant|>\nb<|end|>\n"
    assert preference.format_pairs(preference.pairs_of(table.limit(0)), "conv_id").count() == 0


def test_nulls_inside_conversations_and_very_long_ones(spark):
    kind = "array<struct<role:string,text:string>>"
    many = [("assistant" if i % 2 else "user", f"t{i}" * (50_000 if i == 3 else 1)) for i in range(400)]
    data = [(1, [("user", None), None, (None, "x"), ("assistant", None)], [("user", ""), None, ("unknown", "x"), ("assistant", "y")]), (2, many, [*many[:-1], ("assistant", "other")]), (3, [None], [])]
    got = {x["k"]: x for x in preference.format_pairs(spark.createDataFrame(data, f"k long, chosen {kind}, rejected {kind}"), "k").collect()}
    assert got[1]["prompt_turns"] == 3 and got[1]["prompt"] == "<|user|>\n<|end|>\n<|unknown|>\n<|end|>\n<|unknown|>\nx<|end|>\n"
    assert (got[1]["chosen"], got[1]["rejected"]) == ("<|assistant|>\n<|end|>\n", "<|assistant|>\ny<|end|>\n") and got[1]["chosen_spans"] == "14:21"
    assert got[2]["prompt_turns"] == 399 and got[2]["rejected"] == "<|assistant|>\nother<|end|>\n" and len(got[2]["prompt"]) > 100_000
    assert (got[3]["prompt_turns"], got[3]["chosen"], got[3]["rejected"]) == (0, "<|unknown|>\n<|end|>\n", "")
