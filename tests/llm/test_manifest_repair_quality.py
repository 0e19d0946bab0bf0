import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from prismframe.llm import merkle, oracles, quality, registry, repair

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, sql, tables", [("op11_manifest", oracles.MERKLE, ["documents"]), ("op12_repair", oracles.REPAIR, ["conversations"])])
def test_query_matches_its_sql(spark, name, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    got = registry.queries()[name](spark, TABLES)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


# 11: Merkle manifest


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])])


def tree(nodes):
    """(root, path of each leaf: (siblings on the left, on the right) by level)."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 2, len(nodes))) for i in range(0, len(nodes), 2)]
        for run in runs:
            for j in run:
                for leaf in groups[j]:
                    paths[leaf].append(([nodes[k] for k in run if k < j], [nodes[k] for k in run if k > j]))
        nodes, groups = [sha(*[nodes[j] for j in run]) for run in runs], [[x for j in run for x in groups[j]] for run in runs]
    return nodes[0], paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = {lang: sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for lang in langs}
    subs = {lang: tree([leaf_of(r) for r in own[lang]]) for lang in langs}
    root, above = tree([subs[lang][0] for lang in langs]) if langs else (None, [])
    out = []
    for lang, rest in zip(langs, above, strict=True):
        for r, path in zip(own[lang], subs[lang][1], strict=True):
            node = leaf_of(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0)
            for left, right in path + rest:
                node = sha(*left, node, *right)
            out.append((r["doc_id"], leaf_of(r), subs[lang][0], root, sha(*[x for a, b in path + rest for x in a + b]), node, node == root))
    return out


def manifest_rows(df):
    return sorted(tuple(r) for r in merkle.manifest(df).fillna(-9, ["doc_id"]).collect())


def brute_rows(df):
    return sorted((-9 if x[0] is None else x[0], *x[1:]) for x in brute_manifest([r.asDict() for r in df.collect()]))


def test_manifest_matches_brute_force(real_docs):
    got = manifest_rows(real_docs)
    assert got == brute_rows(real_docs) and 0 < sum(x[-1] for x in got) < len(got)


def test_manifest_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("n_chars", odd_docs["doc_id"] * 3)
    assert manifest_rows(docs) == brute_rows(docs)
    assert all(x[-1] for x in manifest_rows(odd_docs))  # nulls stay, so nothing is tampered with
    assert merkle.manifest(no_docs).collect() == []
    one = odd_docs.where("doc_id = 1")
    row = merkle.manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha()


@pytest.mark.parametrize("n", [2, 3, 63, 64, 65, 129, 1000])
def test_strips_of_every_fill(spark, n):
    rows = [(i, f"t{i}", None if i % 5 == 0 and n < 200 else "en", f"s{i % 3}", i) for i in range(n)] + [(n, "last", "zz", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert manifest_rows(docs) == brute_rows(docs)


def test_many_groups_and_many_equal_rows(spark):
    rows = [(i, "x", f"l{i % 90:02d}", "s", i) for i in range(180)] + [(7, "same", "en", "s", 3)] * 70
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_rows(docs) == brute_rows(docs)


def test_tampering_with_the_largest_long(spark):
    hit = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 0)
    docs = spark.createDataFrame([(hit, "x", "en", "s", 2**63 - 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_rows(docs) == brute_rows(docs)


# 12: conversation repair


def damage(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), sha(x[2])))


def brute_repair(conv, rows):
    rows, faults, seen = damage(conv, rows), [], set()
    for _, role, text in rows:
        shown = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    ways = {"": (0, "", ())}  # by how far the pattern is: "", s, u, a

    def fits(state, letter):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, letter))

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    to = fits(state, role[0])
                    way = (cost + 5, audit + "I", (*lines, role + ":"))
                    if to is not None and (to not in ways or way < ways[to]):
                        ways[to] = way
        return ways

    for (_, role, text), fault in zip(rows, faults, strict=True):
        found = {}
        for state, (cost, audit, lines) in inserted(ways).items():
            steps = [(state, 2, "D", None)]
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                steps += [(fits(state, x[0]), 1 + more, "R", f"{x}:{text}") for x in ("user", "assistant")] + [(fits(state, role[:1]), more, "K", f"{role}:{text}")]
            for to, price, letter, line in steps:
                way = (cost + price, audit + letter, lines if line is None else (*lines, line))
                if to is not None and (to not in found or way < found[to]):
                    found[to] = way
        ways = found
    cost, audit, lines = min(w for s, w in inserted(ways).items() if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def check_repair(spark, rows):
    table = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "'x' as audit", "1 as number", "'y' as signature")
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    got = {r["conv_id"]: tuple(r) for r in repair.repair(table.repartition(3)).collect()}
    assert got == {c: brute_repair(c, x) for c, x in by.items()}
    return got


def test_repair_matches_brute_force(spark):
    r = random.Random(4)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Assistant"], ["Yes.", "no", "", " \t", "A b!", "A b! \n", "why?\x0b", None, "x "]
    rows = [(c, None if r.random() < 0.05 else t, r.choice(roles), r.choice(texts)) for c in range(150) for t in range(r.randint(1, 9))]
    got = check_repair(spark, rows)
    assert {letter for x in got.values() for letter in x[7]} == set("DKR")  # an inserted turn costs more than rerole or delete


def test_repair_of_nulls_ties_and_repeated_rows(spark):
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yo."), (5, None, "user", "a."), (5, None, "user", "a."), (5, 3, "assistant", "b."), (6, None, None, None), (8, 2, "user", "z."), (8, 2, "assistant", "y."), (8, 2, "user", "x.")]
    check_repair(spark, rows)


def test_a_conversation_that_is_dropped_whole_stays_with_zeros(spark):
    conv, turn = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = check_repair(spark, [(conv, turn, "user", "Hello.")])
    assert got[conv] == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(spark.createDataFrame([], CONVERSATIONS)).collect() == []


@pytest.mark.parametrize("segment", [1, 3, 128])
def test_segments_chain_to_the_best_of_a_long_conversation(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    r = random.Random(segment)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), f"{r.randrange(40)}" + r.choice([".", "", "!"])) for t in range(400)] + [(2, t, "ua"[t % 2], "x" * 100_000 + f"{t}.") for t in range(6)]
    check_repair(spark, rows)


def test_solutions_by_state_are_the_best_ones():
    r = random.Random(2)
    for _ in range(60):
        signature = "".join(r.choice("suao") + r.choice(".tx") for _ in range(r.randint(0, 5)))
        whole = repair.solve(signature)
        n = 2 * r.randint(0, len(signature) // 2)
        first, second = repair.solve(signature[:n]), repair.solve(signature[n:])
        for s, e in whole:
            assert whole[s, e] == min((first[s, m][0] + second[m, e][0], first[s, m][1] + second[m, e][1]) for m in range(4) if (s, m) in first and (m, e) in second)


# 13: quality


def naive_counts(text):
    letter = lambda c: c.isalpha()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    mark = lambda c: not c.isalpha() and not c.isdigit()
    return [
        len(text), sum(map(letter, text)), sum(c.isupper() for c in text), sum(c.isdigit() for c in text), sum(mark(c) and c not in " \t\n\v\f\r" for c in text), text.count("\n"), len(words), sum(1 <= sum(map(letter, w)) <= 3 for w in words),
        sum(not any(map(letter, w)) for w in words), sum(len(w) > 1 and mark(w[-1]) and mark(w[-2]) for w in words), sum(len(w) > 1 and sum(map(letter, w)) > 1 and all(c.isupper() for c in w if c.isalpha()) for w in words),
        sum(a == b for a, b in zip(words, words[1:])), len(set(words)),
    ]


def test_statistics_match_naive_counts(real_docs):
    texts = [r["text"] for r in real_docs.select("text").collect()] + ["", "  ", "a", "A!! A!! b", "a a\na\ta"]
    assert quality.statistics(texts).tolist() == [naive_counts(t) for t in texts]
    assert quality.statistics([None]).tolist() == [naive_counts("")]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcXY!?1") for _ in range(r.randint(1, 5))) for _ in range(3000))
    monkeypatch.setattr(quality, "PIECE", 500)
    got, want = quality.statistics(["x y", text, "z"]), [naive_counts(t) for t in ("x y", text, "z")]
    echoes = quality.COUNTS.index("echoes")
    for a, b in zip(got.tolist(), want, strict=True):
        assert a[:echoes] + a[echoes + 1 :] == b[:echoes] + b[echoes + 1 :] and b[echoes] - 30 <= a[echoes] <= b[echoes]
    assert ["".join(quality.pieces(t, 10)) for t in ("", text, "x" * 35)] == ["", text, "x" * 35]
    assert quality.statistics(["y" * 1200])[0][6] == 3  # no white space to cut at


def test_discriminant_is_the_ratio_of_two_normal_densities():
    r = np.random.default_rng(5)
    x, label = r.normal(size=(400, 4)) @ r.normal(size=(4, 4)), r.integers(0, 2, 400)
    x[label == 1] = x[label == 1] * 0.5 + 1
    own = [x[label == k] for k in (0, 1)]
    model = quality.fit(np.array([len(o) for o in own], float), np.stack([o.sum(axis=0) for o in own]), np.stack([o.T @ o for o in own]), shrink=0.2)
    covariance = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(len(o) / 400 * np.diag(c) for o, c in zip(own, covariance, strict=True))
    density = []
    for o, c in zip(own, covariance, strict=True):
        c, d = 0.8 * c + 0.2 * np.diag(pooled), x - o.mean(axis=0)
        density.append(len(o) / 400 * np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d)) / np.sqrt(np.linalg.det(c)))
    assert np.allclose(model.score(x), density[1] / (density[0] + density[1]))


def test_learned_sums_are_those_of_all_labelled_rows(spark, real_docs):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    points = real_docs.select("doc_id", quality.point("text").alias("point"))
    model = quality.learned(points, labels)
    by = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = [(by[r["doc_id"]], r["point"]) for r in points.collect() if r["doc_id"] in by]
    own = [np.array([p for k, p in rows if k == c]) - quality.CENTRE for c in (0, 1)]
    want = quality.fit(np.array([len(o) for o in own], float), np.stack([o.sum(axis=0) for o in own]), np.stack([o.T @ o for o in own]))
    for a, b in ((model.means, want.means), (model.factors, want.factors), (model.weights, want.weights)):
        assert np.allclose(a, b)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    found = [(label[r["doc_id"]], r["score"]) for r in quality.assess(docs, labels).collect() if r["doc_id"] in label and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, poor = [s for k, s in found if k == 1], [s for k, s in found if k == 0]
    assert len(poor) > 5 and np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in poor]) > 0.85


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 15)] + [(None, 1, 0), (3, 7, 0), (99, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = [(r["doc_id"], r["score"]) for r in quality.assess(odd_docs, labels).collect()]
    assert len(got) == odd_docs.count() and all(0 <= s <= 1 for _, s in got)
    assert len({s for i, s in got if i == 12}) == 1 and {s for i, s in got if i == 4} == {s for i, s in got if i == 5}
    assert quality.assess(no_docs, labels).collect() == []
    assert {r["score"] for r in quality.assess(odd_docs, labels.where("quality = 1")).collect()} == {0.5}
