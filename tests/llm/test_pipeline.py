import zlib
from collections import Counter

import corpus_pipeline
from prismframe.llm import mixing, registry, toxicity

TABLES = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents_and_their_columns(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, TABLES).cache()
        assert after.columns == first.columns and after.dtypes == first.dtypes, name
        assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        assert after.count() >= 0.75 * docs.count(), name
        docs = after
    mixed = corpus_pipeline.mixed(spark, docs, TABLES).cache()
    assert mixed.columns == first.columns
    copies = Counter(x["doc_id"] for x in mixed.select("doc_id").collect())
    assert max(copies.values()) <= 3
    assert Counter(x["doc_id"] for x in corpus_pipeline.mixed(spark, docs, TABLES).select("doc_id").collect()) == copies
    packed = corpus_pipeline.packed(spark, mixed, TABLES).collect()
    assert Counter(x["doc_id"] for x in packed if x["piece"] == 0) == copies


def shingles(text):
    w = text.encode().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def kept_texts(rows):
    """The (doc_id, text) that near duplicates leave, by comparing all pairs; the least doc_id of a class stays."""
    sets, root = [shingles(t or "") for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(find(i), []).append(r)
    return [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]


def test_odd_documents_pass_through_every_stage(spark, odd_docs, no_docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    names = ("doc_id", "text", "lang", "source", "n_chars")
    docs, seen = odd_docs.select(*names), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TABLES).cache()
        seen[name] = [x.asDict() for x in docs.collect()]
    pairs = lambda rows: Counter((x["doc_id"], x["text"]) for x in rows)
    # language: texts with a letter stay, repeated rows and the null id among them
    assert pairs(seen["language"]) == Counter((x["doc_id"], x["text"]) for x in odd_docs.collect() if any(c.isalpha() for c in x["text"] or ""))
    # toxicity: what is under a half of the operator's own score
    before = spark.createDataFrame(seen["language"], odd_docs.select(*names).schema)
    scores = {(x["doc_id"], x["text"]): x["score"] for x in toxicity.assess(before, spark.read.parquet(f"{TABLES}/labels.parquet")).collect()}
    assert pairs(seen["toxicity"]) == Counter({k: n for k, n in pairs(seen["language"]).items() if scores[k] < 0.5})
    # near duplicates: one of each class of all pairs at 0.8 or more
    want = kept_texts([(x["doc_id"], x["text"]) for x in seen["toxicity"]])
    got = pairs(seen["near_duplicates"])
    assert sum(got.values()) == len(want) and Counter(i for i, _ in got.elements()) == Counter(i for i, _ in want)
    # mixing: at most three of each, and as many words as each source's target, but for a block and a document's rounding
    mixed, sources = pairs(seen["mixing"]), {}
    assert set(mixed) <= set(got) and max(mixed.values()) <= 3
    size = lambda t: len(t.encode().split())
    share = {(x["doc_id"], x["size"]): x for x in mixing.mix(spark.createDataFrame(seen["near_duplicates"], odd_docs.select(*names).schema)).collect()}
    for (i, t), n in got.items():
        x = share[i, size(t)]
        assert n == 1 and abs(mixed[i, t] - x["taken"] / max(1, x["size"])) < 1
        own = sources.setdefault(x["source"], [x["target"], 0, 0])
        own[1] += x["taken"]
        own[2] += x["size"]
    assert all(abs(taken - target) <= 16 and taken <= 3 * total for target, taken, total in sources.values())
    # packing: the ids of every copy, in gapless sequences
    library, pieces, bins = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter(), {}
    for (i, t), n in mixed.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        cut = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
            pieces[i, k, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += n
    assert Counter((x["doc_id"], x["piece"], x["length"], x["ids_crc32"]) for x in seen["packing"]) == pieces
    for x in seen["packing"]:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    docs = no_docs.select(*names)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, TABLES)
        assert docs.count() == 0


def test_run_leaves_no_tables_but_its_result(spark):
    import os

    from prismframe.llm.common import shared_dir

    place = shared_dir(spark).removeprefix("file://") + "/settled"
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    out = corpus_pipeline.run(spark, TABLES)
    assert out.count() > 0 and len(set(os.listdir(place)) - before) <= len(corpus_pipeline.STAGES)


def test_rows_that_share_an_id_stay_apart(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(None, text(i)) for i in range(6)] + [(1, text(10)), (2, text(10)), (2, text(11)), (2, text(12)), (2, text(12))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.distinct(spark, docs, TABLES).cache()
    assert Counter((x["doc_id"], x["text"]) for x in out.collect()) == Counter(set(rows) - {(2, text(10))})
    mixed = corpus_pipeline.mixed(spark, out, TABLES).collect()
    assert len(mixed) == out.count() and max(Counter(x["text"] for x in mixed).values()) == 1


def test_registry_has_one_query_for_each_operator():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(registry.oracle_sql()) <= set(names)
