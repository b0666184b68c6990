"""Near copies, sharding, mixing, classifiers and the pipeline against brute force, and their defined results."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tideweave.llm import common, decontaminate, embedding_dedup, jaccard, mixing, quality, sharding, toxicity
from tideweave.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string"


def union(n, pairs):
    up = list(range(n))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(k) for k in range(n)]


def ngram_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_components(spark):
    r = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(300, 380)]
    want = union(400, pairs)
    got = components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()
    assert all(want[x["node"]] == x["component"] for x in got)
    assert {x["node"] for x in got} == {k for p in pairs if p[0] != p[1] for k in p}


@pytest.mark.parametrize("n,percent,few", [(4, 85, 100_000), (5, 80, 2)])
def test_jaccard_equals_brute_force(spark, monkeypatch, n, percent, few):
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    r = np.random.default_rng(n)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = list(r.choice(vocabulary, size=int(r.integers(5, 90))))
        for _ in range(9):
            copy = list(base)
            for _ in range(int(r.integers(0, 4))):
                copy[int(r.integers(len(copy)))] = str(r.choice(vocabulary))
            texts.append(" ".join(copy[: len(copy) - int(r.integers(0, 3))]))
    shared = " ".join(r.choice(vocabulary, size=40))
    texts += [f"{' '.join(r.choice(vocabulary, size=20))} {shared}" for _ in range(15)] + [None, "", " \n", "one", "ONE", "a b", "a  b", "a b", "long " * 4000]
    sets = [ngram_set(t, n) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = union(len(texts), linked)
    docs = spark.createDataFrame([(k, t, "x", "s", 1, "clash") for k, t in enumerate(texts)], DOCS).repartition(3)
    got = jaccard.jaccard_groups(docs, n=n, percent=percent).collect()
    assert len(got) == len(texts)
    for row in got:
        assert row["n_shingles"] == len(sets[row["doc_id"]]) and row["component_id"] == want[row["doc_id"]]


def test_jaccard_pairs_lose_no_link(spark):
    r = np.random.default_rng(8)
    base = [list(r.choice(["a", "b", "c", "d", "e", "f", "g"], size=60)) for _ in range(6)]
    texts = [" ".join(b[: 60 - int(r.integers(0, 12))]) for b in base for _ in range(8)] + ["x y z", "x y z", None, ""]
    docs = spark.createDataFrame([(k, t, "", "", 1, "") for k, t in enumerate(texts)], DOCS).repartition(3)
    classes, pairs = jaccard.jaccard_pairs(docs, n=4, percent=85)
    rep = {x["doc_id"]: x["rep"] for x in classes.collect()}
    sets = [ngram_set(t, 4) for t in texts]
    assert all(rep[k] == min(j for j in range(len(texts)) if sets[j] == sets[k]) for k in rep) and len(rep) == len(texts) - 2
    want = {(i, j, len(sets[i] & sets[j])) for j in set(rep.values()) for i in set(rep.values()) if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert {(x["a"], x["b"], x["shared"]) for x in pairs.collect()} == want and len(want) > 50


def test_jaccard_fragments_are_cut_in_the_global_order():
    counters = np.zeros(jaccard.COUNTERS, np.uint32)
    counters[[5, 9, 11]] = [7, 1, 3]
    rank, cuts = jaccard.global_order(counters)
    assert rank[9] < rank[11] < rank[5] == jaccard.COUNTERS - 1 and sorted(rank.tolist()) == list(range(jaccard.COUNTERS))
    assert len(cuts) == jaccard.FRAGMENTS - 1 and (np.diff(cuts) >= 0).all()
    grams = jaccard.ngrams("to be or not to be that is the question", 2)
    parts = jaccard.segments_of(grams, rank, cuts)
    held = np.concatenate([s for _, s in parts])
    assert sorted(held) == sorted(grams) and [f for f, _ in parts] == sorted({f for f, _ in parts})
    of = lambda g: np.searchsorted(cuts, rank[g % np.uint64(jaccard.COUNTERS)], side="right")
    assert all((of(s) == f).all() for f, s in parts)


def test_one_of_each_is_the_same_row_again(spark):
    rows = [(3, "a b c d e f g", "x", "s", 1, ""), (3, "quite another text of six words", "x", "s", 2, ""), (4, "a b c d e f g", "x", "s", 3, "")]
    first = {tuple(x) for x in jaccard.one_of_each(spark.createDataFrame(rows, DOCS)).collect()}
    again = {tuple(x) for x in jaccard.one_of_each(spark.createDataFrame(rows[::-1], DOCS).repartition(3)).collect()}
    assert first == again and len(first) == 1


def test_jaccard_defined_results(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", None, None, 1, ""), (5, "a b c d e f", None, None, 1, ""), (7, "A b c d e f", None, None, 1, ""), (None, "a b c d e f", None, None, 1, "")], DOCS)
    got = sorted((str(r[0]), str(r[2])) for r in jaccard.jaccard_groups(docs).collect())
    assert got == [("5", "5"), ("5", "5"), ("7", "5"), ("None", "None")]
    kept = jaccard.one_of_each(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["5", "None"]
    assert jaccard.jaccard_groups(docs.limit(0)).count() == 0


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", 7)
    monkeypatch.setattr(embedding_dedup, "PIVOTS", 6)
    r = np.random.default_rng(1)
    rows, vectors, labels = [], [], []
    for k in range(160):
        v = r.normal(size=8) if k % 4 == 0 else vectors[-1] + r.normal(size=8) * 0.09 if k % 9 else vectors[-1]
        vectors.append(v)
        labels.append([0, 1, None][k % 40 // 20 if k < 150 else 2])
    odd = [None, [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] * 8, [1.0]]
    rows = [(k, [float(x) for x in v], labels[k], "x") for k, v in enumerate(vectors)] + [(200 + k, v, 0, "x") for k, v in enumerate(odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component string").repartition(3)
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(frame).collect()}
    cos = lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b))
    links = [(i, j) for i in range(160) for j in range(160) if i != j and labels[i] == labels[j] is not None and cos(vectors[i], vectors[j]) >= 0.98]
    count, want = Counter(i for i, _ in links), union(160, links)
    assert len(links) > 50
    for k in range(160):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (count[k], want[k], want[k] == k)
    assert all((got[200 + k]["n_links"], got[200 + k]["component_id"]) == (0, 200 + k) for k in range(len(odd)))
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_embedding_cells_bound_replication_and_hold_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART", 150)
    r = np.random.default_rng(5)
    middle = r.normal(size=(40, 64))
    v = np.concatenate([c + r.normal(size=(30, 64)) * w for c, w in zip(middle, np.linspace(0.02, 0.5, 40))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(k, 1, [float(x) for x in v[k]], "a|b/1" if k % 2 else "c", 64) for k in range(len(v))]
    classes = spark.createDataFrame(rows, "rep long, copies long, v array<double>, label string, dim int").repartition(3)
    radius = math.sqrt(2 - 2 * 0.98)
    placed = embedding_dedup.cells(classes, radius).collect()
    assert len(placed) <= 8 * len(v) and len({x["cell"] for x in placed}) > 4
    by = {}
    for x in placed:
        by.setdefault(x["cell"], []).append((x["rep"], x["guest"]))
    met = Counter(frozenset((a, b)) for held in by.values() for i, (a, g) in enumerate(held) for b, h in held[:i] if not g & h)
    links = {frozenset((i, j)) for i in range(len(v)) for j in range(i) if i % 2 == j % 2 and v[i] @ v[j] >= 0.98}
    assert len(links) > 500 and all(met[p] == 1 for p in links) and max(met.values()) == 1


def test_given_embeddings_meet_through_pivots(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("label IS NOT NULL").selectExpr(
        "vec_id AS rep", "1L AS copies", "transform(embedding, x -> double(x)) AS v", "string(label) AS label", "size(embedding) AS dim"
    )
    radius = math.sqrt(2 - 2 * 0.98)
    placed = embedding_dedup.cells(frame.filter("forall(v, x -> x IS NOT NULL AND NOT isnan(x)) AND exists(v, x -> x <> 0)"), radius).toPandas()
    homes = placed[placed["guest"] == 0].groupby("cell").size()
    guests = placed[placed["guest"] != 0].groupby("cell").size().reindex(homes.index, fill_value=0)
    labels = homes.groupby(homes.index.str.rsplit("/", n=1).str[0]).sum()
    compared, all_pairs = (homes * (homes - 1) / 2 + homes * guests).sum(), (labels * (labels - 1) / 2).sum()
    assert homes.sum() == placed["rep"].nunique() and len(homes) >= 5 * len(labels) and compared < 0.85 * all_pairs


def test_vectors_of_one_cell_meet_once():
    r = np.random.default_rng(8)
    v = embedding_dedup.unit(r.normal(size=(30, 5))[np.arange(400) % 30] + r.normal(size=(400, 5)) * 0.05)
    rep, copies, guest, block = np.arange(400), r.integers(1, 4, 400), r.choice([0, 0, 1, 2, 3], 400).astype(np.int32), r.integers(0, 2, 400)
    for across in (False, True):
        count, a, b = embedding_dedup.cell_links(v, rep, copies, guest, block, across, 0.98)
        hit = (v @ v.T >= 0.98) & ((guest[:, None] & guest) == 0) & ~np.eye(400, dtype=bool)
        hit &= (block[:, None] != block) if across else True
        assert (count == hit @ copies).all() and hit.any()
        links, got = union(400, list(zip(*np.nonzero(hit)))), union(400, list(zip(a.tolist(), b.tolist())))
        assert links == got


@pytest.mark.parametrize("limit,level_bits,bits", [(300, 12, 60), (300, 2, 60), (40, 3, 60), (300, 2, 4)])
def test_sharding_splits_only_what_is_too_large(spark, limit, level_bits, bits):
    r = np.random.default_rng(2)
    rows = [(k, "x" * int(n)) for k, n in enumerate(r.integers(0, 60, 120))] + [(500, "y" * 50)] * 9 + [(None, None), (501, "z" * 400)]
    docs = spark.createDataFrame([(i, t, "", "", 1, "clash") for i, t in rows], DOCS)
    got = sharding.shard(docs, limit, bits=bits, level_bits=level_bits).collect()
    assert Counter(str(x["doc_id"]) for x in got) == Counter(str(i) for i, _ in rows)
    pages, buckets, members = Counter(), {}, Counter()
    for x in got:
        pages[x["shard"]] += x["n_bytes"]
        members[x["shard"]] += 1
        buckets.setdefault(x["bucket"], x["page"])
    assert all(n <= limit or members[s] == 1 for s, n in pages.items())
    total = Counter()
    for x in got:
        for d in range(len(x["bucket"]) + 1):
            total[x["bucket"][:d]] += x["n_bytes"]
    for b in buckets:  # every ancestor was too large; no bucket is inside another
        assert all(total[b[:d]] > limit for d in range(len(b)))
    assert sharding.shard(docs.limit(0), limit).count() == 0


@pytest.mark.parametrize("part", [common.BROADCAST_ROWS, 10])
def test_sharding_over_several_levels_equals_plain_python(spark, monkeypatch, part):
    monkeypatch.setattr(common, "BROADCAST_ROWS", part)
    monkeypatch.setattr(sharding, "DEALT", 6)
    rows = [(k, "x" * (k % 50)) for k in range(4000)] + [(9999, "y" * 30)] * 60 + [(9999, "z" * 100)] * 5 + [(9999, "")] * 25
    docs = spark.createDataFrame([(i, t, "", "", 1, "") for i, t in rows], DOCS).repartition(4)
    limit, got = 160, sharding.shard(docs, 160, level_bits=4).collect()
    h = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    total = Counter()
    for i, t in rows:
        for d in range(61):
            total[d, h(i) >> (60 - d)] += len(t)
    want = {i: next((d for d in range(61) if total[d, h(i) >> (60 - d)] <= limit), 60) for i, _ in rows}
    assert len({want[i] for i, _ in rows}) > 5 and max(want[k] for k in range(4000)) > 12
    assert all(x["depth"] == want[x["doc_id"]] for x in got)
    assert Counter((x["doc_id"], x["n_bytes"]) for x in got) == Counter((i, len(t)) for i, t in rows)
    pages = Counter()
    for x in got:
        pages[x["shard"]] += x["n_bytes"]
    assert max(pages.values()) <= limit


@pytest.mark.parametrize("shard_slots", [mixing.SHARD_SLOTS, 20])
def test_mixing_meets_targets(spark, shard_slots):
    r = np.random.default_rng(3)
    rows = []
    for k in range(400):
        source = None if k % 29 == 0 else "small" if k % 40 == 1 else "big" if k % 3 else "mid"
        rows.append((k, " ".join(["w"] * int(r.integers(0, 300))) + " \n", "", source, 1, ""))
    rows += [(1000, None, "", "big", 0, ""), (1001, "", "", "void", 0, ""), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    placed, plan = mixing.lay_out(docs, shard_slots=shard_slots)
    blocks = [x.asDict() for x in mixing.mix(placed, plan).collect()]
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += len((row[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))  # a source without words has a place in the order, and its weight
    assert "void" in order and plan.targets[order.index("void")] == 0
    assert plan.names == order and plan.sizes == [sizes[s] for s in order]
    assert abs(sum(plan.targets) - sum(sizes.values())) < 1e-6
    taken = Counter()
    for b in blocks:
        taken[b["source_no"]] += (b["high"] - b["low"]) * len(b["passes"])
        assert len(set(b["passes"])) == len(b["passes"]) <= 3
    for k, t in enumerate(plan.targets):
        assert t <= 3 * plan.sizes[k] + 1e-6 and abs(taken[k] - t) <= 0.02 * t + 2 * mixing.BLOCK
    assert (plan.draws.sum(axis=0) == plan.slots).all() and len(plan.draws) == -(-plan.slots.sum() // shard_slots)
    assert (plan.draws[:-1].sum(axis=1) == shard_slots).all()
    again, _ = mixing.lay_out(docs.repartition(5), shard_slots=shard_slots)
    key = lambda b: (b["source_no"], b["block"], b["low"], b["high"])
    assert sorted(map(key, blocks)) == sorted(key(x.asDict()) for x in mixing.mix(again, plan).collect())
    empty, none = mixing.lay_out(docs.limit(0))
    assert mixing.mix(empty, none).count() == 0


def test_mixing_gives_tied_rows_their_own_words(spark, tmp_path):
    words = lambda k, n: " ".join(f"d{k}w{j}" for j in range(n))
    rows = [(k, words(k, 90), "en", "ab"[k % 2], 1, "") for k in range(20)]
    rows += [rows[0]] * 3 + [rows[1]] * 2 + [(None, words(k, 100), "en", "a", 1, "") for k in range(50, 54)] + [(7, None, "en", "b", 0, "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    placed, plan = mixing.lay_out(docs)
    for k, size in enumerate(plan.sizes):  # the documents cover each source's words without gaps and overlaps
        spans = sorted((x["begin"], x["begin"] + x["size"]) for x in placed.collect() if x["source_no"] == k and x["size"])
        assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == size
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = mixing.op8_mix(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(0 <= x["taken"] <= 3 * x["size"] for x in out)
    blocks = mixing.mix(placed, plan).collect()
    assert sum(x["taken"] for x in out) == sum((x["high"] - x["low"]) * len(x["passes"]) for x in blocks)
    got = Counter(w for x in mixing.mixed_documents(docs).collect() for w in x["text"].split())
    held = Counter(w for r in rows for w in (r[1] or "").split())
    assert all(n <= 3 * held[w] for w, n in got.items())


def test_draws_are_those_of_a_multinomial_given_its_totals():
    slots = np.array([3_000, 0, 6_000, 1_000])
    draws = np.array([d for _, d, _ in mixing.shard_draws(slots, list(range(100)), 100)])
    share = slots / slots.sum()
    assert (draws.sum(axis=0) == slots).all() and (draws.sum(axis=1) == 100).all()
    # a hypergeometric count's variance, within what 100 shards show
    assert np.allclose(draws.var(axis=0), 100 * share * (1 - share), rtol=0.5)
    some = {s: (d.tolist(), b.tolist()) for s, d, b in mixing.shard_draws(slots, [7, 50, 99], 100)}
    assert some[50] == (draws[50].tolist(), draws[:50].sum(axis=0).tolist()) and list(some) == [7, 50, 99]
    huge = np.array([5 * 10**12, 10**12])  # hundreds of TB: no table, no limit of the generator
    (_, draw, before), = mixing.shard_draws(huge, [40_000_000], 1 << 16)
    assert draw.sum() == 1 << 16 and before.sum() == 40_000_000 << 16 and abs(draw[0] / draw.sum() - 5 / 6) < 0.02


def test_mix_of_many_equal_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "DEALT", 7)
    monkeypatch.setattr(mixing, "STREAM_ROWS", 5)
    rows = [(1, "a b c d e", "en", "x", 9, "")] * 40 + [(None, "f g h", "en", "x", 5, "")] * 30 + [(k, "t " * k, "en", "y", 1, "") for k in range(60)] + [(5, "q r s", "", None, 5, "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = mixing.op8_mix(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(0 <= x["taken"] <= 3 * x["size"] for x in out)
    size = {"x": 290, "y": sum(range(60)), None: 3}
    aim = mixing.targets(list(size.items()))
    assert {(x["source_size"], round(x["target"], 6)) for x in out} == {(size[s], round(aim[s], 6)) for s in size}
    taken = Counter()
    for x in out:
        taken[x["source_size"]] += x["taken"]
    assert all(abs(taken[size[s]] - aim[s]) <= 2 * mixing.BLOCK for s in size)
    words = Counter(w for x in mixing.mixed_documents(docs).collect() for w in x["text"].split())
    assert abs(sum(words.values()) - sum(aim.values())) <= 6 * mixing.BLOCK and all(words[w] <= 3 * 40 for w in "abcde")


def test_targets_share_the_excess_by_weight():
    got = mixing.targets([("b", 10), ("a", 1000), (None, 500)])
    assert got["b"] == 30 and abs(got["a"] / 1 - got[None] / 3) < 1e-9 and abs(sum(got.values()) - 1510) < 1e-9


def test_permutations_are_permutations():
    for size in (1, 2, 3, 10, 257, 1000):
        assert sorted(mixing.permuted(np.arange(size), size, 5)) == list(range(size))


def test_mixed_documents_hold_the_taken_words(spark):
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(150)), "en", "ab"[k % 2], 0, "") for k in range(12)]
    docs = spark.createDataFrame(rows, DOCS)
    placed, plan = mixing.lay_out(docs)
    want = sum((x["high"] - x["low"]) * len(x["passes"]) for x in mixing.mix(placed, plan).collect())
    out = mixing.mixed_documents(docs).collect()
    assert sum(len(x["text"].split()) for x in out) == want and out[0].asDict().keys() == set(docs.columns)
    assert all(set(x["text"].split()) <= set(rows[x["doc_id"]][1].split()) and x["n_chars"] == len(x["text"]) for x in out)
    assert mixing.words_between(" a  b\nc d ", [(0, 1), (1, 2), (3, 4)]) == "a  b d"


CLEAN = ["river", "stone", "garden", "window", "paper", "summer", "letter", "market", "silver", "number", "forest", "copper"]
BAD = ["vilewort", "grubnose", "mudsnark"]


def _labelled(seed, count, kind):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(count):
        words, bad = list(r.choice(CLEAN, size=int(r.integers(3, 60)))), k % 3 == 0
        if kind == "toxic" and bad:
            w = str(r.choice(BAD))
            form = [w, w[:3] + "." + w[3:], " ".join(w), w[:4] + "x" + w[4:], w + "s"][int(r.integers(5))]
            words.insert(int(r.integers(len(words))), form)
        if kind == "quality" and not bad:
            words = [w.upper() + "!!" if r.random() < 0.7 else w + "***" for w in words]
        rows.append((k, " ".join(words), int(bad)))
    return rows


def _run_classifier(spark, kind, module, parts, held):
    rows = _labelled(9, 500, kind)
    docs = spark.createDataFrame([(k, t, "", "", 1, "clash") for k, t, _ in rows] + [(900, None, "", "", 1, ""), (901, "", "", "", 1, ""), (902, "river " * 20_000, "", "", 1, ""), (None, "x", "", "", 1, "")], DOCS)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(0, None), (None, 1)], f"doc_id long, {kind} int")
    model = module.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    assert len(got) == 504 and all(0 <= s <= 1 for s in got.values())
    test = [(got[k], y) for k, _, y in rows if zlib.crc32(str(k).encode()) % parts == held]
    none = module.score(docs.limit(0), model)
    assert none.count() == 0
    flat = module.score(docs.limit(3), module.train(docs, labels.limit(0))).collect()
    assert all(r["score"] == 0.5 for r in flat)
    return test


def test_toxicity_on_held_out_rows(spark):
    test = _run_classifier(spark, "toxic", toxicity, 4, 2)
    right = np.mean([(s >= 0.3) == bool(y) for s, y in test])
    assert right > 0.93


def test_string_kernel_equals_all_subsequences():
    r = np.random.default_rng(0)
    for w in ("abcab", "aaaa", "banana", "xyz", "stringkernel"):
        places, value = toxicity.embed(w)
        t = toxicity._triples(len(w))
        raw = Counter()
        for i, j, k in t:
            raw[w[i] + w[j] + w[k]] += toxicity.LAMBDA ** (k - i + 1)
        (_, c), = toxicity.codes([w]).values()
        norm = sum(v * v for v in raw.values())
        assert abs(toxicity.self_kernel(c)[0] - norm) < 1e-4 * norm
        weights = r.normal(size=toxicity._SIZE**3).astype(np.float32)
        margin = float(toxicity.margins([w], weights, 0.0)[0])
        assert margin <= 0 or abs(margin - value @ weights[places]) < 1e-3


def test_quality_on_held_out_rows(spark):
    test = _run_classifier(spark, "quality", quality, 3, 1)
    assert np.mean([(s >= 0.5) == bool(y) for s, y in test]) > 0.95


def test_pipeline_equals_plain_python(spark, tmp_path):
    r = np.random.default_rng(6)
    passage = " ".join(r.choice(CLEAN, size=14))
    rows = [(k, t, "en", "ab"[k % 2], len(t), "") for k, t, _ in _labelled(11, 240, "toxic")]
    long = lambda: " ".join(f"{a}{b}" for a, b in zip(r.choice(CLEAN, size=80), r.integers(0, 99, 80)))
    extra = [long() for _ in range(10)]
    rows += [(1000 + k, t, "en", "a", len(t), "") for k, t in enumerate(extra + extra[:5] + [long() + " " + passage for _ in range(3)])]
    spark.createDataFrame(rows, DOCS).drop("component").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, y) for k, _, y in _labelled(11, 240, "toxic")], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    text = {k: t for k, t, *_ in rows}
    (_, toxic), (_, near), (_, bench), (_, mix), (_, shards) = corpus_pipeline.STAGES
    a = toxic(spark, docs, str(tmp_path))
    kept = {x["doc_id"] for x in a.collect()}
    assert a.columns == names and {k for k in text if k >= 1000} <= kept and len(kept) < len(rows)
    b = near(spark, a, str(tmp_path))
    ids = sorted(kept)
    sets = {k: ngram_set(text[k], 5) for k in ids}
    linked = [(i, j) for i in range(len(ids)) for j in range(i) if 100 * len(sets[ids[i]] & sets[ids[j]]) >= 80 * len(sets[ids[i]] | sets[ids[j]])]
    firsts = {ids[k] for k, root in enumerate(union(len(ids), linked)) if root == k}
    assert {x["doc_id"] for x in b.collect()} == firsts and not firsts & set(range(1010, 1015))
    c = bench(spark, b, str(tmp_path))
    found = decontaminate.brute_force([text[k] for k in sorted(firsts)], [(1, passage)])
    clean = {k for k, f in zip(sorted(firsts), found) if not f[1]}
    assert {x["doc_id"] for x in c.collect()} == clean
    d = mix(spark, c, str(tmp_path)).collect()
    assert {x["doc_id"] for x in d} <= clean and d[0].asDict().keys() == set(names)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x["doc_id"], x["n_bytes"]) for x in out) == sorted((x["doc_id"], len(x["text"].encode())) for x in d)
