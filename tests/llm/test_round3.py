"""Centroid clustering, byte-level BPE and fill-in-middle against brute force and the public library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tideweave.llm import byte_bpe, centroids, fill_in_middle, jaccard, mixing, toxicity
from tideweave.llm.byte_bpe import Prefixes, Vocabulary

# --- centroid clustering ---


def lloyd(rows, k, rounds, scale, seed="3"):
    """Every distance in whole numbers; rows: id, vector."""
    v = [(i, [int(np.floor(float(x) * scale)) for x in x]) for i, x in rows]
    order = sorted(range(len(v)), key=lambda r: (v[r][0] is None, hashlib.sha256(f"{seed}:{v[r][0]}".encode()).hexdigest() if v[r][0] is not None else "", v[r][1]))
    c = [v[r][1] for r in order[:k]]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min((gap(x, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in v]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(v, own) if o == j]
            c[j] = [sum(col) // len(mine) for col in zip(*mine)] if mine else c[j]
    return sorted(((i, *near(x)[::-1]) for i, x in v), key=repr), c


def vectors(spark, rows, extra=False):
    schema = "vec_id long, embedding array<float>" + (", label int, cluster string, v int" if extra else "")
    return spark.createDataFrame([(*r, 1, "clash", 2) if extra else r for r in rows], schema).repartition(3)


def test_clusters_equal_comparing_everything(spark):
    r = np.random.default_rng(2)
    rows = [(k, list(map(float, np.round(r.normal(size=4) + 3 * (k % 5), 1)))) for k in range(120)]  # rounding makes ties
    rows += [(200 + k, [1.0, 1.0, 1.0, 1.0]) for k in range(30)] + [rows[5]] * 3 + [(None, [0.5, -2.0, 0.0, 9.0])]
    left_out = [(300, None), (301, [1.0, 2.0, 3.0]), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 0.0, 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0, 0.0]), (305, [])]
    found, final = centroids.cluster(vectors(spark, rows + left_out, True), k=5, rounds=4, dims=4, scale=8)
    want, c = lloyd(rows, 5, 4, 8)
    got = found.collect()
    assert sorted(((x["vec_id"], x["cluster"], x["distance"]) for x in got), key=repr) == want and final == c
    assert sum(x["looked"] for x in got) < 5 * len(got)  # bounds spare distances


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, None), (2, [3.0])]])
def test_few_vectors_give_few_clusters(spark, rows):
    found, final = centroids.cluster(vectors(spark, rows), k=3, rounds=2, dims=2)
    kept = [r for r in rows if r[1] and len(r[1]) == 2]
    assert found.count() == len(kept) == len(final)
    assert {"vec_id", "cluster", "distance"} <= set(found.columns)


def test_vectors_too_large_for_exact_distances_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(vectors(spark, [(1, [1e30, 0.0])]), dims=2)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_bounds_never_hide_a_nearest_centroid(seed):
    r = np.random.default_rng(seed)
    v, c, before = r.integers(-6, 6, (60, 2)), r.integers(-6, 6, (4, 2)), None
    state = np.zeros(60, np.int32), np.zeros(60), np.zeros((60, 4))
    for _ in range(5):
        own, upper, lower, _ = centroids.Step(c, before).assign(v, *state)
        exact = ((v[:, None] - c) ** 2).sum(axis=2)
        assert (own == exact.argmin(axis=1)).all()
        assert (upper >= np.sqrt(exact[np.arange(60), own])).all() and (lower <= np.sqrt(exact)).all()
        state, before, c = (own, upper, lower), c, c + r.integers(-1, 2, c.shape)


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def public():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(open(path, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return path, Vocabulary(ranks, public_tokenizers.PATTERN), library


TEXTS = [
    "Hello world's  end\n\n\t x", "naïve Überraschung — дом 漢字かな 한국어 🙂👩‍👩‍👧", "a" * 500, " " * 90 + "x", "12345678901234567890", "'s't're'LL", "\x1c\x85 　 y", "<|endoftext|>",
    "՘a \U00018d80\U000323b0b 1\U00011de0", "q" + "́" * 70, "\x00\x7f퟿�",
]


def test_ids_are_those_of_the_library(public):
    _, v, library = public
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice(a) for _ in range(r.randint(1, 120))) for a in ("ab", "aab c", "漢字語學", "éü 'd", "🙂é1 ") for _ in range(60)]
    for text in texts:
        assert list(v.encode(text)) == library.encode_ordinary(text), text
        assert v.decode(v.encode(text)) == text.encode()
    assert v.encode(None) == v.encode("") == []
    with pytest.raises(ValueError, match="99999"):
        v.decode([99999])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=2, max_size=5), max_size=14, unique=True), st.text("abc", max_size=40), st.randoms())
def test_any_ranks_merge_as_by_rounds(tokens, text, r):
    """Tokens that no merge reaches, and several ways to one token, are among these."""
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + k for k, t in enumerate(tokens)}
    v = Vocabulary(ranks, r"[\s\S]+")
    library = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    assert list(v.encode(text)) == library.encode_ordinary(text)
    if text and text.encode() not in ranks:
        assert v.merged(text.encode()) == list(v.encode(text))


def test_appends_and_edits_encode_anew_near_them_only(public):
    _, v, _ = public
    r = random.Random(3)
    for _ in range(60):
        raw = "".join(r.choice("abcdefgh漢é ") for _ in range(400)).encode()
        grown = Prefixes(v)
        for k in range(0, len(raw), 37):
            grown.append(raw[k : k + 37])
        whole = Prefixes(v, raw)
        assert grown.last == whole.last and grown.tokens() == whole.tokens()
        at, removed, added = r.randrange(len(raw) + 1), r.randrange(5), bytes(r.choice(b"abcxyz") for _ in range(r.randrange(6)))
        done = whole.splice(at, removed, added)
        again = Prefixes(v, raw[:at] + added + raw[at + removed :])
        assert whole.raw == again.raw and whole.last == again.last
        assert done <= len(added) + 8 * v.longest or at + done >= len(whole.raw)


def test_documents_are_encoded_and_decoded(spark, public):
    path, v, library = public
    texts = [*TEXTS, None, "", "word " * 30_000, "long" * 4000]
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)] + [(0, texts[0], "", 2), (None, "no id", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    ranks = byte_bpe.ranks_of(spark, path, public_tokenizers.PATTERN)
    for packed in (True, False):
        got = byte_bpe.decode(byte_bpe.encode(docs, ranks, packed=packed), ranks).collect()
        assert len(got) == len(rows)
        by = {r["doc_id"]: r for r in got}
        for k, t, *_ in rows:
            want = library.encode_ordinary(t or "")
            ids = np.frombuffer(by[k]["ids"], "<u4").tolist() if packed else by[k]["ids"]
            assert ids == want and by[k]["n_tokens"] == len(want) and bytes(by[k]["decoded"]) == (t or "").encode()
    assert byte_bpe.encode(docs.limit(0), ranks).count() == 0


# --- fill-in-middle ---


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=3000))
def test_rank_and_select_equal_counting(data):
    data = np.array(data, np.uint8)
    ones = np.flatnonzero((data & 0xC0) != 0x80)
    b = fill_in_middle.Boundaries(data)
    at = np.arange(len(data) + 1)
    assert (b.rank(at) == np.searchsorted(ones, at)).all()
    assert (b.select(np.arange(len(ones))) == ones).all()


def plain_form(i, text, seed="1"):
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_documents_are_cut_and_restored(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("aé漢🙂 <PSM>\n") for _ in range(r.randrange(90))) for _ in range(300)]
    texts += [None, "", "a", "🙂", "has <P> in it", "<S>", "x<M", "é" * 70_000, "<", "P>" * 9]
    rows = [(k, t, "clash", 5) for k, t in enumerate(texts)] + [(0, texts[0], None, 1), (None, "no id", "f", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    out = fill_in_middle.fill_in_middle(docs)
    got = out.withColumn("back", fill_in_middle.restored(out["output"], out["form"])).collect()
    want = sorted(((i, *plain_form(i, t or ""), t or "") for i, t, *_ in rows), key=repr)
    assert sorted(((x["doc_id"], x["n"], x["form"], x["prefix_chars"], x["middle_chars"], x["output"], x["back"]) for x in got), key=repr) == want
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_queries_run_over_all_rows(spark, tmp_path):
    from tideweave.llm import catalog

    texts = [*TEXTS, None, "", "plain words here"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in catalog.queries()["op12_byte_bpe"](spark, str(tmp_path)).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert rows[k]["n_tokens"] == len(ids) and rows[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


# --- earlier operators: odd input ---

CLEAN = ["river", "stone", "garden", "window", "paper", "summer", "letter", "market", "silver", "number", "forest", "copper", "meadow", "bridge", "candle", "orchard"]
BAD = ["vilewort", "grubnose", "mudsnark", "dimwit", "loathsome"]


@pytest.fixture(scope="module")
def toxic_model(spark):
    r = np.random.default_rng(9)
    rows = []
    for k in range(400):
        words = list(r.choice(CLEAN, size=int(r.integers(3, 60))))
        if k % 4 == 0:
            words.insert(int(r.integers(len(words))), str(r.choice(BAD)))  # plain forms only: every altered one is unseen
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))


def test_altered_insults_that_training_lacks_are_caught(toxic_model):
    r = np.random.default_rng(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    altered = {
        "inserted": lambda w, i: w[:i] + letters[r.integers(26)] + w[i:], "doubled": lambda w, i: w[:i] + w[i - 1] + w[i:], "tripled": lambda w, i: w[:i] + w[i - 1] * 2 + w[i:],
        "dotted": lambda w, i: w[:i] + "." + w[i:],
    }
    for kind, change in altered.items():
        texts = [" ".join([*r.choice(CLEAN, size=8), change(w, int(r.integers(1, len(w)))), *r.choice(CLEAN, size=8)]) for w in BAD for _ in range(20)]
        assert (toxic_model.scores(texts) >= 0.3).mean() >= (0.8 if kind in ("inserted", "dotted") else 0.6), kind
    assert (toxic_model.scores([" ".join(r.choice(CLEAN, size=17)) for _ in range(200)]) >= 0.3).mean() <= 0.02


def test_length_alone_makes_no_text_toxic(toxic_model):
    odd = toxic_model.scores([None, "", " \n", "river", "ok", "漢字", "漢字 " * 4000, "1 2 3", "river " * 20_000])
    assert (odd < 0.3).all() and (odd <= toxic_model.rest + 1e-12).all()
    assert toxic_model.scores(["you grubnose"])[0] >= 0.3 > odd.max()


CLASHING = "doc_id long, text string, source string, n_chars long, _h1 string, h1 string, runs string, _runs int, id string, row string, many int, salt string, key1 string"


def test_columns_that_clash_with_helpers_come_through(spark):
    r = np.random.default_rng(8)
    texts = [" ".join(r.choice(CLEAN, size=40)) + f" tail{k}" for k in range(6)]
    rows = [(k, t, "s", len(t), f"a{k}", f"b{k}", f"c{k}", k, f"d{k}", f"e{k}", k, f"f{k}", f"g{k}") for k, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame([*rows, rows[1], rows[1]], CLASHING)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[:6])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    by = {x[0]: x for x in rows}
    for x in mixed.collect():
        assert tuple(x)[4:] == by[x["doc_id"]][4:] and set(x["text"].split()) <= set(by[x["doc_id"]][1].split()) and x["n_chars"] == len(x["text"])
