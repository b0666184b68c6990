"""The registered queries of the corpus operators, over whole small tables with odd rows: against DuckDB where SQL says the
same, against the models in plain Python otherwise."""

import json
import zlib

import duckdb
import numpy as np
import pytest

from tideweave.llm import catalog, quality, toxicity

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The folder of small tables: nulls in every column, empty and very long texts, ties, repeated rows."""
    r, d = np.random.default_rng(21), str(tmp_path_factory.mktemp("tables"))
    word = lambda n: " ".join(r.choice([f"w{k}" for k in range(60)], size=n))
    bench = [(k, word(n)) for k, n in enumerate((14, 3, 25, 10, 1))] + [(7, None), (8, ""), (1, "again " + word(4))]
    bases = [word(int(n)) for n in r.integers(3, 120, 25)]
    texts = [" ".join(b.split()[: len(b.split()) - int(r.integers(0, 2))]) for b in bases for _ in range(4)]
    texts += [f"{word(9)} {bench[0][1]}! {word(5)}", bench[2][1].upper().replace(" ", ", "), None, "", " \n\t ", "é " * 3000, "X", "a.b@c.de +1 (555) 010-2030 4539148803436467 1.2.3.4", "vile grubnose"]
    rows = [(k, t, "en", [None, "a", "b", "void"][k % 3 if t else 3], len(t or ""), "clash") for k, t in enumerate(texts)]
    rows += [rows[3]] * 2 + [rows[-3]] + [(None, "some text without an id", None, "a", 5, ""), (400, "vilegrub toxic grubnose", "en", "b", None, "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component string").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    marked = [(k, int(k % 5 > 1), int(k % 7 == 0)) for k in range(len(texts))] + [(3, None, 1), (None, 1, 1)]
    spark.createDataFrame(marked, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vectors = [(k, [float(x) for x in np.round(r.normal(size=6) if k % 3 == 0 else [1, 2, 3, 4, 5, 6 + k % 4 / 8], 3)], [0, 1, None][k % 5 // 2]) for k in range(40)]
    vectors += [(90, None, 0), (91, [0.0] * 6, 0), (92, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (93, [2.0, 4.0, 6.0, 8.0, 10.0, 12.0], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    urls = ["http://a.Example.ORG/es/x?q", "http://example.org/en/12", "http://org/", "http://x.com/fr/a", "https://x.com/de/#f", "no", None, "", "ftp://com/fr/", "http://x.org/" + "p" * 3000]
    spark.createDataFrame([(k, u, "<p>") for k, u in enumerate(urls)] + [(2, urls[2], None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    call = json.dumps({"id": "c1", "name": "search", "arguments": {"query": "x"}})
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", f"<tool_call>{call}</tool_call>"), (1, 2, "tool", '{"tool_call_id":"c1","content":1}'), (1, 2, "tool", '{"tool_call_id":"c1","content":1}'), (None, None, None, None), (2, 0, "assistant", f"<tool_call>{call}</tool_call>" * 400)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def _same(value):
    return None if value is None else round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    found = con.sql(catalog.oracle_sql()[name])
    columns = sorted(found.columns)
    want = sorted((tuple(_same(dict(zip(found.columns, row))[c]) for c in columns) for row in found.fetchall()), key=repr)
    out = QUERIES[name](spark, tables)
    assert sorted(out.columns) == columns
    rows = [r for r in out.collect() if name != "op7_jaccard" or r["doc_id"] is not None]  # its twin joins by id, so leaves out null ids
    assert sorted((tuple(_same(row[c]) for c in columns) for row in rows), key=repr) == want


@pytest.mark.parametrize("name,module,label,parts,held,threshold", [("op4_toxicity", toxicity, "toxic", 4, 2, 0.3), ("op10_quality", quality, "quality", 3, 1, 0.5)])
def test_classifier_query_equals_its_model(spark, tables, name, module, label, parts, held, threshold):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    score = model.scores([t for _, t in rows]) if name == "op4_toxicity" else [model.score(module.indicators(t)) for _, t in rows]
    want = [(i, i is not None and zlib.crc32(str(i).encode()) % parts == held, round(float(s), 9), int(s >= threshold)) for (i, _), s in zip(rows, score)]
    got = [(r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in QUERIES[name](spark, tables).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # labels of another type than the ids', held-out labels and other columns change nothing
    text = labels.withColumn("doc_id", labels["doc_id"].cast("string"))
    again = module.train(docs.withColumn("lang", docs["text"]), text)
    assert np.allclose(again.scores([t for _, t in rows]) if name == "op4_toxicity" else [again.score(module.indicators(t)) for _, t in rows], score)
    flipped = labels.withColumn(label, quality.F.when(quality.fold_of(quality.F.col("doc_id"), parts, held), 1 - labels[label]).otherwise(labels[label]))
    other = module.train(docs, flipped)
    assert np.allclose(other.scores([t for _, t in rows]) if name == "op4_toxicity" else [other.score(module.indicators(t)) for _, t in rows], score)


def test_every_query_runs_over_these_tables(spark, tables):
    for name in ("op5_chat_format", "op8_mix", "op6_shard", "op7_jaccard"):
        source = "conversations" if name == "op5_chat_format" else "documents"
        assert QUERIES[name](spark, tables).count() == spark.read.parquet(f"{tables}/{source}.parquet").count(), name
