"""What the driver gets of a corpus comes in few jobs, however many partitions there are."""

import numpy as np

from tideweave.llm import jaccard, toxicity

PARTS = 64


def test_tables_for_the_driver_take_few_jobs(spark):
    conf = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()

    def jobs(run):
        before = scheduler.numTotalJobs()
        return run(), scheduler.numTotalJobs() - before

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame([(i, f"some words {i} here {'grobnik' * (i % 3 == 0)}") for i in range(256)], "doc_id long, text string").repartition(PARTS)
        labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(256)], "doc_id long, toxic int")
        model, n = jobs(lambda: toxicity.train(docs, labels))
        assert model.fitted and n < PARTS
        bits, n = jobs(lambda: jaccard._bitmap(docs.select(docs["doc_id"].alias("id"))))
        assert np.unpackbits(bits).sum() == 256 and n < PARTS // 8
        counts, n = jobs(lambda: jaccard._counters(docs, "text", 2))
        assert counts.sum() == sum(len(jaccard.ngrams(r[1], 2)) for r in docs.collect()) and n < PARTS // 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
