"""What a worker keeps between tasks, and texts that are sent once."""

import numpy as np
import pyarrow as pa

from lumenframe.llm import bpe, langid, quality, shared


def held_by_workers(spark, module):
    """Entries that a task of a module finds in the encoder's cache."""

    def run(batches):
        from lumenframe.llm import bpe

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [bpe.codec.cache_info().currsize] * batch.num_rows})

    run.__module__ = module
    return sum(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(shared.freed(run), "n long").collect())


def test_workers_drop_what_other_operators_left(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(16)
    assert bpe.encode_documents(docs, bpe.default_path()).where("length(ids) > 0").count() > 0
    assert held_by_workers(spark, "lumenframe.llm.bpe") > 0
    assert held_by_workers(spark, "lumenframe.llm.quality") == 0


def test_carried_texts_are_sent_once(odd_docs):
    rows, at = shared.with_text(odd_docs, ("doc_id", "text"), "text")
    assert rows.columns == ["doc_id", "text"] and at == 1
    rows, at = shared.with_text(odd_docs, ("doc_id",), "text")
    assert rows.columns == ["doc_id", "__text"] and at == 1
    prototypes = langid.train(odd_docs)
    key = lambda r: (str(r.doc_id), r.lang_pred, r.score)
    few, more = langid.identify(odd_docs, prototypes), langid.identify(odd_docs, prototypes, carry=("text", "doc_id"))
    assert more.columns[:2] == ["text", "doc_id"] and sorted(map(key, few.collect())) == sorted(map(key, more.collect()))
    assert "__text" not in more._jdf.queryExecution().toString()
    ratio = np.linspace(-1, 1, quality.BUCKETS)
    key = lambda r: (str(r.doc_id), r.log_weight)
    few, more = quality.weigh(odd_docs, ratio), quality.weigh(odd_docs, ratio, carry=("text", "doc_id"))
    assert sorted(map(key, few.collect())) == sorted(map(key, more.collect()))
    assert "__text" not in more._jdf.queryExecution().toString()
