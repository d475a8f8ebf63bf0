"""The pipeline's stages on a small table against plain Python."""

import os

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import langid, simhash
from strandline.llm.common import remainder

from .test_operators import blank, spans


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    en, de = ["the", "and", "house", "water", "running", "green"], ["der", "und", "haus", "wasser", "schön", "grün"]
    rows = [(i, " ".join(r.choice(en if i % 2 else de, 40)), "en" if i % 2 else "de", "s", 0) for i in range(300)]
    rows += [(300 + i, rows[i][1].replace(" ", "  ", 1), rows[i][2], "s", 0) for i in range(0, 40, 4)]
    rows += [(400, rows[1][1] + " token = abcdef99", "en", "s", 0), (401, None, None, "s", 0), (402, "", None, "s", 0), (403, "123", None, "s", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*x[:4], len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(path, "documents.parquet"))
    return path


def near_components(ids, texts):
    fps = [[simhash.fingerprint(t, 5, seed) for seed in (42, 1042)] for t in texts]
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i][0] ^ fps[j][0]).bit_count() <= 8 and (fps[i][1] ^ fps[j][1]).bit_count() <= 12 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return [min(k for k, y in zip(ids, label) if y == x) for x in label]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    known = corpus_pipeline.language(spark, docs, sf_dir).toPandas()
    model = langid.fit(docs, remainder("doc_id", 5) != 0)
    assert set(known.doc_id) == {r.doc_id for r in langid.score(docs, model).filter("NOT rejected").collect()}
    assert not {401, 402, 403} & set(known.doc_id) and set(range(300)) <= set(known.doc_id)
    exact = corpus_pipeline.exact(spark, spark.createDataFrame(known), sf_dir)
    first = known.assign(t=known.text.map(blank)).groupby("t").doc_id.min()
    assert sorted(r.doc_id for r in exact.collect()) == sorted(first) and exact.columns == names
    rows = exact.orderBy("doc_id").toPandas()
    near = corpus_pipeline.near(spark, spark.createDataFrame(rows), sf_dir)
    comp = near_components(rows.doc_id.tolist(), rows.text.tolist())
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(comp)) and near.columns == names
    clean = corpus_pipeline.secrets(spark, near, sf_dir)
    kept = {r.doc_id: r.text for r in near.collect()}
    for r in clean.collect():
        assert not spans(r.text) and (r.text == kept[r.doc_id] or spans(kept[r.doc_id])) and (r.text == kept[r.doc_id] or r.n_chars == len(r.text))
    pieces = corpus_pipeline.pack(spark, clean, sf_dir).toPandas()
    assert set(pieces.doc_id) == set(kept) and pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_run_keeps_every_document_of_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "secret scan", "packing"]
