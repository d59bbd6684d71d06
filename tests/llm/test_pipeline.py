import hashlib

import numpy as np

import corpus_pipeline as P
from quillspark.llm import op04_quality, op10_bpe
from quillspark.llm.common import table
from tests.llm.test_op06 import brute as leaks
from tests.llm.test_op08 import brute as groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, now = docs.columns, docs
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name != "encode":
            assert now.columns == columns
        kept[name] = {r.doc_id: r for r in now.collect()}
    start = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in op04_quality.classify(docs, op04_quality.train(docs, table(spark, SF, "labels"))).collect() if r.predicted}
    assert set(kept["quality"]) == good and all(kept["quality"][d] == start[d] for d in good)
    single = {d for d, _, _, keep in groups([(d, r.text) for d, r in kept["quality"].items()], 5, 80) if keep}
    assert set(kept["near_dedup"]) == single
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {d for d, r in kept["near_dedup"].items() if not leaks(items, r.text)}
    assert set(kept["decontaminate"]) == clean
    assert set(kept["secrets"]) == clean and all(len(r.text) == r.n_chars for r in kept["secrets"].values())
    tokenizer = op10_bpe.load(op10_bpe.default_vocabulary("byte_bpe_50k.json"))
    for d, r in kept["encode"].items():
        ids = tokenizer.encode(kept["secrets"][d].text, add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, kept["encode"].values()))
