from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkfolio.llm import fertility, langid, mixing, stages, tokens

from .test_near_duplicates import brute
from .test_tokens_files_packing import check

SF = "/root/testdata/sf0.001"
NAMES = ["_once", "_id", "_hash", "_own", "_copies", "_copy", "_ONCE_"]


def rows(df):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))


def test_the_pipeline_equals_its_stages_done_plainly(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "minhash_near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in fertility.rules(docs).collect() if r["kept"]}
    one = stages.quality_rules(spark, docs, SF)
    assert rows(one) == rows(docs.filter(F.col("doc_id").isin(*good))) and one.columns == docs.columns
    one = one.cache()
    known = {r["doc_id"] for r in langid.identify(one).collect() if r["lang_pred"] != "und" and r["score"] >= stages.LEAST_SHARE}
    two = stages.language_id(spark, one, SF).cache()
    assert rows(two) == rows(one.filter(F.col("doc_id").isin(*known)))
    _, parts = brute([(r["doc_id"], r["text"]) for r in two.collect()], 5, 80)
    three = stages.minhash_near_dedup(spark, two, SF).cache()
    assert rows(three) == rows(two.filter(F.col("doc_id").isin(*set(parts.values()))))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(three, mixing.domains_of(spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    four = stages.mixing(spark, three, SF).cache()
    assert Counter(r["doc_id"] for r in four.collect()) == Counter({i: n for i, n in copies.items() if n})
    five = stages.packing(spark, four, SF).collect()
    sizes = {r["doc_id"]: len(tokens.encoder().encode(r["text"])) // 4 + 1 for r in four.collect()}
    check(five)
    got = Counter()
    for r in five:
        got[r["doc_id"]] += r["length"]
    assert got == Counter({i: n * sizes[i] for i, n in copies.items() if n})
    ran = corpus_pipeline.run(spark, SF).collect()
    check(ran)
    piece = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"])
    assert sorted(map(piece, ran)) == sorted(map(piece, five))
    # one document of each group stays, and most of what is clean
    clean = [r["doc_id"] for r in docs.collect() if r["n_chars"] > 400 and not set("#*$%&|<>") & set(r["text"])]
    assert len(clean) > 50 and np.mean([i in good for i in clean]) > 0.85


def test_stages_take_any_documents(spark, odd, none):
    own = lambda df: df.withColumns({n: F.lit(f"mine {n}") for n in NAMES})
    for name, stage in (("quality_rules", stages.quality_rules), ("language_id", stages.language_id), ("minhash_near_dedup", stages.minhash_near_dedup), ("mixing", stages.mixing)):
        out = stage(spark, own(odd), SF)
        assert out.columns == own(odd).columns, name
        assert all(r[n] == f"mine {n}" for r in out.collect() for n in NAMES), name
        assert stage(spark, none, SF).count() == 0, name
    assert stages.packing(spark, none, SF).count() == 0
    assert stages.minhash_near_dedup(spark, odd, SF).filter("doc_id in (6, 7)").count() == 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert stages.minhash_near_dedup(spark, docs.limit(30).unionByName(docs.limit(30)), SF).count() <= 30
