"""The pipeline's stages, one after the other, against brute force on their own input."""

import corpus_pipeline as P
import brute


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in P.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = before, docs
    pairs = lambda df: sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
    before, after = seen["quality"]
    assert set(pairs(after)) < set(pairs(before)) and after.columns == P.COLUMNS
    before, after = seen["near_duplicates"]
    rows = pairs(before)
    assert pairs(after) == [r for r, v in zip(rows, brute.near_duplicates(rows, 80), strict=True) if v[3] or not v[1]]
    before, after = seen["repeated_passages"]
    removed = {r[0]: r for r in brute.repeated_passages(pairs(before))}
    for i, text in pairs(after):
        if text.isascii():
            assert brute.digest(text) == removed[i][4]
    assert after.count() == before.count()
    before, after = seen["benchmark_passages"]
    hits = {i: h for i, _, h, _ in brute.held_out_hits(pairs(before), bench)}
    words = {i: len(brute.WORD.findall(brute.lower(t))) for i, t in pairs(before)}
    assert all(len(brute.WORD.findall(brute.lower(t))) == words[i] - len(hits[i]) for i, t in pairs(after))
    assert any(hits.values())
    before, after = seen["encoded"]
    assert after.count() == before.count() and after.filter("n_tokens > 0").count() > 0


def test_odd_documents(spark, sf_dir):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "x", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for docs in (odd, odd.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.count() <= docs.count(), name
