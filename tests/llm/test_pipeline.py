import corpus_pipeline as C
from factorloom.llm import bpe, mixing, quality_rules, secrets, simhash
from factorloom.llm.queries import word_vocabulary


def test_stages(spark, tmp_path):
    base = [" ".join(f"{chr(97 + (k * 7 + j) % 26)}{j}x{k}" for j in range(90)) for k in range(40)]
    rows = [(k, t + ' token = "' + f"{k:02d}ab" * 10 + '"', "en", f"s{k % 3}", 1) for k, t in enumerate(base)]
    rows += [(100 + k, t, "en", s, n) for k, (_, t, _, s, n) in enumerate(rows[:6])] + [(200, None, "en", None, 0), (201, "too short", "en", "s0", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    kept = C.apply_quality_rules(spark, docs, d)
    assert kept.columns == docs.columns and kept.count() == 46
    one = C.drop_near_duplicates(spark, kept, d)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {r["component_id"] for r in simhash.near_duplicates(kept).collect()}
    safe = C.mask_secrets(spark, one, d)
    assert safe.columns == docs.columns and all(secrets.MASK in r["text"] and r["n_chars"] == len(r["text"]) for r in safe.collect())
    mixed = C.mix_sources(spark, safe, d)
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(safe).collect()}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and got == {k: n for k, n in want.items() if n}
    last = C.run(spark, d)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, bpe.encode_digests(mixed, word_vocabulary()).collect()))
    assert quality_rules.base_failed(10, 0)
    assert [name for name, _ in C.STAGES] == ["quality_rules", "simhash", "secrets", "mix", "bpe"]
