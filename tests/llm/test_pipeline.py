import corpus_pipeline
from tidemark.llm import decontaminate, line_dedup, minhash, packing, quality_rules
from tidemark.llm.common import staged


def test_stages_hand_on_what_they_keep(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        seen.append(docs.collect())
    quality, lines, copies, leaks, pieces = ({r.doc_id for r in rows} for rows in seen)
    first = seen[0]
    assert all(r.text == texts[r.doc_id] for r in first)
    counted = quality_rules.count_text(spark.read.parquet(f"{folder}/documents.parquet"))
    verdict = quality_rules.judge(counted, quality_rules.references(counted)).where("kept").select("doc.doc_id").collect()
    assert quality == {r.doc_id for r in verdict} and quality < set(texts)
    assert lines <= quality and copies <= lines and leaks <= copies and pieces == leaks
    assert list(seen[3][0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in seen[1])
    frame = spark.createDataFrame(seen[2], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert minhash.near_duplicates(frame).where("links > 0").count() == 0
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    after = spark.createDataFrame(seen[3], frame.schema)
    assert decontaminate.find_leaks(after, bench).count() == 0
    assert line_dedup.dedup_lines(after).where("n_long > n_kept").count() == 0
    fill = {}
    for r in seen[4]:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= packing.SEQUENCE
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, seen[4]))
