"""The pipeline's stages on a small folder."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    from tests.llm import helpers as H

    good = "the small brown house on the hill has a red door and a green garden behind it where cats sleep".split()
    rows = [(i, " ".join(f"{w}{(i * 31 + k) % 977}" if k % 3 else w for k, w in enumerate(good * 5)), "en", "s", 0) for i in range(60)]
    passage = " ".join(f"p{k}" for k in range(55))
    rows += [(100 + i, rows[i][1] + f" {passage} end{i}", "en", "s", 0) for i in range(3)]
    rows += [(200 + i, f"$$$ ### {i} !!! " * 30, "en", "s", 0) for i in range(60)] + [(300, None, None, None, None), (301, rows[0][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(not 200 <= r[0] < 300), 0) for r in rows if r[0] % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        kept.append((name, now.columns, now.count()))
        now.write.parquet(f"{tmp_path}/{len(kept)}")
        now = spark.read.parquet(f"{tmp_path}/{len(kept)}")
    assert all(c == docs.columns for _, c, _ in kept[:-1])
    first = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert not any(200 <= i < 300 for i in first) and {0, 1, 2, 100, 301} <= first
    second = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    found = H.components([r for r in rows if r[0] in first], 80, 5)
    assert set(second) == {i for i in first if found[i][1] == i} and 301 not in second
    third = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert not any(passage in (t or "") for t in third.values()) or sum(passage in t for t in second.values()) < 2
    whole = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/4").collect()}
    assert whole == set(third)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[-1][2]
