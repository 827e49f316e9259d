"""Baum-Welch passes read the stored symbols, not the texts."""

from graphloom.llm import hmm


def test_passes_do_not_read_the_texts_again(spark, monkeypatch, tmp_path):
    path, read, real = f"{tmp_path}/d.parquet", [], hmm.summed
    spark.createDataFrame([(f"a{i % 7} b c{i}",) for i in range(60)] + [("",)], "text string").write.parquet(path)
    monkeypatch.setattr(hmm, "summed", lambda rows: read.extend(rows.inputFiles()) or real(rows))
    _, _, seen = hmm.train(spark.read.parquet(path))
    assert read and not any(str(tmp_path) in f for f in read)
    assert seen.sum() == 60 * 3 + 61
