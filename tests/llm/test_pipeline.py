"""The pipeline on planted texts: every stage's rows against plain Python."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    rows, toxic = [], {}
    for i in range(240):
        t = list(rng.choice(words, 60))
        if i % 4 == 0:
            t[int(rng.integers(58))] = "zzworst"
        toxic[i] = int(i % 4 == 0)
        rows.append([i, " ".join(t), "en", "ab"[i % 2], 0])
    for n, i in enumerate((1, 2, 3, 5)):  # copies: exact, and with a word or three changed
        t = rows[i][1].split()
        for at in (10, 30, 50)[:n]:
            t[at] = "changed"
        rows.append([300 + n, " ".join(t), "en", "a", 0])
    rows[7][1] += " password = hunter22xx"
    rows[9][1] = None
    docs = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").withColumn("quality", __import__("pyspark").sql.functions.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    text = {r[0]: r[1] for r in rows}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        after = now.collect()
        ids = sorted(r.doc_id for r in after)
        if name != "bpe":
            assert now.columns == docs.columns
        if name == "toxicity":
            clean = {i for i in text if i % 4 or i >= 300}
            assert clean <= set(ids) and len(set(ids) - clean) <= 6
        elif name == "near-duplicates":
            sets = {r.doc_id: _grams(r.text) for r in before if r.text}
            gone = {i for i in sets if any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets)}
            assert ids == sorted(r.doc_id for r in before if r.doc_id not in gone) and {300, 301} <= gone
        elif name == "secrets":
            assert ids == sorted(r.doc_id for r in before)
            seven = next(r for r in after if r.doc_id == 7)
            assert "hunter22" not in seven.text and seven.n_chars == len(seven.text)
            assert all(r.text == text[r.doc_id] for r in after if r.doc_id != 7)
        elif name == "mixing":
            assert set(ids) <= {r.doc_id for r in before} and all(ids.count(i) <= 2 for i in ids)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(corpus_pipeline.queries.tokenizer_path("byte_bpe_50k.json"))
            held = {r.doc_id: r.text for r in before}
            assert ids == sorted(r.doc_id for r in before)
            assert all(r.ids == t.encode(held[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in after)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
