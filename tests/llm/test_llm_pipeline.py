import os
import random

import corpus_pipeline
from llm_rows import sentence
from test_llm_near_duplicates import fingerprint

from lorespan.llm import quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows):
    docs = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    item = "what is the name of the bird that lives by the river of stones"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int("$$$" not in (t or "")), 0) for i, t, _ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return item


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(2)
    rows = [(n, sentence(rng, 150), f"s{n % 3}") for n in range(150)]
    rows += [(200 + n, sentence(rng, 80).replace(" ", "$$$ "), "s0") for n in range(60)]
    item = "what is the name of the bird that lives by the river of stones"
    words, near = rows[10][1].split(), None
    for n in range(150):  # a copy with one word changed whose fingerprint lies within two bits
        copy = " ".join([*words[:n], "other", *words[n + 1 :]])
        if 0 < (fingerprint(copy) ^ fingerprint(rows[10][1])).bit_count() <= 2:
            near = copy
    assert near
    rows += [(300, rows[4][1], "s1"), (301, near, "s1"), (302, f"{sentence(rng, 80)} {item} {sentence(rng, 80)}", "s2"), (303, None, None), (304, "", "s1")]
    folder = str(tmp_path)
    assert tables(spark, folder, rows) == item
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = os.path.join(folder, name)
        out.write.parquet(path)
        columns, docs = docs.columns, spark.read.parquet(path)
        assert name == "token_output" or docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert not [i for i in kept["quality_filter"] if i is not None and 200 <= i < 260]
    assert set(range(150)) <= set(kept["quality_filter"])
    assert not {300, 301} & set(kept["near_dedup"]) and set(range(150)) <= set(kept["near_dedup"])
    assert item not in kept["decontamination"][302].text and len(kept["decontamination"]) == len(kept["near_dedup"])
    assert set(kept["token_output"]) == set(kept["source_mix"])


def test_run_on_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, columns in (("documents", COLUMNS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], columns).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
    assert quality.TRAIN_ROWS == 20_000
