"""The pipeline's stages on a small corpus: what goes, what stays, and the packed result."""

from __future__ import annotations

import random
from pathlib import Path

import corpus_pipeline
import pytest
from tidewire.llm.packing import encoder

from .conftest import sentence


def test_stages_in_order(spark, make, vocabulary, tmp_path):
    rng = random.Random(21)
    clean = [". ".join(sentence(rng, 9, vocabulary).capitalize() for _ in range(5)) + "." for _ in range(60)]
    junk = [" ".join(f"{w}###" for w in sentence(rng, 40, vocabulary).split()) for _ in range(20)]
    item = sentence(rng, 20, vocabulary)
    texts = [*clean, *junk, clean[3], f"{item} {sentence(rng, 30, vocabulary)}"]
    make(texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(80)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "substrings", "decontamination", "packing"]
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got.doc_id) == set(range(60))
    assert got.length.sum() == sum(len(encoder()(t)) + 1 for t in clean)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_takes_nulls_long_texts_repeats_clashing_names_and_nothing(spark, make, vocabulary, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rng = random.Random(22)
    item, passage, own = (sentence(rng, n, vocabulary) for n in (20, 70, 60))
    clean = [sentence(rng, 60, vocabulary) for _ in range(12)]
    texts = [*clean, None, "", " \n\t", "long " * 30_000, f"{clean[0]} {passage}", f"{own}\n{passage}", f"{sentence(rng, 900, vocabulary)} {item}", clean[2], clean[2], clean[3]]
    ids = [*range(12), 12, 13, 14, 15, 16, 17, 18, 2, None, None]
    docs = make(texts, ids=ids, extra=True)
    spark.createDataFrame([(k, 1, 0) for k in range(12)] + [(None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (None, "?")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    if name == "packing":
        assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got if r["piece"] == 0) == sorted((i is None, i) for i in ids)
    else:
        assert out.columns == docs.columns
        kept = [r["doc_id"] for r in got]
        assert set(range(3, 12)) <= set(kept) and all(r["h"] == "x-h" for r in got)
        if name == "decontamination":
            assert 18 not in kept and len(kept) == len(ids) - 1
        if name == "substrings":
            assert len(kept) == len(ids) and {r["doc_id"]: r["text"].strip() for r in got if r["doc_id"] == 17} == {17: own}
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_intermediate_tables_go_with_their_stage(spark, make, vocabulary, tmp_path):
    from tidewire.llm.common import work_dir

    rng = random.Random(23)
    docs = make([sentence(rng, 60, vocabulary) for _ in range(4)] * 2, ids=range(8))
    spark.createDataFrame([(1, "nothing of this occurs")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    root = Path(work_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(root.iterdir()) if root.exists() else set()
    out = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert len(set(root.iterdir()) - before) == 1 and out.count() == 8  # the ids that go


def test_only_stashed_tables_are_ever_deleted(spark, tmp_path):
    from tidewire.llm import common

    spark.range(3).write.parquet(str(tmp_path / "mine"))
    mine = spark.read.parquet(str(tmp_path / "mine"))
    kept = common.stash(mine)
    common.free(kept.union(kept).join(mine, "id"))
    assert mine.count() == 3 and not Path(kept.inputFiles()[0].removeprefix("file://")).exists()
    made = common.tidy(lambda: common.stash(mine).join(common.stash(common.stash(mine)), "id"))()
    assert made.count() == 3 and mine.count() == 3


def test_no_process_sets_modes_of_a_stashed_tables_folders(spark):
    from tidewire.llm import common

    root = Path(common.work_dir(spark).removeprefix("file://").removeprefix("file:"))

    def seen(batches):
        for batch in batches:
            (at,) = root.glob("modes-*")
            yield batch.assign(mode=[p.stat().st_mode & 0o777 for p in (at, at / "_temporary", at / "_temporary/0")])

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    umask = conf.get("fs.permissions.umask-mode")
    conf.set("fs.permissions.umask-mode", "050")  # Hadoop's processes would leave 727
    try:
        table = common.stash(spark.range(0, 3, 1, 1).mapInPandas(seen, "id bigint, mode bigint"), "modes")
        got = [r["mode"] for r in table.orderBy("id").collect()]
    finally:
        conf.set("fs.permissions.umask-mode", umask) if umask else conf.unset("fs.permissions.umask-mode")
    (at,) = root.glob("modes-*")
    assert 0o727 not in got and len(got) == 3
    assert [p.suffix for p in at.iterdir()] == [".parquet"]  # no mark, which takes a process too
    common.free(table)
