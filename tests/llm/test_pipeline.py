"""The pipeline against a plain version of its stages, on a small folder of its own."""

import random

import corpus_pipeline
import pytest
from labelflow.llm import decision_lists, decontaminate

from . import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    at = str(tmp_path_factory.mktemp("corpus"))
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = words(20)
    docs, labels = [], []
    for i in range(120):
        lines = [words(rng.randint(30, 60)) for _ in range(3)]
        if i % 6 == 0:
            lines = [line.replace(" ", "### ") for line in lines]
        if i % 5 == 1:
            lines.insert(1, "All rights reserved by the owner.")
        if i % 10 == 3:
            lines[2] += f" {item[:-2]} x"
        docs.append((i, "\n".join(lines), "en", "s", 0))
        labels.append((i, int(i % 6 != 0), 0))
    docs += [(200, docs[7][1].replace("w1", "v1", 1), "en", "s", 0), (201, None, None, None, None), (202, docs[8][1], "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{at}/documents.parquet"
    )
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, item


def test_run(spark, folder):
    at, docs, item = folder
    read = lambda name: spark.read.parquet(f"{at}/{name}.parquet")
    learned = decision_lists.fit(read("documents"), read("labels"))
    good = {r.doc_id for r in decision_lists.judge(read("documents"), learned).where("kept").collect()}
    assert good == {i for i, text, *_ in docs if text and i % 6} | {200, 202}
    left = brute.without_lines([(i, text) for i, text, *_ in docs if i in good])
    left = [(i, "\n".join(kept)) for i, kept, _ in left if "".join(kept).strip()]
    left.sort()
    groups = brute.copy_components([t for _, t in left])
    left = [d for n, (d, c) in enumerate(zip(left, groups, strict=True)) if n == c]
    budget = decontaminate.allowed_edits(len(item))
    left = {i: t for i, t in left if brute.distance(item, t.lower().replace("\n", " ")) > budget}
    got = corpus_pipeline.run(spark, at).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: brute.sha256(t) for i, t in left.items()}
    assert len(got) == len(left) and 202 not in left and 13 not in left


def test_stages_keep_columns_and_bear_empty_input(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near-dedup", "decontamination", "encoding",
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), at).columns == docs.columns
        assert stage(spark, docs.limit(0), at).count() == 0
        assert dict(stage(spark, docs, at).dtypes) == dict(docs.dtypes)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), at).count() == 0
