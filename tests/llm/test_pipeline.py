"""The pipeline's rows against its stages done by brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from cuelake.llm import toxicity  # noqa: E402
from cuelake.llm.queries import vocabulary  # noqa: E402
from tests.llm.test_operators import ALNUM, DOCS, FOLD, SPACE, brute_classes, edited, sentence, toxic_docs  # noqa: E402


def words(text, pattern):
    return pattern.findall((text or "").encode().translate(FOLD))


def holds(text, item):
    w, i = words(text, ALNUM), words(item, ALNUM)
    n = min(10, len(i))
    windows = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if i else set()
    return any(tuple(w[k : k + n]) in windows for k in range(len(w) - n + 1))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    rows, labels = toxic_docs(500, rng)
    rows = [(k, t, "en", rng.choice(["a", "a", "b", None]), 0) for k, t, *_ in rows]
    item = sentence(rng, 15, 900)
    rows += [(1000 + k, edited(rng, rows[k][1], 1) if len(rows[k][1].split()) > 40 else rows[k][1], "en", "b", 0) for k in range(60)]
    rows += [(2000, f"start {item} end", "en", "a", 0), (2001, None, None, None, None), (2002, "", "en", "a", 0), (2003, sentence(rng, 5000, 10**6), "en", "a", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, item


def test_rows_agree_with_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    path, rows, item = sf_dir
    read = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity_report(read("documents"), read("labels")).collect() if r.predicted}
    left = [r for r in rows if r[0] not in toxic]
    assert len(toxic) > 50
    classes = {i: (n, c) for i, n, c in brute_classes(left, 5, 80, 100)}
    left = [r for r in left if classes[r[0]][0] == 0 or classes[r[0]][1] == r[0]]
    assert any(k >= 1000 for k in classes) and not any(1000 <= r[0] < 1060 and r[0] - 1000 not in toxic and r[1] == rows[r[0] - 1000][1] for r in left)
    left = [r for r in left if not holds(r[1], item)]
    assert 2000 not in {r[0] for r in left}

    docs = read("documents")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, path)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in left)

    mixed = corpus_pipeline.mixed(spark, docs, path).collect()
    sizes = {r[0]: len(words(r[1], SPACE)) for r in left}
    assert sum(len(words(r.text, SPACE)) for r in mixed) == pytest.approx(1.5 * sum(sizes.values()), abs=3)

    got = corpus_pipeline.run(spark, path).orderBy("start").collect()
    tokenizer, start = Tokenizer.from_file(vocabulary()), 0
    ids = sorted((r.doc_id, (*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1)) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((d, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for d, t in ids)
    for r in got:
        assert r.start == start
        start += r.n_tokens


def test_stages_keep_the_columns(spark, sf_dir):
    path, *_ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    assert corpus_pipeline.tokens(spark, docs, path).count() == 0


def test_rows_that_are_odd(spark, tmp_path):
    """Null and repeated ids, repeated rows, very long texts and columns that clash with the stages' own."""
    rng = random.Random(5)
    long, other = sentence(rng, 30_000, 10**6), sentence(rng, 40, 10**6)
    rows = [(None, other), (None, other), (None, sentence(rng, 40, 10**6)), (3, long), (3, long), (3, sentence(rng, 50, 10**6)), (4, None), (4, ""), (5, edited(rng, long, 5))]
    rows = [(k, t, "en", "a", 0, 1.5, "x", 2) for k, t in rows]
    spark.createDataFrame(rows, DOCS + ", score double, _h string, _size int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such words in any of these texts at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-3:] == ["score", "_h", "_size"], name
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(left, key=repr) == sorted([(None, rows[0][1]), (None, rows[2][1]), (3, long), (3, rows[5][1]), (4, None), (4, "")], key=repr)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {None, 3} and all(r.n_tokens > 1 for r in got)
