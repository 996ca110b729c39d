"""The pipeline's stages, one by one and together, on a small table."""

import random

import pytest

import corpus_pipeline
from treequill.llm import mixing, pieces


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("the", "stone", "river", "home", "walk", "ever", "light") for b in ("", "s", "ing", "ly", "ed", "er")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    docs, labels = [], []
    for i in range(240):
        bad = i % 4 == 3
        text = " ".join(w.upper() + "!!" for w in prose(40).split()) if bad else prose(rng.randrange(40, 120))
        if i % 16 == 4:
            text = prose(30) + "\n" + passage + "\n" + prose(30)
        if i % 16 == 8 and i > 20:
            text = docs[i - 16][1]
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(not bad), 0))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.good_quality(spark, docs, folder).cache()
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == columns
    assert all(i % 4 != 3 for i in ids) and len(ids) > 170
    single = corpus_pipeline.one_of_each_group(spark, good, folder).cache()
    left = {r.doc_id for r in single.collect()}
    assert single.columns == columns and len(left) == single.count()
    texts = {r.doc_id: r.text for r in good.collect()}
    assert {texts[i] for i in left} == set(texts.values())
    assert left == {min(j for j in texts if texts[j] == texts[i]) for i in texts}
    cleaned = corpus_pipeline.without_repeats(spark, single, folder).cache()
    rows = {r.doc_id: r for r in cleaned.collect()}
    assert cleaned.columns == columns and set(rows) == left
    holders = sorted(i for i in left if i % 16 == 4)
    assert all(rows[i].text == texts[i] for i in left if i % 16 != 4)
    assert rows[holders[0]].text == texts[holders[0]]
    # Words beside the passage may agree by chance, and then go with it.
    assert all(55 <= len(rows[i].text.split()) <= 60 for i in holders[1:])
    assert all(r.n_chars == len(r.text) for r in rows.values())
    mixed = corpus_pipeline.mixed(spark, cleaned, folder)
    assert mixed.columns == columns and sorted(mixed.collect()) == sorted(cleaned.collect())
    out = corpus_pipeline.tokens(spark, mixed, folder).collect()
    _, decoder = pieces.machines(pieces.read_model(pieces.MODEL_PATH))
    assert {r.doc_id: decoder.decode(r.ids) for r in out} == {i: r.text for i, r in rows.items()}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 100 and out.where("not round_trip").count() == 0


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_and_repeated_rows(spark, tmp_path):
    rows = [(1, "plain words of a text that repeat nowhere", None, None, None)] * 2 + [(None, None, "en", "src0", 3), (2, "", "en", None, 0), (3, None, None, "src1", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == [1, 2]


def test_clashing_columns(spark, folder):
    """Columns named like the operators' own neither break a stage nor change."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["_id", "label", "_slot", "_row", "slot", "keep_0", "rep", "n", "score"]
    odd = docs.selectExpr("*", *[f"doc_id * {i} as `{n}`" for i, n in enumerate(names, 2)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns
        bad = " or ".join(f"`{n}` <> doc_id * {i}" for i, n in enumerate(names, 2))
        assert out.where(bad).count() == 0 and out.count() > 0


def test_the_mix_reaches_the_result(spark, tmp_path):
    """Every prefix of the result in order of (slot, block_row) keeps the targets while a source has rows, whatever file a row is read from."""
    rng = random.Random(7)
    docs = [(i, f"text {rng.random()} of {i}", "en", "src0" if i % 8 else f"src{1 + i // 8 % 2}", 1) for i in range(1200)]
    docs += [(None, "a row without a key", "en", None, 1), (5000, "one", "en", "src1", 1), (5000, "another", "en", "src1", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mixed(spark, frame, "").repartition(5).write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.tokens(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    _, decoder = pieces.machines(pieces.read_model(pieces.MODEL_PATH))
    source = {text: s for _, text, _, s, _ in docs}
    assert sorted(decoder.decode(r.ids) for r in out) == sorted(source)
    assert len({(r.slot, r.block_row) for r in out}) == len(docs)
    placed = mixing.mix(frame).collect()
    assert sorted((r.slot, r.block_row, source[decoder.decode(r.ids)] or "") for r in out) == sorted((r.slot, r.block_row, r.source or "") for r in placed)
    quota = mixing.quotas(mixing.TARGETS)
    for lane in ("src0", "src1", "src2"):
        slots = [r.slot for r in out if source[decoder.decode(r.ids)] == lane]
        for end in range(1, max(slots) + 2):
            due = end * quota[lane] * mixing.BLOCK_ROWS / mixing.PERIOD
            assert due > len(slots) or abs(sum(s < end for s in slots) - due) < mixing.BLOCK_ROWS


def test_run_gives_places(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert len({(r.slot, r.block_row) for r in out}) == len(out) and None not in {r.slot for r in out}
