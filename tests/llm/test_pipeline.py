import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from collections import Counter, defaultdict  # noqa: E402

from test_near_copies import brute  # noqa: E402

from tessera.llm import exact_dedup, mixing, packing  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    bad = ["scoundrel", "nitwit", "rascal"]
    rows, labels = [], []
    for i in range(150):
        words = [f"{'abcdefghij'[(i * 7 + k) % 10]}{'aeiou'[(i + k * k) % 5]}n{'lmnop'[(i * k) % 5]}" for k in range(40 + i % 20)]
        toxic = i % 5 == 0
        if toxic:
            words[3::8] = [bad[(i + k) % 3] for k in range(len(words[3::8]))]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", None))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1].upper(), "en", "s1", None) for i in range(1, 30)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_each_stage_takes_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    clean = stages["toxicity"](spark, docs, tables)
    assert clean.columns == columns
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    assert sum(i in kept for i in range(150) if i % 5) >= 115 and sum(i in kept for i in range(0, 150, 5)) <= 2
    clean = clean.cache()
    once = stages["exact_dedup"](spark, clean, tables)
    want = {r.doc_id for r in exact_dedup.exact_duplicates(clean).filter("kept").collect()}
    assert once.columns == columns and {r.doc_id for r in once.collect()} == want
    once = once.cache()
    near = stages["simhash_near_dedup"](spark, once, tables)
    want = brute([(r.doc_id, r.text) for r in once.collect()])
    assert near.columns == columns and sorted(r.doc_id for r in near.collect()) == want
    near = near.cache()
    mix = stages["mix_sources"](spark, near, tables)
    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert mix.columns == columns and Counter(r.doc_id for r in mix.collect()) == Counter({k: n for k, n in copies.items() if n})
    mix = mix.cache()
    packed = stages["best_fit_packing"](spark, mix, tables).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mix.collect())
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.LENGTH


def test_run_and_empty(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 0
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_as_agreed():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
