"""Each pipeline stage against a plain version, on the smallest tables with awkward rows added."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from mobilome.llm import quality
from mobilome.storage import materialize
from tests.llm.test_operators_llm import components, plain_fingerprint

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The documents before and after every stage."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    first = docs.filter("text IS NOT NULL").first()
    extra = [(90001, None, None, None, None), (90002, "", "en", None, 0), (90003, first.text + " ", "en", "s", 1), (90004, first.text, "en", "s", 1)]
    now = docs.select(P.COLUMNS).unionByName(spark.createDataFrame(extra, docs.select(P.COLUMNS).schema))
    found = [materialize(now, "test")]
    for _, stage in P.STAGES:
        found.append(materialize(stage(spark, found[-1], D), "test"))
    return found


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_stage(spark, tables):
    scores = quality.quality(tables[0], spark.read.parquet(f"{D}/labels.parquet"))
    want = {r.doc_id for r in scores.filter(F.col("score") >= P.QUALITY).collect()}
    assert set(rows(tables[1])) == want and tables[1].columns == P.COLUMNS and 0 < len(want) < tables[0].count()


def test_exact_stage(tables):
    groups = {}
    for r in tables[1].collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    want = {min(g, key=lambda r: (-len(r.text or ""), r.doc_id)).doc_id for g in groups.values()}
    assert set(rows(tables[2])) == want and tables[2].count() == len(want)


def test_near_stage(tables):
    own = sorted(tables[2].collect(), key=lambda r: r.doc_id)
    prints = [plain_fingerprint(r.text) for r in own]
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = components(len(own), pairs)
    assert set(rows(tables[3])) == {own[i].doc_id for i, c in enumerate(roots) if i == c}


def test_mixing_stage(tables):
    before, after = rows(tables[3]), Counter(r.doc_id for r in tables[4].collect())
    assert set(after) <= set(before) and max(after.values()) <= 2 and tables[4].columns == P.COLUMNS
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in before.items()}
    assert abs(sum(size[i] * n for i, n in after.items()) - 1.5 * sum(size.values())) <= 0.1 * sum(size.values())
    assert all(rows(tables[4])[i].text == before[i].text for i in after)


def test_encoding_stage(tables):
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {i: r.text for i, r in rows(tables[4]).items()}
    for r in tables[5].collect():
        ids = tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert tables[5].count() == tables[4].count()


def test_run_is_all_stages(spark):
    assert P.run(spark, D).count() > 0
    empty = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, D)
        assert empty.count() == 0
        empty = empty if set(P.COLUMNS) <= set(empty.columns) else None


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select(P.COLUMNS)
    found = [r.text for r in docs.filter("length(text) > 400").orderBy("doc_id").limit(4).collect()]
    a, b, c, e = found
    rows = [(1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (3, e), (3, c + " ")]
    given = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    exact = P.exact_stage(spark, given, D)
    assert sorted((str(r.doc_id), r.text) for r in exact.collect()) == sorted([("1", a), ("2", b), ("3", e), ("3", c + " ")])
    near = P.near_stage(spark, given.filter("doc_id IS NULL OR doc_id < 3"), D)
    assert sorted((str(r.doc_id), r.text) for r in near.collect()) == sorted([("1", a), ("2", b), ("None", c)])
    many = spark.createDataFrame([(None if i % 2 else 7, f"{i} {a}", "en", f"s{i % 3}", 1) for i in range(30)], docs.schema)
    plan = Counter({(r.doc_id, r.size): 0 for r in P.mix_sources(many).collect()})
    for r in P.mix_sources(many).collect():
        plan[r.doc_id, r.size] += r.copies
    got = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in P.mixing_stage(spark, many, D).collect())
    assert got == +plan and sum(got.values()) < 60


def test_quality_stage_without_a_model_keeps_all(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for place, labels in (("none", []), ("one-class", [(r.doc_id, 1, 0) for r in docs.select("doc_id").limit(50).collect()])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{place}/labels.parquet")
        assert P.quality_stage(spark, docs, f"{tmp_path}/{place}").count() == docs.count()


def test_stages_pass_clashing_columns_ties_and_long_texts(spark):
    """Names that the operators use inside, rows repeated whole, equal texts under many ids, and one very long text."""
    docs = spark.read.parquet(f"{D}/documents.parquet").select(P.COLUMNS)
    own = [r for r in docs.filter("length(text) > 300").orderBy("doc_id").limit(6).collect()]
    long = "\n".join(r.text for r in own) * 300
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in own for _ in range(2)]
    rows += [(9000 + i, own[0].text, "en", None, 1) for i in range(5)] + [(9100, long, "en", "s", 1), (9101, long + " ", "en", "s", 1)]
    names = ["row", "kept_row", "kept", "fp", "norm", "size", "copies", "h", "low", "score", "label", "key", "node", "component"]
    given = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n}` int" for n in names)]))
    assert P.quality_stage(spark, given, D).columns == P.COLUMNS
    exact = P.exact_stage(spark, given, D)
    assert sorted(r.doc_id for r in exact.collect()) == sorted([*(r.doc_id for r in own), 9101]) and exact.columns == P.COLUMNS
    near = P.near_stage(spark, given, D).collect()
    prints = {i: plain_fingerprint(t) for i, t, *_ in rows}
    ids = sorted(prints)
    roots = components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= 4])
    assert sorted(r.doc_id for r in near) == [ids[i] for i, c in enumerate(roots) if i == c]
    mixed = P.mixing_stage(spark, given, D)
    assert mixed.columns == P.COLUMNS and mixed.count() <= 2 * len(rows)
    assert P.mixing_stage(spark, given, D).exceptAll(mixed).count() == 0
    encoded = P.encoding_stage(spark, given, D)
    assert encoded.count() == len(rows) and encoded.filter("n_tokens <> size(ids)").count() == 0
