from __future__ import annotations

import random
import string
from fractions import Fraction

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_ngram_join import brute as grouped


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(-1, "1234", None, None, None), (-2, None, "en", None, None)], docs.schema)
    docs = docs.union(odd)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard", "decontaminate", "pack"]

    kept = corpus_pipeline.identify_language(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {-1, -2}

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    wanted = {d for d, _, c in grouped(rows, 5, Fraction(8, 10)) if d == c}
    unique = corpus_pipeline.join_near_duplicates(spark, kept, DATA)
    assert {r.doc_id for r in unique.collect()} == wanted and wanted < {d for d, _ in rows}

    texts = {r.doc_id: r.text for r in unique.collect()}
    clean = corpus_pipeline.remove_benchmarks(spark, unique, DATA)
    assert {r.doc_id for r in clean.collect()} == {d for d, t in texts.items() if not contaminated(t, items)[1]}

    packed = corpus_pipeline.pack_sequences(spark, clean, DATA)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


def test_run(spark):
    found = corpus_pipeline.run(spark, DATA)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.count() > 0


UNLEARNED = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
    "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
]


def test_unlearned_languages_and_junk_are_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(1)
    junk = ["".join(rng.choice(string.ascii_lowercase) for _ in range(600)), "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(600)), "x=[(i,j)for i in q if f(i)>>3];" * 15]
    planted = [(-1 - k, t * 3, None, None, None) for k, t in enumerate([*UNLEARNED, *junk])]
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.union(spark.createDataFrame(planted, docs.schema)), DATA).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_lettered_documents_stay_where_nothing_is_labelled(spark):
    docs = spark.createDataFrame([(1, "text"), (2, "12"), (3, None), (4, "é")], "doc_id long, text string").selectExpr("*", "string(null) as lang")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, DATA).collect()} == {1, 4}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_stages_with_repeats_ties_and_clashing_columns(spark):
    """Rows that repeat go or stay alike, of equal texts the smallest id stays, and columns of any name come through."""
    read = spark.read.parquet(f"{DATA}/documents.parquet")
    few = read.where("doc_id < 80")
    again = few.where("doc_id % 9 = 0")
    tied = few.where("doc_id % 7 = 0 and length(text) > 100").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars")
    names = ["node", "label", "key", "rep", "copies", "payload", "score", "lang_pred", "n_hit", "items", "spans", "piece", "start", "length", "batch", "component_id"]
    docs = few.union(again).union(tied).selectExpr("*", *[f"'{n}' as {n}" for n in names])
    twice = {r.doc_id for r in again.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, now, DATA)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert all(r[n] == n for r in rows for n in names)
        ids = [r.doc_id for r in rows]
        assert all(ids.count(i) == 1 + (i in twice) for i in set(ids)), name
        now = spark.createDataFrame(rows, docs.schema)
    texts = {r.doc_id: r.text for r in docs.collect()}
    wanted = {d for d, _, c in grouped(sorted(texts.items()), 5, Fraction(8, 10)) if d == c}
    assert all(d < 1000 for d in wanted)
    assert {r.doc_id for r in now.collect()} == {d for d in wanted if not contaminated(texts[d], items)[1]}

    packed = corpus_pipeline.pack_sequences(spark, now, DATA)
    assert packed.where("piece = 0").count() == now.count()
