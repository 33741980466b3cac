"""Blocking, features, scoring, splits, training and the file formats on small fixtures."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from linkwell.operators import blocking, features, matching, profiling, scoring
from linkwell.operators.normalize import add_phonetic, normalize_entities
from linkwell.operators.ranking import placed
from linkwell.sources import io
from linkwell.streaming.incremental import entity_stream, match_stream

EXT = "entity_id string, name_norm string, name_phonetic string, name_tokens array<string>, country_norm string, postal_code string, address_norm string, address_tokens array<string>, name_script string, business_name string"


@pytest.fixture(scope="module")
def externals(spark):
    rows = [
        ("S2-11", "brisk ferry", "brisk ferry", ["brisk", "ferry"], "us", None, "", [], "latin", "Brisk Ferry"),
        ("S3-22", "kamala bajara", "kamal bajar", ["bajara", "kamala"], "india", None, "", [], "devanagari", "x"),
        ("S2-33", "other firm", "other firm", ["firm", "other"], "us", "75001", "", [], "latin", "Other Firm"),
        ("S3-44", "zeta", "zeta", ["zeta"], "france", None, "", [], "latin", "Zeta"),
        ("S2-55", "copper goods", "copper goods", ["copper", "goods"], "india", None, "copper nashik", ["copper", "nashik"], "latin", "Copper Goods"),
        ("S3-66", "brisk", "brisk", ["brisk"], "", None, "", [], "latin", "Brisk"),
    ]
    return spark.createDataFrame(rows, EXT)


def ask(spark, name="", country="us", postal=None, address=(), script="latin"):
    return spark.createDataFrame([("S1-1", name, name, sorted(set(name.split())), country, postal, " ".join(address), list(address), script, name)], EXT)


def ids(pairs):
    return {r["id"] for r in pairs.collect()}


def test_candidates(spark, externals):
    tokens = blocking.token_index(externals)
    assert ids(blocking.token_candidates(ask(spark, "brisk"), tokens)) == {"S2-11", "S3-66"}
    assert ids(blocking.token_candidates(ask(spark, "brisk", ""), tokens)) == {"S2-11", "S3-66"}
    assert ids(blocking.token_candidates(ask(spark, "brisk"), tokens, cap=0)) == set()
    assert "S3-22" in ids(blocking.phonetic_candidates(ask(spark, "kamal bajar", "india"), blocking.phonetic_index(externals)))
    postal, words = blocking.postal_index(externals), blocking.address_index(externals)
    assert ids(blocking.address_candidates(ask(spark, "q", "us", "75001"), postal, words)) == {"S2-33"}
    assert ids(blocking.address_candidates(ask(spark, "q", "india", None, ["copper", "nashik"]), postal, words)) == {"S2-55"}
    assert ids(blocking.neighbour_candidates(ask(spark, "brisk ferrys"), externals, 0)) == {"S2-33"}


def test_union_country_and_cap(spark, externals):
    s1 = ask(spark, "brisk ferry")
    every = spark.createDataFrame([("S1-1", r["entity_id"]) for r in externals.collect()], "s1 string, id string")
    assert ids(blocking.same_country(every, s1, externals)) == {"S2-11", "S2-33", "S3-66"}
    assert ids(blocking.candidates(s1, externals, k=1)) == {"S2-11"}
    lists = blocking.joined_lists(s1, every.limit(0)).collect()
    assert [(r[0], r[1]) for r in lists] == [("S1-1", "")]


@pytest.fixture(scope="module")
def sides(spark):
    schema = "entity_id string, business_name string, business_address string, country string"
    s1 = [("S1_1", "Brisk Trading LLC", "1 Elm St 75001", "US"), ("S1_2", "Zeta Goods", "Nr Pump", "India"), ("S1_3", "Prime Co", None, "US")]
    ext = [("S2_1", "Brisk Trading LLC", "1 Elm St 75001", "US"), ("S2_2", "Brisk Motors", "9 Oak Rd 10001", "US"), ("S3_1", "Zeta Goods Ltd", "Behind Pump", "India"), ("S3_2", "prime", None, "")]
    return [add_phonetic(normalize_entities(spark.createDataFrame(r, schema))) for r in (s1, ext)]


PAIRS = [("S1_1", "S2_1"), ("S1_1", "S2_2"), ("S1_2", "S3_1"), ("S1_3", "S3_2")]


def test_features(spark, sides):
    pairs = spark.createDataFrame(PAIRS, "source1_entity_id string, candidate_entity_id string")
    got = {(r["source1_entity_id"], r["candidate_entity_id"]): r for r in features.build_features(pairs, *sides).collect()}
    assert set(got) == set(PAIRS)
    a, b, c, d = (got[p] for p in PAIRS)
    assert a["name_exact_raw"] == a["name_exact_norm"] == 1 and a["name_levenshtein_ratio"] == 1.0 and a["name_token_overlap_count"] == 2
    assert a["postal_available"] == a["postal_exact_match"] == 1 and a["candidate_rank_in_group"] == 1 and a["candidate_set_size"] == 2
    assert min(a["name_tfidf_word_cosine"], a["name_tfidf_char_cosine"], a["address_tfidf_word_cosine"]) > 0.99
    assert 0 < b["name_jaccard_tokens"] < 1 and b["postal_available"] == 1 and b["postal_exact_match"] == 0 and b["name_tfidf_word_cosine"] < a["name_tfidf_word_cosine"]
    assert c["landmark_flag_either"] == 1 and c["source_flag"] == "S3" and c["candidate_source_id"] == 1 and c["name_exact_norm"] == 1
    assert d["country_match"] == 1 and d["postal_available"] == 0 and d["top1_gap"] == pytest.approx(0.7)
    lists = spark.createDataFrame([("S1_1", " S2_1,, S2_2 "), ("S1_2", "")], "source1_entity_id string, candidate_entity_ids string")
    assert sorted(r[1] for r in features.explode_candidates(lists).collect()) == ["S2_1", "S2_2"]
    with pytest.raises(ValueError):
        features.explode_candidates(lists.select("source1_entity_id"))


def test_scores(spark):
    truth = spark.createDataFrame([("A", "x,y,z"), ("B", ""), ("C", "p"), ("D", "q")], "source1_entity_id string, matched_entity_ids string")
    pred = spark.createDataFrame([("A", "x, y ,w"), ("B", "nan"), ("C", "p"), ("D", "")], "source1_entity_id string, matched_entity_ids string")
    got = {r["source1_entity_id"]: r["f_beta"] for r in scoring.entity_scores(pred, truth).collect()}
    assert got == {"A": pytest.approx(2 / 3), "B": 1.0, "C": 1.0, "D": 0.0}
    assert scoring.macro_scores(scoring.entity_scores(pred, truth)).first()["macro_f_beta"] == pytest.approx(0.666667)
    with pytest.raises(PySparkException):
        scoring.entity_scores(pred.filter("source1_entity_id <> 'A'"), truth).collect()
    assert [tuple(r) for r in scoring.subset_violations(pred, truth.withColumnRenamed("matched_entity_ids", "candidate_entity_ids")).collect()] == [("A", "w")]


def test_split(spark, tmp_path):
    s1 = spark.createDataFrame([(f"S1-{i}",) for i in range(100)], "entity_id string")
    truth = spark.createDataFrame([(f"S1-{i}", "" if i < 10 else "a" if i < 30 else "a,b,c") for i in range(100)], "source1_entity_id string, matched_entity_ids string")
    parts = scoring.split(s1, truth)
    counts = {(r["stratum"], r["split"]): r["count"] for r in parts.groupBy("stratum", "split").count().collect()}
    assert counts == {(0, "val"): 2, (0, "train"): 8, (1, "val"): 4, (1, "train"): 16, (2, "val"): 14, (2, "train"): 56}
    assert scoring.split(s1, truth).exceptAll(parts).count() == 0
    io.write_splits(parts, str(tmp_path))
    train, val = io.read_splits(spark, str(tmp_path))
    assert (train.count(), val.count()) == (80, 20)
    with pytest.raises(ValueError):
        scoring.split(s1, truth, 1.0)


def test_training_and_sweep(spark, tmp_path):
    rows = [(f"A{i}", f"C{i}", int(i < 2), int(i < 5), i % 7 / 7, i / 20) for i in range(20)]
    frame = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, is_true_match int, is_exact_tier int, f1 double, f2 double")
    assert matching.training_sample(frame, ratio=5).count() == 2 + 3 + 7
    with pytest.raises(ValueError):
        matching.training_sample(frame.filter("is_true_match = 0"))
    model = matching.train(frame, ["f1", "f2"], maxIter=2, minInstancesPerNode=1)
    model.write().overwrite().save(f"{tmp_path}/model")
    again = matching.predict(matching.load(f"{tmp_path}/model"), frame).select("match_probability").collect()
    assert again == matching.predict(model, frame).select("match_probability").collect()
    assert matching.predict(model, frame).filter("match_probability between 0 and 1").count() == 20
    assert len(matching.importance(model, ["f1", "f2"])) == 2
    scored = spark.createDataFrame([("A", "C1", 0.85), ("A", "C2", 0.65), ("A", "C3", 0.2), ("B", "C4", 0.4)], "source1_entity_id string, candidate_entity_id string, match_probability float")
    everyone = spark.createDataFrame([("A",), ("B",), ("C",)], "source1_entity_id string")
    for threshold, mode, want in ((0.5, "multi", "C1,C2"), (0.5, "top1", "C1"), (0.9, "multi", "")):
        assert {r[0]: r[1] for r in matching.assemble(scored, threshold, mode, everyone).collect()} == {"A": want, "B": "", "C": ""}
    with pytest.raises(ValueError):
        matching.assemble(scored, mode="other")
    truth = spark.createDataFrame([("A", "C1"), ("B", "")], "source1_entity_id string, matched_entity_ids string")
    table = matching.sweep(scored, truth)
    assert table.count() == 19 and matching.best(table).first()["macro_f_beta"] == 1.0
    assert matching.best_of_modes(scored, truth).first()["mode"] == "multi"
    assert scoring.empty_baseline(truth).first()["macro_f_beta"] == 0.5
    assert matching.shuffled(frame).count() == 20


def test_profiles(spark):
    frame = spark.createDataFrame([("a", "one two", 0.2), ("b", None, 0.7), ("c", "x", 0.9)], "entity_id string, t string, v double")
    assert profiling.null_counts(frame).first()["t"] == 1
    stats = profiling.field_stats(frame, "t").first()
    assert stats["max_tokens"] == 2 and stats["min_chars"] == 0
    assert profiling.distribution(frame, "v").first()["below_30"] == pytest.approx(1 / 3)
    assert profiling.draw(frame, "entity_id", 2).count() == 2 and profiling.bottom(frame, "v", "entity_id", 1).first()["entity_id"] == "a"
    assert profiling.numeric_summary(frame, ["v"]).first()["mean"] == pytest.approx(0.6)
    assert profiling.pair_metrics(frame, "t", "t").first()["sequence_ratio"] == 1.0
    assert profiling.histogram(frame, "v", 0, 1, 10).count() == 3
    truth = spark.createDataFrame([("S1-1", "a,zz"), ("S1-2", "b,zz")], "source1_entity_id string, matched_entity_ids string")
    assert [r[0] for r in profiling.orphans(truth, frame).collect()] == ["zz"]
    gains = spark.createDataFrame([("p", 0.1, 0.9), ("q", 0.5, 0.6), ("r", 0.9, 0.2)], "k string, x double, y double")
    assert [r["k"] for r in profiling.top_gains(gains, "x", "y", "k", 2).collect()] == ["p", "q"]
    scripts = spark.createDataFrame([("latin", "tamil"), ("latin", "latin"), ("latin", "unknown")], "s1_name_script string, cand_name_script string")
    assert profiling.cross_script(scripts).count() == 1


def test_files_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("S1-1", "N A", None, "US"), ("S1-2", "B", "", "")], io.ENTITY)
    io.write_tsv(rows, f"{tmp_path}/in")
    back = {r["entity_id"]: r for r in io.read_tsv(spark, f"{tmp_path}/in", io.ENTITY, blank=True).collect()}
    assert back["S1-1"]["business_address"] == "" and back["S1-2"]["country"] == ""
    matches = spark.createDataFrame([("S1-1", "")], io.TRUTH)
    io.write_tsv(matches.coalesce(1), f"{tmp_path}/out")
    assert io.header_matches(spark, f"{tmp_path}/out", "matching") and not io.header_matches(spark, f"{tmp_path}/out", "candidates")
    for batch in (["S1-3", "S1-2"], ["S1-9", "S1-4"]):
        io.append_tsv(spark.createDataFrame([(b, "x,y") for b in batch], io.TRUTH).repartition(2), f"{tmp_path}/all.tsv", "source1_entity_id")
    with open(f"{tmp_path}/all.tsv") as file:
        assert file.read().split("\n") == ["source1_entity_id\tmatched_entity_ids", "S1-2\tx,y", "S1-3\tx,y", "S1-4\tx,y", "S1-9\tx,y", ""]
    assert io.header_matches(spark, f"{tmp_path}/all.tsv", "matching")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert "S1-1\t" in lines
    query = match_stream(entity_stream(spark, f"{tmp_path}/in"), lambda b: b.select("entity_id"), f"{tmp_path}/stream", f"{tmp_path}/state")
    query.awaitTermination()
    assert {r["entity_id"] for r in spark.read.parquet(f"{tmp_path}/stream").collect()} == {"S1-1", "S1-2"}
    assert io.report("T", rows.select("entity_id")).count("\n") == 6


def test_places_and_ranges(spark):
    rows = spark.range(5000).selectExpr("concat('k', id) AS k", "CAST(id % 2 AS STRING) AS g").repartition(3)
    got = placed(rows, "g", matching.hash_order(1, "k"), "k")
    want = rows.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy(matching.hash_order(1, "k"), "k")))
    assert got.join(want, ["k", "g"]).filter("__place = want").count() == 5000
    assert placed(rows.limit(0), "g", matching.hash_order(1, "k"), "k").count() == 0
    names = spark.range(300).selectExpr("concat('S2-', id) AS entity_id", "concat('n', lpad(id % 100, 3, '0')) AS name_norm", "'us' AS country_norm")
    found = ids(blocking.neighbour_candidates(ask(spark, "n050a"), names, 2))
    listed = sorted((r["name_norm"], r["entity_id"]) for r in names.collect())
    at = sum(n <= "n050a" for n, _ in listed)
    assert found == {i for _, i in listed[at - 2 : at + 3]}
