"""Small cases and brute force for the operators on training data."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hyperspark.llm import code_lines, cooccur, knn, language, mixing, queries, reading, splits, subjects, truncation
from hyperspark.plans.runtime import table


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- splits


def test_file_key_names_the_same_file():
    same = ["a dir/B%20c.txt", "./A Dir/b c.TXT", "a dir\\b c.txt", "a dir//b c.txt?rev=3", "a dir/b c.txt#p=2", " a dir/b c.txt ", "a dir/x/../b c.txt", "file://a dir/b c.txt"]
    assert {splits.file_key(x) for x in same} == {"a dir/b c.txt"}
    assert splits.file_key("geología/x") == splits.file_key("geología/x")
    assert {splits.file_key(x) for x in (None, "", "  ", "-", "N/A", "unknown", "stdin")} == {None}
    assert splits.file_key("a/c.txt") != splits.file_key("b/c.txt")


SAMPLES = "sample_id long, doc_id string, source string, domain string, extra string"
TARGETS = "split_name string, target_share double"


def test_ties_match_union_find_with_a_hot_source(spark):
    rng = random.Random(3)
    data = [(i, f"d{rng.randrange(300):03d}", rng.choice(["hot/x", None, "-", *(f"s/{rng.randrange(400)}" for _ in range(4))]) if i % 3 else "hot/x" if i % 2 else f"s/{rng.randrange(400)}", rng.choice("abc"), "z") for i in range(900)]
    data += [(5000, None, "s/1", "a", None), (5001, None, None, None, None), (5001, None, None, None, None)]
    made = splits.split_records(spark.createDataFrame(data, SAMPLES), spark.createDataFrame([("train", 0.8), ("test", 0.2)], TARGETS), steps=200)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, d, s, *_ in data:
        if d is not None:
            find(("d", d))
            if splits.file_key(s):
                parent[find(("d", d))] = find(("s", splits.file_key(s)))
    groups = defaultdict(list)
    for kind, d in list(parent):
        if kind == "d":
            groups[find((kind, d))].append(d)
    want = sorted((d, min(g)) for g in groups.values() for d in g)
    found = made.ids.collect()
    assert sorted((r["id"], r["group"]) for r in found) == want
    by_group = defaultdict(set)
    for r in found:
        by_group[r["group"]].add(r["split_name"])
    assert all(len(x) == 1 and None not in x for x in by_group.values())
    assert sum(r["n_records"] for r in made.shares.collect()) == 902


def test_splits_come_near_their_shares_and_beat_hashing(spark):
    data = [(i, f"d{i % 700}", f"s/{(i % 700) // 5}", f"k{i % 4}", None) for i in range(7000)]
    made = splits.split_records(spark.createDataFrame(data, SAMPLES), spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], TARGETS))
    for r in made.shares.collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.01
    off = [(abs(r["actual_share"] - r["target_share"]), abs(r["hashed_share"] - r["target_share"])) for r in made.shares.collect()]
    assert sum(a for a, _ in off) <= sum(b for _, b in off)


def test_splits_of_an_empty_table(spark):
    made = splits.split_records(spark.createDataFrame([], SAMPLES), spark.createDataFrame([("train", 1.0)], TARGETS))
    assert made.ids.count() == 0 and made.shares.count() == 1


# --- truncation


def test_truncation_cases(spark):
    whole = ["The market depends on the price of bread.", "The coin stands near the old market.", "We compared the market with the shop and wrote down the results."]
    data, n = [], 0
    for i in range(60):
        for text in whole:
            n += 1
            data.append((n, text, f"d{i}", "x"))
    full = "The market depends on the price of bread and the coin stands near the old market of the town."
    cases = {
        1001: (None, False), 1002: ("  ", False), 1003: (whole[0], False), 1004: ("The market depends on the price of bre�", True), 1005: ("The coin stands near the (", True),
        1006: ("The coin stands near the old market", False), 1007: ("We compared the market with", True), 1008: ("We compared the mar", True), 1009: ("market versus coin", False), 1010: ("The coin stands near &am", True), 1011: ("The market depends on the price of bread…", False),
    }
    data += [(k, v, None, "y") for k, (v, _) in cases.items()] + [(1004, cases[1004][0], None, "y")]
    data += [(2001, "The market depends on the price of bread", "doc1", "y"), (2002, "The market depends on the price of bread", "doc2", "y")]
    df = spark.createDataFrame(data, "sample_id long, query string, doc_id string, key string")
    corpus = spark.createDataFrame([("doc1", full, 1), ("doc2", whole[0], 1), (None, None, 1), ("doc3", "", 1)], "doc_id string, plain_text string, q int")
    found = dict(rows(truncation.truncated(df, corpus)))
    assert {k: found[k] for k in cases} == {k: v for k, (_, v) in cases.items()}
    assert found[2001] and not found[2002]
    assert not any(found[i] for i in range(1, n + 1))
    assert truncation.truncated(df.limit(0), corpus).count() == 0
    shares = {r["key"]: r for r in truncation.damage_by_source(df, corpus, source="key").collect()}
    assert shares["x"]["share"] == 0.0 and shares["y"]["n_damaged"] == 6


def test_documents_of_many_texts_are_looked_into(spark):
    cut_off = "The market depends on the price of bread"
    full = f"{cut_off} and the coin stands near the old market of the town."
    data = [(1, cut_off, "many"), (2, cut_off, "copies"), (3, cut_off, "none"), (4, cut_off, "both")]
    data += [(100 + i, f"{cut_off}.", None) for i in range(600)]  # elsewhere such a text is whole
    texts = [("many", f"Text {i} is about another thing.") for i in range(100)] + [("many", full)]
    texts += [("copies", full)] * 80 + [("none", "Nothing of it.")] + [("both", f"Text {i} of both.") for i in range(70)] + [("both", full), ("both", f"{cut_off}.")]
    records = spark.createDataFrame(data, "sample_id long, query string, doc_id string")
    corpus = spark.createDataFrame(texts, "doc_id string, plain_text string")
    found = dict(rows(truncation.truncated(records, corpus)))
    assert {k: found[k] for k in range(1, 5)} == {1: True, 2: True, 3: False, 4: False}


def test_endings_of_more_words_than_the_first_table_of_words_holds():
    n = 5000
    texts = [f"alpha{i} beta{i}" for i in range(n)]
    made = list(truncation._tails(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], ["key", "core"])])))[0].to_pylist()
    last = {r["key"]: r["h"] for r in made if r["rank"] == 1}
    assert last == {i: int(np.uint64(truncation._word_id(f"beta{i}")).view(np.int64)) for i in range(n)}
    assert list(truncation._tails(iter([pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], ["key", "core"])])))[0].num_rows == 0


def test_hidden_limit_in_bytes(spark):
    rng = random.Random(1)
    words = ["casa", "perro", "niño", "árbol", "camión", "mesa", "libro"]
    data = []
    for i in range(600):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40)))
        data.append((i, text.encode()[:96].decode(errors="ignore") if i % 2 else text))
    found = truncation.hidden_limits(spark.createDataFrame(data, "key long, q string").withColumn("shape", F.lit("open")))
    assert ("utf8", 96) in {(r["form"], r["length"]) for r in found.collect()}


def test_limits_belong_to_sources(spark):
    rng = random.Random(2)
    words = ["market", "shop", "coin", "price", "bread", "town", "stands", "near", "under", "wheel"]
    data, texts = [], {}
    for source in range(40):
        for i in range(20):
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(6, 30))).capitalize() + "."
            if source % 4 == 0:  # a quarter of the sources cut at 80 characters after escaping
                while len(text.replace("&", "&amp;")) > 80:
                    text = text[:-1]
            data.append((len(data), text, f"s/{source}.txt" if source else None))
    # One source alone stops at 70, in a tenth of its 300 texts; another has no limit but a whole text of 80 characters.
    data += [(5000 + i, (" ".join(rng.choice(words) for _ in range(30)) if i % 10 == 0 else "The coin stands near the market.")[:70], "own.txt") for i in range(300)]
    df = spark.createDataFrame(data, "sample_id long, query string, source string").withColumn("doc_id", F.lit(None).cast("string")).withColumn("form", F.lit("x"))
    made = truncation.judge(df)
    limits = {(r["file"], r["length"]) for r in made.limits.where("form = 'chars'").collect()}
    assert {(f"s/{x}.txt", 80) for x in range(4, 40, 4)} <= limits and ("own.txt", 70) in limits
    assert not any(f == f"s/{x}.txt" for f, _ in limits for x in range(40) if x % 4)
    assert {r["evidence"] for r in made.verdicts.where("damaged").collect()} >= {"limit"}
    by = {r["source"]: r for r in truncation.damage_by_source(df, None).collect()}
    assert by["s/4.txt"]["limit_length"] == 80 and by["s/4.txt"]["n_damaged"] > 5 and by["s/5.txt"]["limit_length"] is None and by["own.txt"]["n_damaged"] >= 25  # a cut that falls on a blank is one shorter


# --- language


def test_language_accuracy_and_cases(spark, sf):
    t = lambda name: table(spark, sf, name)
    codes, names, code = language.language_names(t("languages"))
    field = language.train_on(t("samples").select(F.col("query").alias("text"), "lang"), None, names, len(codes), code)
    texts = [
        (1, "c", "The book explains why the old house is useful.\nLa comparación de los casos indica que la roca precede en el tiempo.", "LANG_ENGLISH"),
        (2, "c", "for (int i = 0; i < n; i++) { total += buf[i]; }", "code"), (3, "c", None, "en"), (4, "c", "   ", "en"), (5, "c", "The team compared the cloud with the river and wrote down the results.", "und"),
        (5, "c", "The team compared the cloud with the river and wrote down the results.", "und"), (6, "c", "in class we compared the rock with the salt and wrote down the results " * 300, "EN "), (7, "c", "!!! 123 ...", "en"),
    ]
    found = language.segments(spark.createDataFrame(texts, "record_id long, record_kind string, text string, stated string"), field, codes, names).distinct().collect()
    langs = defaultdict(set)
    for r in found:
        langs[r["record_id"], r["line_no"]].add(r["lang_code"])
        assert 0 <= r["confidence"] <= 1.0001
    assert langs[1, 1] == {"LANG_ENGLISH"} and langs[1, 2] == {"LANG_SPANISH"} and langs[2, 1] == {"LANG_CODE"} and langs[6, 1] == {"LANG_ENGLISH"}
    assert {r["record_id"] for r in found} - {7} == {1, 2, 5, 6}
    flags = {r["record_id"]: r["doubtful"] for r in found}
    assert flags[1] and flags[5] and not flags[2] and not flags[6]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    field = language.Field(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=(3, 3)))
    scores = rng.normal(size=(1, 5, 3))
    breaks = np.array([[True, False, True, False, False]])
    post = language._forward_backward(language._emissions(scores), breaks, np.array([5]), field)[0]
    want = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        value = sum(scores[0, t, path[t]] for t in range(5)) + sum((field.at_break if breaks[0, t] else field.within)[path[t - 1], path[t]] for t in range(1, 5))
        for t in range(5):
            want[t, path[t]] += np.exp(value)
    assert np.allclose(post, want / want.sum(1, keepdims=True), atol=1e-6)


# --- co-occurrence


def test_pairs_match_brute_force(spark, sf):
    baskets = defaultdict(set)
    for r in pq.read_table(f"{sf}/samples.parquet").to_pylist():
        for x in (r["concepts"] or []) + (r["keywords"] or []):
            x = " ".join((x or "").lower().replace("-", " ").replace("_", " ").split())
            if x:
                baskets[r["sample_id"]].add(x)
    single, pairs = Counter(), Counter()
    for items in baskets.values():
        single.update(items)
        pairs.update(itertools.combinations(sorted(items), 2))
    found = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n_baskets"]) for r in cooccur.pair_counts(table(spark, sf, "samples")).collect()}
    assert found == {(a, b): (n, single[a], single[b], len(baskets)) for (a, b), n in pairs.items()}
    few = {(r["item_a"], r["item_b"]) for r in cooccur.pair_counts(table(spark, sf, "samples"), min_together=3, min_lift=10.0).collect()}
    assert few == {(a, b) for (a, b), n in pairs.items() if n >= 3 and n * len(baskets) >= 10 * single[a] * single[b]}


def test_pairs_of_odd_baskets(spark):
    data = [(1, ["A", "b-c", None, ""], ["B c", "a"]), (1, ["a"], None), (2, None, None), (None, ["a", "q"], []), (3, [f"i{k}" for k in range(300)], [])]
    df = spark.createDataFrame(data, "sample_id long, concepts array<string>, keywords array<string>")
    found = cooccur.pair_counts(df).collect()
    assert len(found) == 1 + 300 * 299 // 2
    assert [(r["n_ab"], r["n_baskets"], r["lift"]) for r in found if r["item_a"] == "a"] == [(1, 2, 2.0)]
    assert cooccur.pair_counts(df.limit(0)).count() == 0 and cooccur.pair_counts(df.limit(0), min_together=2, min_lift=3.0).count() == 0


# --- subjects


def test_subjects_agree_with_labels(spark, sf):
    found = subjects.subject_shares(table(spark, sf, "conversions"), table(spark, sf, "domains"), table(spark, sf, "subject_labels")).collect()
    by = defaultdict(float)
    for r in found:
        by[r["conv_id"]] += r["share"]
        assert 0 < r["share"] <= 1
    assert all(abs(x - 1) < 1e-4 for x in by.values())


def test_subject_edge_cases(spark):
    about = spark.createDataFrame([("code", "software"), ("law", "courts"), (None, None)], "subject string, description string")
    data = [(i, f"The judge read the contract {i}. The court and the judge wait." if i % 2 else "The program has a bug. The compiler reads the program.", "law" if i % 2 else "Code ") for i in range(40)]
    data += [(100, None, "law"), (101, "", "law"), (102, "  ", None), (103, "for (i = 0; i < n; i++) { x(); }\nThe judge read the contract.", None), (104, "The judge and the court. " * 4000, "code"), (0, data[0][1], data[0][2])]
    df = spark.createDataFrame(data, "conv_id long, plain_text string, domain_detected string")
    found = defaultdict(dict)
    for r in subjects.subject_shares(df, about).collect():
        found[r["conv_id"]][r["subject"]] = r["share"]
    assert found[1] == {"law": 1.0} and found[2] == {"code": 1.0} and found[103] == {"code": 0.5, "law": 0.5} and found[104] == {"law": 1.0}
    assert not {100, 101, 102} & set(found)
    assert subjects.subject_shares(df.limit(0), about).count() == 0


# --- nearest vectors


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 5, 384))
    return centres[rng.integers(len(centres), size=n)] + 0.4 * rng.normal(size=(n, 384))


def test_lines_of_code_are_learned_from_all_texts(spark):
    # Each text has words of its own that only its own lines tell to be code.
    n = 2600
    texts = ["Der alte Baum steht dort.\n\n12\n" + f"The cat sat on mat {'abc'[i % 3]}.\n" * 20 + f"w{'abcdefghij'[i % 10]}x{chr(97 + i // 10 % 26)}{chr(97 + i // 260)}q ( ) ;\n" * 8 + f"w{'abcdefghij'[i % 10]}x{chr(97 + i // 10 % 26)}{chr(97 + i // 260)}q" for i in range(n)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "conv_id long, plain_text string, domain_detected string")
    found = rows(subjects.subject_shares(df, spark.createDataFrame([("code",), ("law",)], "subject string")).where("subject = 'code'").select("conv_id", "n_sentences", "share"))
    assert len(found) == n and {round(r[1] * r[2]) for r in found} == {9}

    some = texts[:40] + ["for (i = 0; i < n; i++) { total += i }\nIt rains. It pours!", "", "日本語の文。\nx = [1]"]
    read = spark.createDataFrame([(i, t, t) for i, t in enumerate(some)], "key long, stated string, text string").mapInArrow(subjects._read, "key bigint, stated string, n_words bigint, terms array<int>, ends array<int>, lines array<int>")
    odds, prior = subjects.learn_code_of_all(read.select("key", "n_words", "terms", "ends", F.array(F.lit(0.0)).alias("seeds"), "lines"))
    want, prior_wanted = code_lines.learn_code(some)
    assert len(want) > 60 and abs(prior - prior_wanted) < 1e-3
    assert all(abs(odds[subjects.number_of(t)] - x) < 1e-3 for t, x in want.items())


def test_nearest_recall_against_brute_force(spark):
    x = clustered(3000).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], "id long, vec array<float>, views array<array<float>>")
    found = defaultdict(set)
    for r in knn.nearest(df, k=5, part_rows=200).collect():
        found[r["id"]].add(r["neighbour"])
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = knn.exact_nearest(np.arange(3000), units, np.arange(0, 3000, 20), 5)
    # Neighbours that aren't of the cluster are noise around 0; those of the cluster must be found.
    hits = [j in found[q] for q, near in want.items() for j, s in near if s >= 0.5]
    assert len(hits) > 200 and np.mean(hits) >= 0.9


def test_nearest_of_many_cells(spark):
    x = clustered(3000, seed=5).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], "id long, vec array<float>, views array<array<float>>")
    found = defaultdict(set)
    for r in knn.nearest(df, k=5, part_rows=25, sample_rows=1000).collect():  # 11 parts of 11 cells
        found[r["id"]].add(r["neighbour"])
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = knn.exact_nearest(np.arange(3000), units, np.arange(0, 3000, 20), 5)
    hits = [j in found[q] for q, near in want.items() for j, s in near if s >= 0.7]
    assert len(hits) > 200 and np.mean(hits) >= 0.95


def test_nearest_of_large_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    # A dense family of unlike vectors and others; the bound of a task's rows is lowered far below a part's.
    x = np.concatenate([rng.normal(size=384) + rng.normal(size=(3000, 384)), rng.normal(size=(1000, 384))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], "id long, vec array<float>, views array<array<float>>")
    monkeypatch.setattr(knn, "TASK_ROWS", 90)
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = knn.exact_nearest(np.arange(4000), units, np.arange(0, 3000, 15), 5)
    for part_rows, least in ((4000, 1.0), (1000, 0.9)):
        found = defaultdict(set)
        for r in knn.nearest(df, k=5, part_rows=part_rows).collect():
            found[r["id"]].add(r["neighbour"])
        assert np.mean([j in found[q] for q, near in want.items() for j, _ in near]) >= least - 0.002


def test_nearest_odd_rows_and_copies(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=384).tolist()
    data = [(i, base, None) for i in range(400)]  # a third are copies
    data += [(1000 + i, rng.normal(size=384).tolist(), None) for i in range(800)]
    views = np.array(base).reshape(3, 128).tolist()
    data += [(5000, None, None), (5001, [0.0] * 384, None), (5002, [float("nan")] * 384, views), (5003, base[:100], [views[0], None, views[2]]), (5004, [0.0] * 384, [[0.0] * 128] * 3), (1000, data[400][1], None), (5005, (4 * np.array(base)).tolist(), None), (None, base, None)]
    df = spark.createDataFrame(data, "id long, vec array<float>, views array<array<float>>").withColumn("rank", F.lit(1))
    found = defaultdict(list)
    for r in sorted(knn.nearest(df, k=5, least=0.7).collect(), key=lambda r: r["rank"]):
        found[r["id"]].append(r["neighbour"])
    assert set(found) == {*range(400), 5002, 5005}
    assert found[7] == [0, 1, 2, 3, 4] and found[2] == [0, 1, 3, 4, 5] and found[5002] == [0, 1, 2, 3, 4]
    assert knn.nearest(df.limit(0)).count() == 0


# --- mixing


def test_mix_reaches_its_targets(spark):
    rng = random.Random(2)
    data = [(i, " ".join(["word"] * rng.randrange(1, 60)), ["Big", "mid-dle", "small "][min(i % 10, 2)]) for i in range(9000)]
    data += [(20000, None, "big"), (20001, "", "big"), (20002, "other text", None), (20003, "x", "elsewhere")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.25, 3), ("mid_dle", 0.3, 5), ("small", 0.9, 1), ("none", 0.1, 9)], "source string, target_share double, max_repeats long")
    made = mixing.mix(df, targets)
    got = {r["source"]: r for r in made.shares.collect()}
    assert got["big"]["reachable"] and abs(got["big"]["share_reached"] - 0.25) < 0.002
    assert got["mid_dle"]["reachable"] and abs(got["mid_dle"]["share_reached"] - 0.3) < 0.002 and got["mid_dle"]["most_copies"] <= 5
    assert not got["small"]["reachable"] and got["small"]["n_copies"] == got["small"]["n_documents"]
    assert not got["none"]["reachable"] and got["none"]["n_documents"] == 0
    copies = made.documents.groupBy("source").agg(F.max("copies") - F.min("copies")).collect()
    assert all(r[1] <= 1 for r in copies)
    assert made.documents.count() == made.documents.select("doc_id").distinct().count()


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 100, 2000)
    out = mixing.flight(np.full(2000, 0.37), size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - 740) < 1e-3 and abs((out * size).sum() - 0.37 * size.sum()) < 1e-2


# --- reading


def test_reading_levels(spark, sf):
    labels = {r["doc_id"]: r["reading_level"] for r in table(spark, "/root/testdata/sf0.01", "level_labels").collect()}
    found = {r["doc_id"]: r for r in reading.reading_levels(table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "level_labels")).collect()}
    hits = [found[i]["reading_level"] == x for i, x in labels.items() if i in found]
    assert np.mean(hits) >= 0.8
    assert all(r["lang"] in reading.LANGUAGES for r in found.values())


def test_reading_edge_cases(spark):
    easy, hard = "we see the cat and the dog and we play at home today. " * 6, "notwithstanding heterogeneity the identification presupposes commensurability of parametrised invariance. " * 6
    data = [(i, easy if i % 2 else hard, "en") for i in range(60)] + [(100, None, "en"), (101, "", None), (102, "too short", "en"), (103, easy * 500, None), (0, hard, "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("reading_level", F.lit("x"))
    labels = spark.createDataFrame([(i, "primary" if i % 2 else "expert") for i in range(20)] + [(3, "primary"), (5, None), (7, "none")], "doc_id long, reading_level string")
    found = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(df.drop("reading_level"), labels).collect()}
    assert found[31] == "primary" and found[30] == "expert" and found[103] == "primary"
    assert not {100, 101, 102} & set(found)
    assert reading.reading_levels(df.drop("reading_level"), labels.limit(0)).count() == 0


def test_reading_lists_are_document_frequency_lists():
    words = np.array([1, 2, 3, 4], np.int64)
    held = np.array([[100.0, 0, 0, 0], [4.9, 0, 0, 0], [0, 5.0, 0, 0], [3.0, 3, 3, 3]])
    made = reading.lists_of(words, held, np.full((len(reading.LANGUAGES), 4), 100.0))
    assert dict(zip(made.words.tolist(), made.bits.tolist())) == {1: 0b10001, 3: 0b00010}
    outside = made.outside(np.array([0, 0]), np.array([2, 4]), np.array([1, 2, 1, 1, 3, 4], np.int64))
    assert outside[0].tolist() == [0.5, 1, 1, 1, 0.5] and outside[1].tolist() == [0.5, 0.75, 1, 1, 0.5]


def test_reading_has_two_kinds_of_terms():
    terms = reading.terms_of(np.full((1, 5), 0.25), np.array([50]), np.array([5]))
    assert terms.shape == (1, 5) and terms[0, :4].tolist() == [0.25] * 4 and terms[0, 4] == np.log(11)


# --- queries


FORMS = {
    "p1_found": "group_doc_id string, doc_id string", "p2_found": "sample_id bigint", "p3_found": "record_kind string, record_id bigint, line_no bigint, lang_code string", "p4_found": "item_a string, item_b string", "p5_found": "conv_id bigint, subject string",
    "p6_found": "id_a bigint, id_b bigint", "p7_ids": "doc_id bigint, ids array<int>", "p8_found": "source string", "p9_found": "doc_id bigint, reading_level string",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_forms(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    if name in FORMS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == FORMS[name]
    n = df.count()
    if name.endswith("_found") and name != "p7_ids":
        assert n == df.distinct().count()
