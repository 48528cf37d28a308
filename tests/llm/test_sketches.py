"""Dyadic sketches, multiresolution bitmaps and source mixing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import dyadic, queries
from tidewheel.llm.bitmaps import build_bitmaps, estimate_distinct, merge_bitmaps
from tidewheel.llm.dyadic import VALUE_ERROR, Sketch, build_sketches, decode, encode, merge_sketches, sketch_quantiles
from tidewheel.llm.mixing import mix_sources, mixing_report, pivotal, token_sizes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_codes_keep_order_and_precision():
    r = np.random.default_rng(1)
    v = np.concatenate([r.normal(0, 1, 500) * 10.0 ** r.integers(-300, 300, 500), [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, np.inf, -np.inf]])
    c = encode(v)
    order = np.argsort(v, kind="stable")
    assert (np.diff(c[order]) >= 0).all() and encode(np.array([0.0]))[0] == encode(np.array([-0.0]))[0]
    back = decode(c)
    normal = np.isfinite(v) & (np.abs(v) > 1e-300)
    assert (np.abs(back[normal] - v[normal]) <= VALUE_ERROR * np.abs(v[normal])).all()
    assert back[np.isposinf(v)][0] == np.inf and decode(encode(np.array([0.0])))[0] == 0.0


def rank_error(values, q, p):
    n = len(values)
    slack = abs(q) * VALUE_ERROR
    low, high = np.searchsorted(values, q - slack, "left"), np.searchsorted(values, q + slack, "right")
    at = p * (n - 1)
    return 0.0 if low <= at + 1 and at - 1 <= high else min(abs(low - at), abs(high - at)) / n


PROBS = [0.01, 0.25, 0.5, 0.9, 0.99]


@pytest.mark.parametrize("kind", ["normal", "tail", "ties", "humps"])
def test_quantiles_within_stated_error(spark, kind):
    r = np.random.default_rng(7)
    n = 60_000
    v = {"normal": r.normal(10, 3, n), "tail": np.exp(r.normal(0, 3, n)), "ties": r.integers(0, 5, n).astype(float), "humps": np.concatenate([r.normal(-50, 1, n // 2), r.normal(900, 5, n // 2)])}[kind]
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(4).withColumn("g", F.lit("x"))
    got = sketch_quantiles(merge_sketches(build_sketches(df, ["g"], "v"), ["g"]), ["g"], PROBS).collect()[0]
    v.sort()
    assert got["n"] == n and got["rank_error"] < 0.2
    for p, q in zip(PROBS, got["quantiles"]):
        assert rank_error(v, q, p) <= max(got["rank_error"], 1e-9)


def test_merge_equals_direct_and_deletion_undoes(spark, monkeypatch):
    monkeypatch.setattr(dyadic, "HELD", 4096)
    r = random.Random(2)
    rows = [(f"d{r.randint(1, 3)}", r.choice(["a", None]), r.gauss(0, 50) if r.random() < 0.97 else r.choice([None, float("nan"), 0.0])) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "day string, tag string, v double").repartition(5)
    days = merge_sketches(build_sketches(df, ["day", "tag"], "v"), ["day", "tag"])
    week = {x["tag"]: x for x in sketch_quantiles(merge_sketches(days, ["tag"]), ["tag"], PROBS).collect()}
    direct = {x["tag"]: x for x in sketch_quantiles(merge_sketches(build_sketches(df, ["tag"], "v"), ["tag"]), ["tag"], PROBS).collect()}
    assert week == direct and set(week) == {"a", None}
    # the whole less a day equals the other days; and a value added with weight -1 is gone
    part = build_sketches(df, ["day", "tag"], "v").withColumn("s", F.when(F.col("day") == "d1", 0).otherwise(1)).where("s = 1")
    less = build_sketches(df, ["tag"], "v").withColumn("s", F.lit(1)).unionByName(build_sketches(df.where("day = 'd1'"), ["tag"], "v").withColumn("s", F.lit(-1)))
    a = sketch_quantiles(merge_sketches(less, ["tag"], "s"), ["tag"], PROBS).collect()
    b = sketch_quantiles(merge_sketches(part, ["tag"]), ["tag"], PROBS).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    undone = df.withColumn("w", F.lit(1)).unionByName(df.where("day = 'd1'").withColumn("w", F.lit(-1)))
    c = sketch_quantiles(merge_sketches(build_sketches(undone, ["tag"], "v", "w"), ["tag"]), ["tag"], PROBS).collect()
    assert sorted(map(str, c)) == sorted(map(str, b))


def test_small_groups_packed_plainly_equal_the_rest():
    r = np.random.default_rng(3)
    groups = [np.unique(encode(r.normal(0, 50, r.integers(1, 90)))) for _ in range(300)]
    sketches = [Sketch(c, r.integers(1, 9, len(c))) for c in groups]
    packed = [s.pack() for s in sketches]
    plain = [i for i, x in enumerate(packed) if x[:1] == b"\0"]
    assert 0 < len(plain) < len(packed)
    for s, x in zip(sketches, packed):
        back = Sketch.unpack(x)
        assert back.n == s.n and (back.codes == s.codes).all() and (back.weights == s.weights).all()
    assert dyadic._plain_quantiles([packed[i] for i in plain], PROBS) == [sketches[i].quantiles(PROBS, exact_small=True)[0] for i in plain]


def plain_percentiles(values):
    v = np.sort(np.array(values))
    return [float(v[int(p * (len(v) - 1))]) for p in (0.5, 0.9, 0.99)]


def test_every_tag_has_percentiles(spark, tmp_path):
    r = random.Random(8)
    tags = {"samples": ["service", "region", "env", "instance"], "unaggregated": ["app", "region", "client"]}
    row_tags = lambda t: {k: f"{k}{r.randint(0, 30 if k in ('instance', 'client') else 1)}" for k in tags[t] if r.random() < 0.9}
    samples = [("m", row_tags("samples"), r.gauss(0, 50)) for _ in range(900)]
    records = [("timer", "t+x", None, row_tags("unaggregated"), None, [r.gauss(5, 9) for _ in range(r.randint(0, 3))], None, f"2024-05-0{r.randint(6, 8)} 01:00:00") for _ in range(900)]
    spark.createDataFrame(samples, "__name__ string, tags map<string,string>, value double").write.parquet(f"{tmp_path}/samples.parquet")
    ddl = "type string, id string, __name__ string, tags map<string,string>, counter_val bigint, batch_timer array<double>, gauge_val double, timestamp string"
    spark.createDataFrame(records, ddl).selectExpr("* except (timestamp)", "cast(timestamp as timestamp_ntz) as timestamp").write.parquet(f"{tmp_path}/unaggregated.parquet")
    want: dict[str, dict] = {q: {} for q in ("p2_sample_percentiles", "p2_day_percentiles", "p2_week_from_days")}
    for name, t, v in samples:
        for k in [*tags["samples"], None]:
            want["p2_sample_percentiles"].setdefault((name, k, t.get(k)), []).append(v)
    for kind, ident, _, t, _, timers, _, at in records:
        for k in [*tags["unaggregated"], None]:
            want["p2_day_percentiles"].setdefault((ident.split("+")[0], kind, at[:10], k, t.get(k)), []).extend(timers)
            want["p2_week_from_days"].setdefault((ident.split("+")[0], kind, k, t.get(k)), []).extend(timers)
    for q, groups in want.items():
        rows = queries.QUERIES[q](spark, str(tmp_path)).collect()
        got = {tuple(x)[: -6]: x for x in rows}
        assert len(got) == len(rows) and set(got) == {k for k, v in groups.items() if v}
        for k, x in got.items():
            assert x["n"] == len(groups[k]) and (x["rank_error"] > 0) == (q == "p2_sample_percentiles")
            if q != "p2_sample_percentiles":
                assert np.allclose([x["p50"], x["p90"], x["p99"]], plain_percentiles(groups[k]), rtol=2 * VALUE_ERROR)
            else:
                values = np.sort(groups[k])
                assert all(rank_error(values, x[c], p) <= max(x["rank_error"], 1 / len(values)) for c, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))


def test_sketch_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan"))], "g string, v double")
    assert build_sketches(df, ["g"], "v").count() == 0
    assert sketch_quantiles(merge_sketches(build_sketches(df, ["g"], "v"), ["g"]), ["g"], PROBS).count() == 0
    s = Sketch()
    assert s.quantiles([0.5]) == ([None], 0.0) and Sketch.unpack(s.pack()).n == 0
    for exact_small in (False, True):
        assert Sketch(np.array([5, 9]), np.array([2, 1])).quantiles([0.0, 1.0], exact_small)[0] == decode(np.array([5, 9])).tolist()


def test_updates_and_counters_are_the_same_sketch(monkeypatch):
    r = np.random.default_rng(4)
    codes = np.unique(encode(r.normal(0, 50, 3000)))
    weights = r.integers(1, 9, len(codes))
    kept = Sketch(codes, weights)
    monkeypatch.setattr(dyadic, "SPARSE", 100)
    settled = Sketch(codes, weights)
    assert kept.cells is None and settled.cells is not None
    assert kept.quantiles(PROBS) == settled.quantiles(PROBS) == Sketch.unpack(settled.pack()).quantiles(PROBS)
    settled.add(Sketch(codes[:50], weights[:50]), -1)
    assert settled.quantiles(PROBS) == Sketch(codes[50:], weights[50:]).quantiles(PROBS)


@pytest.mark.parametrize("n", [3, 40, 900, 50_000])
def test_error_of_groups_of_every_size_is_within_the_stated(n):
    r = np.random.default_rng(n)
    worst, stated = 0.0, []
    for _ in range(6):
        v = np.sort(np.exp(r.normal(0, 2, n)))
        codes, counts = np.unique(encode(v), return_counts=True)
        got, error = Sketch(codes, counts).quantiles(PROBS)
        worst = max(worst, *(rank_error(v, q, p) - error for p, q in zip(PROBS, got)))
        stated.append(error)
    assert worst <= 1 / n and max(stated) < 0.1


def test_tree_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(dyadic, "FAN_IN", 3)
    df = spark.range(4000).select((F.col("id") % 2).cast("string").alias("g"), (F.col("id") * 1.5).alias("v")).repartition(20)
    for keys in (["g"], []):
        tree = sketch_quantiles(merge_sketches(build_sketches(df, keys, "v"), keys, tasks=20), keys, PROBS)
        assert sorted(map(str, tree.collect())) == sorted(map(str, sketch_quantiles(merge_sketches(build_sketches(df, keys, "v"), keys), keys, PROBS).collect()))


def test_distinct_counts_within_error(spark):
    sizes = {"none": 1, "small": 40, "middle": 3000, "large": 60_000}
    df = spark.range(80_000).select(F.explode(F.array(*(F.when(F.col("id") < n, F.lit(g)) for g, n in sizes.items()))).alias("g"), F.concat(F.lit("u"), "id").alias("ident")).where("g is not null")
    df = df.unionByName(df.where("hash(ident) % 7 = 0")).unionByName(spark.createDataFrame([("none", None), ("none", " "), ("blank", "")], "g string, ident string")).withColumn("bitmap", F.lit(1))
    got = {r["g"]: r for r in estimate_distinct(build_bitmaps(df, ["g"], "ident")).collect()}
    assert set(got) == set(sizes)
    for g, n in sizes.items():
        assert abs(got[g]["n_distinct"] / n - 1) <= max(4 * got[g]["rel_error"], 1e-3) and got[g]["rel_error"] < 0.03


def test_bitmaps_merge_to_the_whole(spark):
    df = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string")).alias("b"), (F.col("id") % 11_000).cast("string").alias("u"))
    parts = build_bitmaps(df, ["a", "b"], "u")
    whole = build_bitmaps(df.withColumn("k", F.lit(1)), ["k"], "u").collect()[0]["bitmap"]
    assert merge_bitmaps(parts, []).collect()[0]["bitmap"] == whole
    every = merge_bitmaps(parts, ["a", "b"], combinations=True)
    assert every.where("summed = 3").collect()[0]["bitmap"] == whole and every.count() == 15 + 3 + 5 + 1
    assert estimate_distinct(build_bitmaps(df.limit(0), ["a"], "u")).count() == 0


def test_pivotal_keeps_mass_and_expectation():
    r = random.Random(5)
    ids, w, p = list(range(40)), [r.randint(1, 300) for _ in range(40)], [r.uniform(0.05, 0.95) for _ in range(40)]
    hits = np.zeros(40)
    for seed in range(400):
        decided, left = pivotal(ids, w, p, seed)
        bits = dict(decided)
        assert len(bits) + (left is not None) == 40
        kept = sum(w[i] * b for i, b in bits.items()) + (left[1] * left[2] if left else 0)
        assert kept == pytest.approx(sum(a * b for a, b in zip(w, p)))
        for i, b in bits.items():
            hits[i] += b
        if left:
            hits[left[0]] += left[2]
    assert np.abs(hits / 400 - np.array(p)).max() < 0.12
    assert pivotal([], [], [], 1) == ([], None)


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "it's", "12", "été"], k=r.randint(0, 60))), s) for i, s in enumerate(["big"] * 900 + ["mid"] * 200 + ["tiny"] * 30 + ["other"] * 20 + [None] * 5)]
    rows += [(5000, None, "big"), (5001, "", "mid")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, source string, rate int").repartition(5)
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 3), ("tiny", 0.05, 4), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_shares_are_reached(spark, mixed):
    docs, targets = mixed
    out = mix_sources(docs, "doc_id", "text", "source", targets, TOKENIZER)
    rows = out.collect()
    assert len(rows) == docs.count() and len({r["doc_id"] for r in rows}) == len(rows)
    caps = {"big": 1, "mid": 3, "tiny": 4}
    assert all(0 <= r["copies"] <= caps.get(r["source"], 0) for r in rows)
    report = {r["source"]: r for r in mixing_report(out, "source", targets).collect()}
    longest = max(r["tokens"] for r in rows)
    total = sum(r["used_tokens"] for r in report.values())
    for s, share in (("big", 0.6), ("mid", 0.3), ("tiny", 0.05)):
        assert abs(report[s]["used_tokens"] - share / 0.95 * total) < 4 * longest
    assert report["absent"]["actual_share"] == 0 and report["other"]["used_tokens"] == 0


def test_given_total_and_caps(spark, mixed):
    docs, targets = mixed
    out = mix_sources(docs, "doc_id", "text", "source", targets, TOKENIZER, total_tokens=10**7)
    by = {r["source"]: r for r in out.where("tokens > 0").groupBy("source").agg(F.min("copies").alias("a"), F.max("copies").alias("b")).collect()}
    assert (by["big"]["a"], by["big"]["b"]) == (1, 1) and (by["tiny"]["a"], by["tiny"]["b"]) == (4, 4)


def test_same_seed_same_choice_and_empty(spark, mixed):
    docs, targets = mixed
    assert mix_sources(docs.limit(0), "doc_id", "text", "source", targets, TOKENIZER).count() == 0
    assert mix_sources(docs, "doc_id", "text", "source", targets.limit(0), TOKENIZER).agg(F.sum("copies")).first()[0] == 0


def test_conflicting_targets_and_missing_vocabulary(spark, mixed):
    docs, targets = mixed
    again = targets.unionByName(targets.limit(1))
    assert mix_sources(docs, "doc_id", "text", "source", again, TOKENIZER).count() == docs.count()
    with pytest.raises(ValueError, match="two different targets"):
        mix_sources(docs, "doc_id", "text", "source", targets.unionByName(targets.withColumn("max_repeats", F.col("max_repeats") + 1)), TOKENIZER)
    with pytest.raises(FileNotFoundError):
        token_sizes(docs, "doc_id", "text", "source", "/nowhere/vocabulary")


def test_token_sizes(spark, mixed):
    from tidewheel.llm.mixing import _encoding, _shipped

    docs, _ = mixed
    enc = _encoding(_shipped(spark, TOKENIZER))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in token_sizes(docs, "doc_id", "text", "source", TOKENIZER).collect():
        assert r["tokens"] == (0 if text[r["doc_id"]] is None else len(enc.encode_ordinary(text[r["doc_id"]])))
