"""Temperature mixing, resharding and the pipeline."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, mixing, queries, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"


def totals(spark, sizes):
    return spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, n_tokens bigint")


def entropy(ws):
    return -sum(w * math.log(w) for w in ws if w) / math.log(len(ws))


def test_exponent_reaches_the_entropy(spark):
    rows = mixing.weights(totals(spark, [1000, 100, 50, 10]), entropy=0.8).collect()
    ws = [r.weight for r in rows]
    assert abs(sum(ws) - 1) < 1e-12 and abs(entropy(ws) - 0.8) < 1e-9 and 0 < rows[0].exponent < 1
    assert [r.exponent for r in mixing.weights(totals(spark, [10, 10]), entropy=0.9).collect()] == [1.0, 1.0]
    assert abs(mixing.weights(totals(spark, [1000, 1]), entropy=1.0).first().exponent) < 1e-6


def test_repetition_limit_wins(spark):
    for sizes, limit in (([1000, 100, 50, 10], 3.0), ([1000, 20], 1.5)):
        rows = mixing.weights(totals(spark, sizes), entropy=1.0, max_repeat=limit).collect()
        assert max(r.budget / r.n_tokens for r in rows) == pytest.approx(limit, abs=0.1)
    rows = mixing.weights(totals(spark, [100, 60]), max_repeat=4.0, budget=320).collect()
    assert rows[0].exponent == 0.0 and [r.budget for r in rows] == [160, 160]
    assert mixing.weights(totals(spark, [0]), entropy=0.5).collect() == []


def slow_uses(docs, plans, seed=42):
    """Uses of each row: whole epochs, then rows in order of the hash while they fit."""
    import hashlib

    out = []
    for source, (epochs, rest) in plans.items():
        rows = [(d, n) for d, s, n in docs if s == source]
        key = {d: hashlib.md5(f"{seed}:{epochs}:{'' if d is None else d}".encode()).hexdigest() for d, _ in rows}
        for d, n in rows:
            upto = sum(m for e, m in rows if m and key[e] <= key[d])
            out += [(d, source)] * (1 if n == 0 else epochs + (upto <= rest))
    return sorted(out, key=str)


def test_budgets_against_brute_force(spark, monkeypatch):
    docs = [(i, f"s{i % 3 if i % 5 else 0}", i % 7) for i in range(150)] + [(None, None, 4), (None, None, 4), (3, "s1", 5), (3, "s1", 5), (200, None, 0)]
    df = spark.createDataFrame([(d, " ".join(["w"] * n), s, "clash") for d, s, n in docs], "doc_id bigint, text string, source string, n_tokens string")
    for digits, rows in ((1, 50_000), (3, 0)):
        monkeypatch.setattr(mixing, "BLOCK_DIGITS", digits)
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", rows)
        plans = {
            None if r.source == "null" else r.source[1:]: (r.epochs, r.budget % r.n_tokens)
            for r in mixing.plan(df, entropy=0.97, max_repeat=3.0).collect()
        }
        mixed = mixing.mix(df, entropy=0.97, max_repeat=3.0)
        assert mixed.columns == [*df.columns, "mix_tokens", "mix_epoch", "mix_order"]
        assert sorted(((r.doc_id, r.source) for r in mixed.collect()), key=str) == slow_uses(docs, plans)


def test_mix_odd_tables(spark, odd_docs, no_docs):
    mixed = mixing.mix(odd_docs, entropy=0.9, max_repeat=2.0)
    assert {r.doc_id for r in mixed.where("mix_tokens = 0").collect()} == {2, 3, 6}
    assert mixed.columns[:7] == odd_docs.columns
    assert mixing.mix(no_docs, entropy=0.9).count() == 0


def test_flow_is_cheapest():
    supply, capacity = [5, 9, 0], [4, 6, 6]
    cost = [[0, 3, 1], [2, 0, 5], [1, 1, 0]]

    def price(flow):
        return sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3))

    flow = sharding.minimum_cost_flow(supply, capacity, cost)
    assert [sum(r) for r in flow] == supply and all(sum(r[j] for r in flow) <= capacity[j] for j in range(3))
    best = min(
        price([[a, b, 5 - a - b], [c, d, 9 - c - d], [0, 0, 0]])
        for a, b, c, d in itertools.product(range(6), range(6), range(10), range(10))
        if a + b <= 5 and c + d <= 9 and a + c <= 4 and b + d <= 6 and 14 - a - b - c - d <= 6
    )
    assert price(flow) == best
    stay = sharding.minimum_cost_flow([30, 10, 10], [10, 10, 10, 10, 10])
    assert [stay[i][i] for i in range(3)] == [10, 10, 10]
    with pytest.raises(ValueError):
        sharding.minimum_cost_flow([3], [2])
    assert sharding.minimum_cost_flow([], [0, 0]) == []


def checked(df, docs, n_new):
    got = df.collect()
    assert len(got) == docs.count()
    for shard in range(n_new):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    return [sum(r.size for r in got if r.shard == s) for s in range(n_new)], got


def test_shards_are_even_and_copies_stay_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes, got = checked(sharding.reshard(docs, queries.old_shard(), 8), docs, 8)
    assert max(sizes) - min(sizes) <= 0.001 * sum(sizes)
    assert len({(r.text_crc32, r.size) for r in got}) == len({(r.text_crc32, r.size, r.shard) for r in got})
    moved = sum(r.size for r in got if r.old != r.shard)
    assert moved <= 1.02 * sum(max(0, s - sum(sizes) // 8) for s in (sum(r.size for r in got if r.old == o) for o in range(6)))


def test_one_text_fills_the_table(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICE_ROWS", 16)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.col("id").cast("string")).alias("text"))
    sizes, _ = checked(sharding.reshard(docs, F.lit(0), 4), docs, 4)
    assert max(sizes) - min(sizes) <= 60


def test_copies_stay_together_beside_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCKS", 2)
    monkeypatch.setattr(sharding, "SLICE_ROWS", 16)
    k = F.col("id")
    text = F.when(k < 1000, "hot text").when(k < 1240, "held here").otherwise(F.lpad((k % 300).cast("string"), 8, "0"))
    docs = spark.range(3000).select(k.alias("doc_id"), text.alias("text"))
    rows = sharding.sized(docs, F.lit(0), blocks=2)
    got = sharding.slots(sharding.assigned(rows, sharding.plan(rows, 8))).collect()
    assert len(got) == 3000
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    shards = {}
    for r in got:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(shards) == 302 and sorted(map(len, shards.values()))[:-1] == [1] * 301
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes)


def test_capacities_and_odd_tables(spark, odd_docs, no_docs):
    checked(sharding.reshard(odd_docs, F.lit(None), 3), odd_docs, 3)
    assert sharding.reshard(no_docs, F.lit(0), 8).count() == 0
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 9, "0").alias("text"))
    sizes, _ = checked(sharding.reshard(docs, F.pmod("doc_id", F.lit(2)), 3, capacity=[1000, 2000, 1000]), docs, 3)
    assert sizes == [1000, 2000, 1000]


def test_rewrite_leaves_untouched_shards(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 9, "0").alias("text"), F.lit("x").alias("shard"))
    old = F.when(F.col("doc_id") < 200, 0).when(F.col("doc_id") < 250, 1).otherwise(2)
    done = {r.shard: r.affected for r in sharding.rewrite(docs, old, str(tmp_path / "out"), 3, capacity=[1500, 1000, 500]).collect()}
    assert done == {0: True, 1: True, 2: False}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 250 and {r.shard for r in back.collect()} == {0, 1}
    assert sorted(r.doc_id for r in back.collect()) == list(range(250))


def test_rewrite_refuses_a_folder_that_is_there(spark, tmp_path):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    docs.withColumn("shard", F.lit(7)).write.partitionBy("shard").parquet(str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sharding.rewrite(docs, F.lit(0), str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == columns
        rows, before = out.collect(), {r.doc_id: r for r in docs.collect()}
        ids = sorted(r.doc_id for r in rows)
        if name == "toxicity":
            model = toxicity.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            kept = toxicity.severity(docs, model).where(F.col("severity") < toxicity.REJECT_FROM)
            assert ids == sorted(r.doc_id for r in kept.collect()) and 0.7 * len(before) < len(ids) <= len(before)
        elif name == "simhash":
            first = {}
            for r in simhash.simhash_components(docs).collect():
                first.setdefault(r.component_id, []).append(r.id)
            assert ids == sorted(min(v) for v in first.values()) and len(ids) < len(before)
        elif name == "decontamination":
            hit = {r.doc_id for r in decontaminate.contamination(docs, items).where("contaminated").collect()}
            assert ids == sorted(set(before) - hit) and hit
        elif name == "mixing":
            assert set(ids) <= set(before) and {r.source for r in rows} == {r.source for r in before.values()}
        else:
            assert len(ids) == docs.count() and {r.shard for r in rows} <= set(range(8))
        docs = spark.createDataFrame([r.asDict() for r in rows], out.schema)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_rows_read_back_from_the_written_shards(spark, odd_docs, no_docs, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    old = F.pmod(F.xxhash64("text"), F.lit(3))
    cases = ((docs, old, {}), (docs, old, {"capacity": None}), (odd_docs.withColumn("shard", F.lit("x")), F.lit(None).cast("int"), {}), (no_docs, old, {}))
    for k, (df, column, options) in enumerate(cases):
        want = sharding.reshard(df, column, 4, **options).collect()
        got = sharding.rewritten(df, column, str(tmp_path / f"out{k}"), 4, **options)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)
    # a shard that keeps its rows is not written
    near = spark.range(300).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 9, "0").alias("text"))
    lies = F.when(F.col("doc_id") < 200, 0).when(F.col("doc_id") < 250, 1).otherwise(2)
    got = sharding.rewritten(near, lies, str(tmp_path / "part"), 3, capacity=[1500, 1000, 500])
    assert got.count() == 300 and sorted(p.name for p in (tmp_path / "part").iterdir() if p.name.startswith("shard=")) == ["shard=0", "shard=1"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sharding.reshard(near, lies, 3, capacity=[1500, 1000, 500]).collect()))


def _tables(spark, folder, docs, toxic=(4, 5)):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in (1, 2, 4, 5, 7)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "lost text here"), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """Columns of any name pass through all stages; clean rows are not lost to few labels."""
    names = ("mix_note", "mix_tokens", "shard", "severity", "row", "doc", "words", "_old_shard")
    clashing = odd_docs.withColumns({c: F.lit(f"its {c}") for c in names})
    for k, docs in enumerate((clashing, no_docs)):
        folder = str(tmp_path / f"sf{k}")
        _tables(spark, folder, docs)
        rows = spark.read.parquet(f"{folder}/documents.parquet")
        columns = rows.columns
        before = rows.count()
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, folder)
            if name != "sharding":
                assert rows.columns == columns
                assert {r[c] for r in rows.collect() for c in names if c in columns} <= {f"its {c}" for c in names}
            if name == "toxicity":
                assert rows.count() == before  # two toxic labels teach nothing
            if name == "decontamination" and before:
                assert None not in {r.doc_id for r in rows.collect()}  # its text is the benchmark's
        if before:
            assert rows.count() >= 4
        else:
            out = corpus_pipeline.run(spark, folder)
            assert out.columns == rows.columns and out.count() == 0


def test_the_survivor_of_repeated_ids_is_the_same_on_every_run(spark):
    rows = [(1, "one text of some words", n) for n in ("c", "a", None, "b")] + [(1, "another text of that id altogether", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, note string")
    kept = {tuple(sorted(map(tuple, simhash.one_of_each(df.orderBy(F.rand(seed))).collect()), key=str)) for seed in range(3)}
    assert len(kept) == 1 and (1, "one text of some words", None) in next(iter(kept)) or (1, "another text of that id altogether", "z") in next(iter(kept))


def test_stages_against_plain_python(spark):
    """The first four stages, each against a computation that shares no code with it."""
    import xxhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}

    def fingerprint(text):
        words = text.translate({c: c + 32 for c in range(65, 91)})
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints, root = {i: fingerprint(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 3:
            ra, rb = root[a], root[b]
            if ra != rb:
                root = {i: min(ra, rb) if r in (ra, rb) else r for i, r in root.items()}
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r.doc_id for r in stages["simhash"](spark, docs, SF).collect()) == sorted(set(root.values()))

    import re

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        ws = words(r.text)
        windows |= {tuple(ws[i : i + 10]) for i in range(max(1, len(ws) - 9))} if ws else set()
    lengths = {len(w) for w in windows}
    clean = [i for i, t in texts.items() if not any(tuple(ws[k : k + n]) in windows for ws in [words(t)] for n in lengths for k in range(len(ws) - n + 1))]
    assert sorted(r.doc_id for r in stages["decontamination"](spark, docs, SF).collect()) == sorted(clean)

    larger = SF.replace("0.001", "0.1")  # the smaller ones have too few toxic labels to learn much
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect() if r.toxic is not None}
    kept = {r.doc_id for r in stages["toxicity"](spark, spark.read.parquet(f"{larger}/documents.parquet"), larger).collect()}
    assert sum(i not in kept for i, y in labels.items() if y) >= 0.8 * sum(labels.values())
    assert sum(i in kept for i, y in labels.items() if not y) >= 0.97 * sum(not y for y in labels.values())

    mixed = stages["mixing"](spark, docs, SF).collect()
    n = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]) for i, t in texts.items()}
    given, drawn, source = {}, {}, {r.doc_id: r.source for r in docs.collect()}
    for i, s in source.items():
        given[s] = given.get(s, 0) + n[i]
    for r in mixed:
        drawn[r.source] = drawn.get(r.source, 0) + n[r.doc_id]
    assert all(drawn[s] <= 4.0 * given[s] + 1 for s in drawn) and abs(sum(drawn.values()) - sum(given.values())) <= 0.05 * sum(given.values())
    assert entropy([x / sum(drawn.values()) for x in drawn.values()]) >= 0.94 or max(drawn[s] / given[s] for s in drawn) > 3.8
