"""Quality rules, line and document dedup, decontamination, mixing and sharding against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelite.llm import components, decontamination, line_dedup, mixing, near_dedup, quality_rules, queries, sharding
from kestrelite.llm.common import written

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def base(t):
    w = words(t)
    seen, repeated = defaultdict(list), set()
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    for at in seen.values():
        if len(at) > 1:
            repeated.update(i + k for i in at for k in range(8))
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_figures(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "a b c d e f g h i " * 3, "en", "x", 0), (10_002, "a a a a a a a a a", "en", "x", 0), (10_003, None, None, None, None)], docs.schema)
    docs = docs.union(extra)
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    got = quality_rules.judge(docs, ["doc_id"]).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id], r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.judge(odd).count() == 9 and quality_rules.keep(none).count() == 0
    assert quality_rules.keep(odd).columns == odd.columns


def test_lines_of_one_odd_separator_count(spark):
    rows = [(1, "\u2028\n\u2028\n\u0085\n\u0085\n \n\t\n\x0b"), (2, "a\na\n\n\n")]
    got = {r.doc_id: r.n_dup_lines for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as lang", "'y' as source"), ["doc_id"]).collect()}
    assert got == {1: 2, 2: 1}


def test_estimate_is_that_of_the_best_start(spark):
    r = np.random.default_rng(5)
    mix = r.normal(size=(5, 5)) * 0.3 + np.eye(5)
    x = r.normal(size=(2400, 5)) @ mix.T
    x[:360] = r.normal(size=(360, 5)) * 0.3 + 9  # a tight far cluster, which would pull a plain mean and covariance
    rows = spark.createDataFrame([("c", *map(float, v)) for v in x], "cell string, " + ", ".join(f"x{i} double" for i in range(5)))
    est = quality_rules.estimates(rows, 1).first()["est"].asDict()
    centre = np.array([est[f"m{i}"] for i in range(5)])
    factor = np.array([[est.get(f"l{i}_{j}", 0.0) if j <= i else 0.0 for j in range(5)] for i in range(5)])
    clean = x[360:]
    assert np.abs(centre - clean.mean(0)).max() < 0.25
    scale, h = quality_rules.H / (1 - quality_rules._chi2_tail(quality_rules.chi2_cutoff(1 - quality_rules.H, 5), 7)), int(0.75 * len(x))
    best = np.inf
    for _ in range(100):  # random starts, as a brute-force search for the least determinant
        near = r.choice(len(x), 8, replace=False)
        for _ in range(8):
            m, c = x[near].mean(0), np.cov(x[near].T, bias=True) + 1e-6 * np.eye(5)
            near = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))[:h]
        best = min(best, np.linalg.slogdet(scale * np.cov(x[near].T, bias=True) + np.diag(np.square(quality_rules.FLOOR)))[1])
    assert 2 * np.log(np.diag(factor)).sum() < best + 0.1
    d = np.linalg.solve(factor, (x - centre).T)
    assert ((d**2).sum(0)[:360] > quality_rules.chi2_cutoff(quality_rules.TAIL, 5)).all() and ((d**2).sum(0)[360:] > quality_rules.chi2_cutoff(quality_rules.TAIL, 5)).mean() < 0.01


def test_quality_rejects_junk_and_keeps_clean(spark, sf_dir):
    rows = queries.queries()["op7_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean, junk = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) / len(clean) > 0.97 and sum(not r.kept for r in junk) / max(1, len(junk)) > 0.8


def test_chi_square_cutoff():
    assert quality_rules.chi2_cutoff(0.05, 5) == pytest.approx(11.0705, abs=1e-3) and quality_rules.chi2_cutoff(0.05, 2) == pytest.approx(5.9915, abs=1e-3)


def brute_components(texts, k):
    sets = {}
    for d, t in texts:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts, n = [], 0
    for _ in range(25):
        seed = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 60 if n == 0 else 6)):
            t = list(seed)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append((n, " ".join(t) if r.random() < 0.8 else "\n".join(t).upper()))
            n += 1
    texts += [(n, ""), (n + 1, None), (n + 2, " \t\n")]
    for k in (4, 5):
        want = brute_components(texts, k)
        got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=k).collect()
        assert {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got} == {(d, s, c, d == c) for d, (s, c) in want.items()}


def test_near_duplicate_edge_cases(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == 9 and all(r.kept for r in rows)
    kept = near_dedup.keep(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.count() == 8
    assert near_dedup.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


@pytest.mark.parametrize("frequent", [0, 40])
def test_line_dedup_equals_brute_force(spark, odd, none, monkeypatch, frequent):
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)  # all words, some or none are posted in pairs
    r = random.Random(5 + frequent)
    rows, vocabulary = [], [f"t{i}" for i in range(40)]
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 5)):
            line = [r.choice(vocabulary) for _ in range(r.randint(0, 12))]
            lines.append(" ".join(line))
            if r.random() < 0.5:
                line[r.randrange(len(line)) if line else 0 :] = [r.choice(vocabulary)]
                lines.append("  ".join(line).upper())
        rows.append((d, "\n".join(lines)))
    seen, want = [], defaultdict(list)
    for d, t in rows:
        for k, line in enumerate(t.split("\n")):
            s = set(line.lower().split())
            if s:
                if any(10 * len(s & o) >= 8 * len(s | o) for o in seen):
                    want[d].append(k)
                seen.append(s)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.report(docs).collect()
    assert {x.doc_id: x.removed for x in got} == {d: want[d] for d, _ in rows}
    texts = {x.doc_id: x.text for x in line_dedup.dedup(docs).collect()}
    assert texts == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]) for d, t in rows}
    assert line_dedup.report(odd).count() == 9 and line_dedup.report(none).count() == 0


def test_line_dedup_of_rows_that_share_an_id(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(7, " ".join(words[k : k + 10])) for k in range(0, 30, 10)] + [(8, " ".join(words[10:19])), (7, " ".join(words[:9]))]
    got = line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # a line of id 7 is not earlier than another of the same id and number; that of id 8 matches one of them
    assert sorted((x.doc_id, x.line) for x in got) == [(8, 0)]


def test_line_dedup_is_the_same_for_any_sample_of_frequencies(spark, monkeypatch):
    r = random.Random(9)
    rows = [(d, "\n".join(" ".join(r.choices([f"t{i}" for i in range(12)], k=r.randint(4, 9))) for _ in range(4))) for d in range(40)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    for sample in (1, 8, 1 << 40):  # all lines, some and none are counted
        monkeypatch.setattr(line_dedup, "SAMPLE", sample)
        got.append({(x.doc_id, x.line) for x in line_dedup.removed_lines(docs).collect()})
    assert got[0] and got[0] == got[1] == got[2]


def test_line_dedup_forms_only_pairs_whose_later_line_is_open(spark):
    words = [f"w{i}" for i in range(20)]
    rows = [(d, " ".join(words[:18] + [f"x{d}"] * (d % 2))) for d in range(6)]  # equal lines of even ids, one word more in each of the others
    docs = spark.createDataFrame(rows, "id long, text string")
    first = line_dedup.first_lines(docs).where("nth = 1").select("id", "line", "n", "parity", "odd", "head")
    of = lambda known: {(x.id, x.id2) for x in line_dedup.group_pairs(first.withColumn("open", known)).collect()}
    assert of(F.lit(True)) == {(1, 0), (3, 0), (5, 0), (3, 1), (5, 1), (5, 3)}
    assert of(F.col("id") == 3) == {(3, 0), (3, 1)} and of(F.col("id") == 0) == set()


def test_line_dedup_joins_groups_over_one_scan_and_one_shuffle(spark):
    words = [f"w{i}" for i in range(20)]
    docs = spark.createDataFrame([(d, " ".join(words[:18] + [f"x{d}"] * (d % 2))) for d in range(6)], "id long, text string")
    first = written(line_dedup.first_lines(docs), "first-lines").where("nth = 1").select("id", "line", "n", "parity", "odd", "head")
    pairs = line_dedup.group_pairs(first.withColumn("open", F.lit(True)))
    assert {(x.id, x.id2) for x in pairs.collect()} == {(1, 0), (3, 0), (5, 0), (3, 1), (5, 1), (5, 3)}
    final = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


def test_line_dedup_fetches_the_same_lines_by_any_join(spark, monkeypatch):
    r = random.Random(11)
    rows = [(d % 35, "\n".join(" ".join(r.choices([f"t{i}" for i in range(12)], k=r.randint(4, 9))) for _ in range(4))) for d in range(40)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    for lines, ids in ((300_000, 2_000_000), (0, 2_000_000), (0, 0)):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", lines)
        monkeypatch.setattr(line_dedup, "BROADCAST_IDS", ids)
        got.append({(x.doc_id, x.line) for x in line_dedup.removed_lines(docs).collect()})
    assert got[0] and got[0] == got[1] == got[2]


def test_line_dedup_stays_in_the_engine(spark, sf_dir):
    for name in ("op4_line_dedup", "op7_quality"):
        plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_benchmark_items_are_found(spark, sf_dir, odd, none):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = {r.item_id: decontamination.words_of(r.text) for r in items.collect()}
    planted = []
    for n, (i, w) in enumerate(sorted(own.items())[:10]):
        loose = [x for k, x in enumerate(w) if k % 9 != 4]  # a paraphrase that drops each ninth word
        planted.append((90_000 + n, "filler words before it . " * 5 + b" ".join(w if n % 2 else loose).decode() + " and after"))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    joined = {i: b" " + b" ".join(w) + b" " for i, w in own.items()}
    want = {(r.doc_id, i) for r in docs.collect() for i, x in joined.items() if x in b" " + b" ".join(decontamination.words_of(r.text)) + b" "}
    want |= {(90_000 + n, i) for n, i in enumerate(sorted(own)[:10])}
    got = {(r.doc_id, r.item_id) for r in decontamination.hits(docs, items).collect()}
    assert len(want - got) <= 0.05 * len(want) and len(got - want) <= 0.05 * len(want)
    odd_items = spark.createDataFrame([(1, None), (2, ""), (3, "alpha beta gamma delta")], "item_id long, text string")
    assert decontamination.hits(odd, odd_items).count() == 0 and decontamination.hits(none, items).count() == 0
    assert decontamination.hits(odd, odd_items.limit(0)).count() == 0 and decontamination.keep(odd, odd_items).count() == 9


def test_benchmark_beyond_a_block_gives_the_same_hits(spark, sf_dir, monkeypatch):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = lambda: {(r.doc_id, r.item_id, round(r.cosine, 4), r.cover, r.answer_cover) for r in decontamination.hits(docs, items).collect()}
    whole, left = found(), decontamination.keep(docs, items).count()
    monkeypatch.setattr(decontamination, "MAX_ITEMS", 7)
    assert whole and items.count() > 3 * 7 and found() == whole and decontamination.keep(docs, items).count() == left


def test_items_in_few_passages_are_found(spark):
    item = "the river crosses seven old bridges before it meets the harbour of the northern town at dawn"
    for n in (0, 2):
        docs = spark.createDataFrame([(1, f"we read that {item} and so on")] + [(2 + k, f"other words {k} without any relation to it at all") for k in range(n)], "doc_id long, text string")
        got = decontamination.hits(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
        assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)]


def test_near_links_follow_the_percent(spark):
    a = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[:45] + ["x"] * 1)), (3, " ".join(f"z{i}" for i in range(60)))], "doc_id long, text string")
    found = lambda p: {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 4, p).collect()}
    assert found(80) == {1: 1, 2: 2, 3: 3} and found(60) == {1: 1, 2: 1, 3: 3}


def test_contaminated_rows_without_an_id_go(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = [(None, f"{r.text} and after") for r in items.orderBy("item_id").limit(3).collect()]
    free = [(None, "some clean words without any item"), (None, None), (None, "")]
    kept = decontamination.keep(docs.union(spark.createDataFrame(held + free, "doc_id long, text string")), items)
    assert kept.columns == docs.columns and sorted(str(r.text) for r in kept.where("doc_id is null").collect()) == sorted(str(t) for _, t in free)


def test_common_subsequence_is_exact():
    r = random.Random(2)
    for _ in range(200):
        a, b = [r.choice("abcd") for _ in range(r.randint(1, 12))], [r.choice("abcd") for _ in range(r.randint(0, 14))]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        bits = defaultdict(int)
        for i, x in enumerate(a):
            bits[x] |= 1 << i
        assert (~decontamination.common_words(bits, b) & ((1 << len(a)) - 1)).bit_count() == table[-1, -1]


def test_raking_meets_the_marginals():
    cells = [(("a", "x"), 70.0), (("a", "y"), 10.0), (("b", "x"), 15.0), (("b", "y"), 5.0)]
    w = mixing.rake(cells, [{"a": 0.5, "b": 0.5}, {"x": 0.4, "y": 0.6}])
    assert w.sum() == pytest.approx(100) and w[0] + w[1] == pytest.approx(50) and w[0] + w[2] == pytest.approx(40)
    assert w[0] * w[3] / (w[1] * w[2]) == pytest.approx(70 * 5 / (10 * 15))  # raking keeps the odds ratio


def test_mixing_paths_agree_and_repeat(spark, sf_dir, odd, none, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    one = {(r.doc_id, round(r.probability, 6), r.kept) for r in mixing.weigh(docs, columns=["doc_id"]).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    monkeypatch.setattr(mixing, "ROUNDS", 6)
    few = {r.doc_id: r.probability for r in mixing.weigh(docs, columns=["doc_id"]).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 200_000)
    again = {r.doc_id: r.probability for r in mixing.weigh(docs, columns=["doc_id"]).collect()}
    assert few == pytest.approx(again) and len(one) == 80
    got = mixing.weigh(odd, columns=["doc_id"]).collect()
    assert len(got) == 9 and mixing.weigh(none, columns=["doc_id"]).count() == 0 and mixing.keep(odd).columns == odd.columns


def test_sharding_round_trip(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = sharding.Store(spark, f"file://{tmp_path}/store", target=120_000, small=10_000, fan_in=3)
    n = 9
    for k in range(n):
        store.append(docs.where(F.pmod("doc_id", F.lit(n)) == k).coalesce(1))
        before = store.manifest()
        store.compact()
    made = store.manifest()
    assert store.read().exceptAll(docs).count() == 0 and store.read().count() == docs.count()
    assert store._read(before).count() <= docs.count() and store.read(1).count() == docs.where(F.pmod("doc_id", F.lit(n)) == 0).count()
    assert not store.plan(made["shards"]) and sum(s["rows"] for s in made["shards"]) == docs.count()
    store.vacuum()
    assert store.read().count() == docs.count()
    with pytest.raises(FileExistsError):
        store.commit({"version": made["version"] - 1}, [], made["schema"])


def test_samples_have_the_target_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.weigh(docs, columns=["source", "lang"]).collect()
    total = sum(r.n_tokens for r in rows)
    expected = sum(r.n_tokens * r.probability for r in rows)
    kept = sum(r.n_tokens for r in rows if r.kept)
    assert 0.4 < kept / total < 1
    for axis in ("source", "lang", "topic"):
        have, drawn, fitted = ({} for _ in range(3))
        for r in rows:
            for d, x in ((have, r.n_tokens), (fitted, r.n_tokens * r.probability), (drawn, r.n_tokens * r.kept)):
                d[r[axis]] = d.get(r[axis], 0) + x
        want = mixing.default_targets({v: x / total for v, x in have.items()})
        assert sum(want.values()) == pytest.approx(1)
        for v, t in want.items():
            assert abs(fitted[v] / expected - t) < 0.005 and abs(drawn[v] / kept - t) < 0.04


def test_sharding_with_other_writers(spark, tmp_path):
    rows = spark.range(4000).select("id", F.repeat(F.lit("x"), 100).alias("blob"))
    store, other = (sharding.Store(spark, f"file://{tmp_path}/shared", target=200_000, small=20_000, fan_in=3) for _ in range(2))
    store.append(rows.where("id < 1000").coalesce(1))
    assert max(s["bytes"] for s in store.manifest()["shards"]) < 3 * 20_000  # one large partition is cut
    base, new = store.manifest(), store._write(rows.where("id >= 1000 and id < 2000").coalesce(1))
    other.vacuum(1)  # files that are written and not yet committed stay
    other.append(rows.where("id >= 2000 and id < 3000").coalesce(1))
    with pytest.raises(FileExistsError):
        store.commit(base, base["shards"] + new, rows.schema.json())
    store._commit_on_top(lambda b: (b["shards"] + new, rows.schema.json()))  # and are committed on top of the other writer
    once = {"n": 0}
    manifest = store.manifest

    def overtaken(version=None):
        made = manifest(version)
        if once["n"] < 2:
            once["n"] += 1
            if once["n"] == 2:  # a writer appends after the merge has read its manifest
                other.append(rows.where("id >= 3000").coalesce(1))
        return made

    store.manifest = overtaken
    store.compact()
    store.manifest = manifest
    store.vacuum(1, 0)
    assert sorted(r.id for r in other.read().collect()) == list(range(4000))


def test_sharding_edge_cases(odd, none):
    clash = odd.select("doc_id", "lang", F.lit("s").alias("shard"), F.lit(1).alias("version"))
    assert sharding.shard(clash).columns == ["doc_id", "lang", "shard_input", "version_input", "shard", "version"]
    rows = sharding.shard(odd)
    assert rows.count() == 9 and rows.columns == [*odd.columns, "shard", "version"] and sharding.shard(none).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "decontamination", "mixing", "sharding"]
    rows = corpus_pipeline.run(spark, sf_dir)
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows.columns[: len(source.columns)] == source.columns
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0.1 * source.count() < len(ids) < source.count()


def test_pipeline_stages_start_from_shrunk_heaps(spark, odd, monkeypatch, sf_dir):
    import corpus_pipeline

    # each stage first gives back what the heap has grown to before
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    sizes = []
    for module, name in ((quality_rules, "keep"), (near_dedup, "keep"), (decontamination, "keep"), (mixing, "keep"), (sharding, "shard")):
        monkeypatch.setattr(module, name, lambda docs, *_: sizes.append(heap.totalMemory() >> 20) or docs)
    for _, stage in corpus_pipeline.STAGES:
        spark.range(0, 1_000_000, 1, 2).groupBy("id").agg(F.collect_list("id").alias("a")).where("size(a) > 3").count()
        grown = heap.totalMemory() >> 20
        stage(spark, odd, sf_dir)
        assert sizes[-1] < 0.8 * grown


def test_word_hashes_depend_on_the_word_alone():
    # equal wherever the word stands, in either case and between any white space; also across the pieces of a long text
    tables = near_dedup.powers()
    words = ["a", "b", "ab", "ba", "aa", "aaa", "\x00", "\x00\x00", "Straße", "é", "x" * 70_000, "x" * 70_001]
    one = {w: near_dedup.word_hashes(w.encode(), tables)[0] for w in words}
    assert len(set(one.values())) == len(words)
    rng = np.random.default_rng(1)
    order = [words[k] for k in rng.integers(0, 10, 30_000)] + [words[10], "b", words[11], "Ab", "BA"]
    text = "".join(w + rng.choice([" ", "\n", "\t ", " \x0b\x0c", "\r\n"]) for w in order)
    pieces = list(near_dedup._pieces(text.encode()))
    assert b"".join(pieces) == text.encode() and len(pieces) > 3
    got = np.concatenate([near_dedup.word_hashes(p, tables) for p in pieces])
    assert got.tolist() == [one[w.lower() if w.isascii() else w] for w in order]
    assert near_dedup.shingle_set(" \n", 4, tables).tolist() == [] and len(near_dedup.shingle_set("a b c", 4, tables)) == 1
    assert len(near_dedup.shingle_set(text, 4, tables)) == len({tuple(g) for g in zip(*[got[k:] for k in range(4)])})
