"""op1 (packing), op8 (quality), op9 (mixing) and the corpus pipeline."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clauseflow.llm import common, mixing, packing, quality
import brute

SF, SF_LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


# --- op1 ---

def _texts_of(packed, length):
    decode, parts = packing.encoder().decode, {}
    for r in packing.unpack(packed, length).collect():
        assert 0 < len(r["ids"]) <= length
        parts.setdefault(r["doc_id"], []).append((r["part"], r["ids"]))
    return parts, decode


def _check_rows(packed, length):
    kind = packing.id_type(packing.END_ID, length)
    for r in packed.collect():
        ids, places = np.frombuffer(r["input_ids"], kind), np.frombuffer(r["position_ids"], kind)
        bounds = r["cu_seqlens"]
        assert len(ids) == len(places) == length and bounds[0] == 0 and bounds[-1] == r["n_tokens"] <= length
        assert len(r["doc_ids"]) == len(r["doc_parts"]) == len(bounds) - 1 and sorted(bounds) == bounds
        for a, b in zip(bounds, bounds[1:]):
            assert places[a:b].tolist() == list(range(b - a))
        assert (ids[r["n_tokens"]:] == packing.END_ID).all() and (places[r["n_tokens"]:] == 0).all()


@pytest.mark.parametrize("length, block", [(2048, 1 << 21), (16, 300)])
def test_packing_round_trip(make_docs, odd_rows, length, block):
    rows = odd_rows if length > 16 else [r for r in odd_rows if len(r[1] or "") < 2000]
    rows = [(i, t) for i, (_, t, *_) in enumerate(rows)] + [(None, "no id"), (999, "<|endoftext|> is text")]
    packed = packing.pack(make_docs(rows), length, block).cache()
    _check_rows(packed, length)
    parts, decode = _texts_of(packed, length)
    assert set(parts) == {d for d, _ in rows}
    for d, text in rows:
        ids = [i for _, part in sorted(parts[d]) for i in part]
        assert [k for k, _ in sorted(parts[d])] == list(range(len(parts[d])))
        assert ids[-1] == packing.END_ID and decode(ids[:-1]) == (text or "")
    assert packed.select("pack").distinct().count() == packed.count()


def test_packing_repeated_rows_and_empty_table(make_docs):
    packed = packing.pack(make_docs([(1, "same text"), (1, "same text"), (1, None)]).coalesce(1))
    (row,) = packed.collect()
    assert row["doc_ids"] == [1, 1, 1] and packing.pack(make_docs([])).count() == 0


def test_packing_fills_rows(spark):
    packed = packing.pack(common.table(spark, SF, "documents")).cache()
    n, used = packed.selectExpr("count(*)", "sum(n_tokens)").first()
    parts = packed.selectExpr("spark_partition_id() as p").distinct().count()
    assert used > 2048 * (n - parts) * 0.995


def test_best_fit_decreasing_against_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        length = int(rng.integers(1, 60))
        sizes = rng.integers(1, length + 1, rng.integers(0, 80))
        rows, room = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [r for r in range(len(room)) if room[r] >= sizes[i]]
            if fits:
                best = min(room[r] for r in fits)
            else:
                rows.append([])
                room.append(length)
                best = length
            r = max(r for r in range(len(room)) if room[r] == best)
            rows[r].append(i)
            room[r] -= sizes[i]
        got = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for r in got for i in r) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in r) <= length for r in got) and len(got) == len(rows)


def test_written_matrices(spark, make_docs):
    from clauseflow.llm import warc
    packed = packing.pack(make_docs([(i, f"text number {i} " * 40) for i in range(30)]), 64)
    folder = common.shared_folder(spark, "test-matrices")
    files = packing.write_matrices(packed, folder, 64).collect()
    where, root = warc._open(folder)
    load = lambda name: np.load(where.open_input_file(f"{root}/{name}.npy"))
    total = 0
    for f in files:
        ids, bounds, at = load(f["name"] + ".ids"), load(f["name"] + ".cu_seqlens"), load(f["name"] + ".bounds_at")
        assert ids.shape == load(f["name"] + ".positions").shape == (f["n_rows"], 64)
        total += sum(int(bounds[b - 1]) for b in at[1:])
    assert total == sum(f["n_tokens"] for f in files) == packed.selectExpr("sum(n_tokens)").first()[0]


def test_matrices_read_back_are_the_packed_rows(spark, make_docs, odd_rows):
    def rows(df):
        return sorted(tuple(map(tuple, (x if isinstance(x, list) else [x] for x in r))) for r in df.collect())
    for docs, length in ((odd_rows, 2048), ([(None, None), (3, "")], 16), ([], 16)):
        packed = packing.pack(make_docs(docs).coalesce(1), length, block_ids=20_000)
        folder = common.shared_folder(spark, "test-matrices")
        got = packing.read_matrices(packing.write_matrices(packed, folder, length), folder)
        assert rows(got) == rows(packed) and got.columns == packed.columns


def test_registered_packing_reads_what_it_wrote(spark):
    whole = packing.op1(spark, "/root/testdata/sf0.001")
    want = packing.pack(common.table(spark, "/root/testdata/sf0.001", "documents"))
    total = "sum(n_tokens)", "count(1)", "sum(hash(input_ids, position_ids, cu_seqlens, doc_ids, doc_parts))"
    assert whole.selectExpr(*total).first() == want.selectExpr(*total).first()


# --- op8 ---

def test_quality_on_rows_kept_aside(spark):
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SF_LARGE, "labels").collect()}
    rows = quality.op8(spark, SF_LARGE).collect()
    assert len(rows) == 10_000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    aside = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    y = np.array([a[2] for a in aside])
    right = np.mean([a[1] == a[2] for a in aside])
    assert len(aside) > 800 and right > 0.97 > y.mean() + 0.1  # the share of label 1 is what a constant gets
    clean_lost = np.mean([a[1] == 0 for a in aside if a[2] == 1])
    assert clean_lost < 0.01
    scores = np.array([a[0] for a in aside])
    for low, high in ((0, 0.5), (0.5, 1.01)):  # calibrated
        part = (scores >= low) & (scores < high)
        assert abs(scores[part].mean() - y[part].mean()) < 0.1


def test_quality_reads_text_only(spark, make_docs, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 100_000]
    labels = spark.createDataFrame([(d, i % 2, "x") for i, (d, *_) in enumerate(rows * 3)] + [(4, None, "x"), (5, 7, "x"), (999, 1, "x")],
                                   "doc_id long, quality int, score string")
    got = quality.score(make_docs(rows), labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], set()).add(r["score"])
    assert by_text[1] == by_text[2] and len(by_text[6]) == 1 and by_text[4] == by_text[6]


def test_quality_without_labels_or_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(make_docs([(1, "some text"), (2, None)]), none).collect()
    assert {r["score"] for r in got} == {0.5}
    assert quality.score(make_docs([]), none).count() == 0
    assert quality.accepted(make_docs([]), none).count() == 0


def test_held_out_labels_are_not_learned(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    from pyspark.sql import functions as F
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.score(docs, x).collect())) for x in (labels, turned))
    assert a == b


# --- op9 ---

def test_mixing_against_plain_queue(make_docs):
    rows, rng = [], np.random.default_rng(4)
    for i in range(300):
        source = [None, "a", "b", "c", "B", "é", ""][int(rng.integers(7))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 40) * (20 if source == "a" else 1))), source))
    rows += [(300, None, "a"), (301, " \t", None)]
    m = mixing.plan(make_docs(rows))
    got = {r["doc_id"]: r for r in m.copies(m.sizes).collect()}
    sizes = [(d, s, len(brute.SPACED.findall(t or ""))) for d, t, s in rows]
    taken, target = brute.mix(sizes)
    for d, s, size in sizes:
        assert got[d]["__size"] == size and got[d]["__size"] * got[d]["__copies"] == taken[d]
        assert got[d]["__target"] == pytest.approx(target[s]) and got[d]["__copies"] <= 3
    longest = max(size for *_, size in sizes)
    for s in target:
        assert abs(sum(taken[d] for d, s2, _ in sizes if s2 == s) - target[s]) <= longest
    repeated = sorted(r["doc_id"] for r in mixing.mixed(make_docs(rows)).collect())
    assert repeated == sorted(d for d, _, _ in sizes for _ in range(got[d]["__copies"]))


def test_mixing_orders_hot_keys_in_even_ranges(spark, make_docs):
    """Rows without an id, one source with half the rows and many small ones."""
    docs = make_docs([(None, f"w{i} " * (1 + i % 7), "hot") for i in range(3000)]
                     + [(i, "a b c " * (1 + i % 3), f"s{i % 400}") for i in range(3000)])
    m = mixing.plan(docs, range_rows=200)
    rows = m.sizes.select("source", "__size", mixing._order().alias("o"))
    for keys, by in ((["source"], ["o"]), ([], ["__size", "o"])):
        placed = mixing._running(common.stash(rows, "test"), keys, by, 200)
        upto, total = {}, 0
        for r in placed.orderBy(*keys, *by).collect():
            k = r["source"] if keys else None
            upto[k] = upto.get(k, 0) + r["__size"]
            assert r["upto"] == upto[k]
            total += 1
        assert total == 6000
    ordered = rows.repartitionByRange(30, "source", "o").groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0]
    assert ordered < 3 * 6000 / 30
    taken = {r["source"]: r["n"] for r in m.copies(m.sizes).groupBy("source").agg(F.sum(F.col("__size") * F.col("__copies")).alias("n")).collect()}
    target = {r["source"]: r["target"] for r in m.sources.collect()}
    assert all(abs(taken[s] - target[s]) <= 3 * 18 + 1 for s in taken)


def test_mixing_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    m = mixing.plan(docs, range_rows=3)
    got = m.copies(m.sizes).collect()
    assert len(got) == len(odd_rows) and sum(r["__size"] * r["__copies"] for r in got) <= sum(r["__size"] for r in got)
    assert mixing.mixed(docs).columns == docs.columns
    again = mixing.plan(docs, range_rows=50)
    assert sorted(map(str, again.copies(again.sizes).collect())) == sorted(map(str, got))


def test_mixing_empty_tables(make_docs):
    assert mixing.mixed(make_docs([])).count() == 0
    m = mixing.plan(make_docs([(1, None, "a"), (2, "", None)]))
    assert {(r["__size"], r["__target"], r["__copies"] * r["__size"]) for r in m.copies(m.sizes).collect()} == {(0, 0.0, 0)}


# --- SQL and the pipeline ---

@pytest.mark.parametrize("name", ["op3_license_scan", "op4_vector_links", "op5_benchmark_leaks", "op6_secret_scan", "op7_warc_round_trip", "op9_weighted_fair_mix", "op10_jaccard_join"])
def test_query_matches_its_sql(spark, name):
    from clauseflow.llm import registry
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))


def test_pipeline_stages_against_plain_versions(spark):
    docs = common.table(spark, SF, "documents")
    columns, outs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stash(stage(spark, docs, SF), "test-stage")
        outs.append(docs)
        assert name == "packing" or docs.columns == columns
    good, unique, clean, mix, packed = outs
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect()}
    good_ids = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert np.mean([d in good_ids for d, q in labels.items() if q == 1]) > 0.98
    assert np.mean([d in good_ids for d, q in labels.items() if q == 0]) < 0.2

    rows = sorted(tuple(r) for r in good.select("doc_id", "text").collect())
    roots, _ = brute.jaccard_components([t for _, t in rows], 5, 80, 100)
    assert {r["doc_id"] for r in unique.collect()} == {rows[r][0] for r in set(roots)}

    rows = [tuple(r) for r in unique.select("doc_id", "text").collect()]
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    bad = {x[0] for x in brute.leaks(rows, items)}
    assert bad and {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - bad

    rows = [(r["doc_id"], r["source"], len(brute.SPACED.findall(r["text"] or ""))) for r in clean.collect()]
    taken, _ = brute.mix(rows)
    size = {d: n for d, _, n in rows}
    got = [r["doc_id"] for r in mix.select("doc_id").collect()]
    assert all(got.count(d) * size[d] == taken[d] for d in size)

    parts, decode = _texts_of(packed, 2048)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert sorted(d for d in parts for k, _ in parts[d] if k == 0) == sorted(got)
    once = [d for d in parts if got.count(d) == 1]
    assert once and all(decode([i for _, p in sorted(parts[d]) for i in p][:-1]) == texts[d] for d in once)


def test_pipeline_empty_and_odd_rows(spark, make_docs, odd_rows):
    for rows in ([], odd_rows):
        docs = make_docs(rows)
        for name, stage in corpus_pipeline.STAGES:
            out = common.stash(stage(spark, docs, "/root/testdata/sf0.001"), "test-stage")
            assert name == "packing" or out.columns == docs.columns
            docs = out


