import itertools

import numpy as np
from pyspark.sql import functions as F

from stromalens.operators import retrieval as V, tree as Y
from stromalens.streaming import streams


def plain_linkage(names, d):
    """Textbook average linkage: merge the closest pair until one cluster is left."""
    clusters = {n: [n] for n in names}
    out = []
    while len(clusters) > 1:
        def gap(p):
            return np.mean([d[frozenset((a, b))] for a in clusters[p[0]] for b in clusters[p[1]]])
        p = min(itertools.combinations(sorted(clusters), 2), key=gap)
        out.append((gap(p), frozenset(clusters[p[0]] + clusters[p[1]])))
        clusters[p[0]] = clusters[p[0]] + clusters.pop(p[1])
    return out


def test_linkage_matches_textbook(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for case in ("p", "q"):
        names = [f"n{i:02d}" for i in range(13)]
        pts = rng.random((13, 2))
        d = {frozenset((a, b)): float(np.linalg.norm(pts[i] - pts[j])) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2)}
        rows += [(case, *sorted(k), v) for k, v in d.items()]
        want[case] = plain_linkage(names, d)
    pairs = spark.createDataFrame(rows, "case_id string, a string, b string, d double")
    m = Y.average_linkage(pairs)
    for case in ("p", "q"):
        got = sorted((r.dist, frozenset(r.left_leaves + r.right_leaves)) for r in m.filter(F.col("case_id") == case).collect())
        assert [g[1] for g in got] == [w[1] for w in sorted(want[case])] and np.allclose([g[0] for g in got], [w[0] for w in sorted(want[case])])
    coph = {(r.case_id, r.a, r.b): r.d for r in Y.cophenetic_matrix(m, True).collect()}
    assert len(coph) == 2 * 78 and abs(max(coph.values()) - 1) < 1e-12
    names = [f"n{i:02d}" for i in range(13)]
    for a, b, c in itertools.combinations(names, 3):  # ultrametric
        x = sorted((coph["p", a, b], coph["p", a, c], coph["p", b, c]))
        assert abs(x[1] - x[2]) < 1e-12
    groups = Y.structure_groups(m, 4)
    for case in ("p", "q"):
        g = groups.filter(F.col("case_id") == case).orderBy("leaf_pos").collect()
        seen = []
        for r in g:
            if r.group_id not in seen:
                seen.append(r.group_id)
        assert seen == [1, 2, 3, 4] and len(g) == 13
    spans = Y.leaf_spans(groups).filter("case_id = 'p'").orderBy("group_id").collect()
    assert [s.leaf_start for s in spans][0] == 0 and spans[-1].leaf_end == 12 and sum(s.cluster_count for s in spans) == 13


def test_chunks_cover_the_text(spark):
    text = " \r\n" + "Alpha beta gamma. " * 40 + "\n\n" + "x" * 300 + "  "
    d = spark.createDataFrame([("d", text), ("e", "   "), ("f", None), ("g", "short")], "document_id string, text string")
    rows = V.chunk_documents(d, 100, 20).orderBy("document_id", "chunk_id").collect()
    body = text.replace("\r\n", "\n").strip()
    own = [r for r in rows if r.document_id == "d"]
    assert own[0].start == 0 and own[-1].stop == len(body)
    for a, b in zip(own, own[1:]):
        assert b.start == max(a.start + 1, a.stop - 20) and a.text == body[a.start:a.stop].strip() and a.stop - a.start <= 100
    assert [r.point_id for r in rows if r.document_id == "g"] == ["g:chunk-0001"]
    assert {r.document_id for r in V.documents_without_chunks(d).collect()} == {"e", "f"}


def slow_chunks(body, size, overlap):
    """By characters: step back from the limit to the nearest blank or paragraph break."""
    at, spans = 0, []
    while at < len(body):
        stop = at + size
        if stop >= len(body):
            stop = len(body)
        else:
            for i in range(stop - 1, at + size // 2, -1):
                if body[i] == " " or body[i:i + 2] == "\n\n" and i + 2 <= stop:
                    stop = i + 1
                    break
        if body[at:stop].strip():
            spans.append((at, stop, body[at:stop].strip()))
        if stop == len(body):
            return spans
        at = max(at + 1, stop - overlap)
    return spans


def test_chunks_match_a_slow_walk(spark):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("ab. \né😀"), int(rng.integers(0, 300)))) for _ in range(150)] + [None, "", "\n\n", "x" * 90]
    d = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    for size, overlap in ((1, 0), (7, 3), (20, 25), (50, 10)):
        got = {}
        for r in V.chunk_documents(d, size, overlap).collect():
            got.setdefault(int(r.document_id), []).append((r.start, r.stop, r.text))
        for i, t in enumerate(texts):
            assert sorted(got.get(i, [])) == sorted(slow_chunks((t or "").replace("\r\n", "\n").strip(), size, overlap)), (i, size, overlap)


def test_score_tiles(monkeypatch):
    import pandas as pd
    rng = np.random.default_rng(3)
    c = pd.DataFrame({"_k": range(40), "_v": list(rng.integers(-2, 3, (40, 3)).astype(float))})
    q = pd.DataFrame({"_k": range(9), "_v": list(rng.integers(-2, 3, (9, 3)).astype(float))})
    whole = V._best_of_block(c, q, 4, "c", "q", 9)
    monkeypatch.setattr(V, "TILE", 80)
    assert whole.reset_index(drop=True).equals(V._best_of_block(c, q, 4, "c", "q", 9).reset_index(drop=True))


def test_retrieve_with_plug_ins_and_filter(spark):
    def vectors(texts):
        import pandas as pd
        return pd.Series([[float(t.lower().count("lung")), float(t.lower().count("breast")), float(len(t.split()))] for t in texts])

    docs = spark.createDataFrame([("lung-atlas", "Lung stroma and lung vessels"), ("breast-atlas", "Breast ducts and breast stroma")], "document_id string, text string")
    model = F.pandas_udf(vectors, "array<double>")
    chunks = V.embed_with(V.chunk_documents(docs), model)
    q = V.embed_with(spark.createDataFrame([(1, "lung vessels")], "query_id int, question string"), model, "question")
    got = V.retrieve(q, chunks, 2, document_ids=["lung-atlas"]).collect()
    assert [r.document_id for r in got] == ["lung-atlas"] and got[0].citation_id == "C1"
    both = V.retrieve(q, chunks, 2).orderBy("position").collect()
    assert [r.document_id for r in both] == ["lung-atlas", "breast-atlas"]
    none = V.vector_top_k(chunks, q, 4, document_ids=["other"])
    assert V.retrieval_stats(q, none, V.retrieve(q, chunks, 2, ["other"]), True).first().error is not None


def test_top_k_blocks_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(6)
    m = rng.integers(-2, 3, (60, 4)).astype(float)
    q = rng.integers(-2, 3, (7, 4)).astype(float)
    m[5] = 0
    chunks = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "point_id int, vector array<double>").repartition(5)
    qs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id int, vector array<double>")

    def result():
        return sorted((r.query_id, r["rank"], r.point_id) for r in V.vector_top_k(chunks, qs, 6).collect())
    one = result()
    monkeypatch.setattr(V, "QUERY_ROWS", 3)
    monkeypatch.setattr(V, "CHUNK_ROWS", 11)
    assert result() == one
    assert V.vector_top_k(chunks, qs.limit(0), 6).count() == 0 and V.vector_top_k(chunks.limit(0), qs, 6).count() == 0
    for i in range(7):
        n = np.linalg.norm(m, axis=1) * np.linalg.norm(q[i])
        s = np.round(np.divide(m @ q[i], n, out=np.zeros(60), where=n > 0), 9)
        want = sorted(range(60), key=lambda j: (-s[j], j))[:6]
        assert [p for a, _, p in one if a == i] == want


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0, 5.0], [1.0, 1.0])]
    d = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in d.select(V.cosine("a", "b")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and abs(got[2] - 2 / (27**0.5 * 2**0.5)) < 1e-12


def test_upsert_stream_log(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "point_id string, version int, text string"
    spark.createDataFrame([("a", 1, "old"), ("b", 1, "b")], schema).coalesce(1).write.parquet(src)
    run = lambda: streams.log_upserts(spark.readStream.schema(schema).parquet(src), log, str(tmp_path / "state")).awaitTermination()
    run()
    spark.createDataFrame([("a", 2, "new")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(tuple(r) for r in streams.current_points(spark, log).select("point_id", "text").collect()) == [("a", "new"), ("b", "b")]
    streams.compact(spark, log, str(tmp_path / "log2"))
    assert streams.current_points(spark, str(tmp_path / "log2")).count() == 2


def test_late_rows_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "ts timestamp, source string, qc_status string"

    def add(*rows):
        spark.createDataFrame(list(rows), "t string, source string, qc_status string").select(F.col("t").cast("timestamp").alias("ts"), "source", "qc_status").coalesce(1).write.mode("append").parquet(src)
    run = lambda: streams.append_to(streams.qc_windows(spark.readStream.schema(schema).parquet(src)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    add(("2024-01-01 10:00:00", "a", "ok"), ("2024-01-03 00:00:00", "a", "ok"))
    run()
    add(("2024-01-01 11:00:00", "a", "fail"), ("2024-01-05 00:00:00", "a", "ok"))
    run()
    got = {str(r.window_start)[:10]: (r.total_bundles, r.failed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01": (1, 0), "2024-01-03": (1, 0)}


def test_a_thousand_trees_at_once(spark):
    """Cophenetic distances of each case against merging the closest pair again and again."""
    import itertools
    import random

    r = random.Random(3)
    rows, want = [], {}
    for case in range(1000):
        labels = [f"l{i}" for i in range(2 + case % 6)]
        d = {p: r.choice([r.random(), 0.5]) if case % 3 else r.random() for p in itertools.combinations(labels, 2)}
        rows += [(case, a, b, v) for (a, b), v in d.items()]
        groups, heights = [(x,) for x in labels], {}
        while len(groups) > 1:
            mean = lambda x, y: sum(d[min(i, j), max(i, j)] for i in x for j in y) / len(x) / len(y)
            x, y = min(itertools.combinations(groups, 2), key=lambda p: (mean(*p), min(p[0]), min(p[1])))
            heights.update({(case, min(i, j), max(i, j)): mean(x, y) for i in x for j in y})
            groups = [g for g in groups if g not in (x, y)] + [x + y]
        if case % 3 == 0:  # without ties the tree is unique
            want.update(heights)
    merges = Y.average_linkage(spark.createDataFrame(rows, "case_id long, a string, b string, d double"))
    got = {(x["case_id"], x["a"], x["b"]): x["d"] for x in Y.cophenetic_matrix(merges).collect()}
    assert len(got) == len(rows) and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_chunking_holds_a_bounded_part_of_a_batch():
    """A batch of 8 million characters: the arrays over them once took 40 bytes each."""
    import tracemalloc

    import pandas as pd

    texts = pd.Series([("some words. " * 200)[i % 7:] for i in range(3400)] + [None, "", " x "])
    tracemalloc.start()
    got = V._spans(texts, 1200, 120)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    alone = [V._pieces(texts.iloc[i:i + 1], 1200, 120)[0] for i in (0, 1, 3399, 3400, 3401, 3402)]
    assert [got[i] for i in (0, 1, 3399, 3400, 3401, 3402)] == alone and len(alone[0]) > 1 and alone[3:] == [[], [], [{"start": 0, "stop": 1, "text": "x"}]]


def test_chunking_lays_out_a_bounded_part_of_a_batch(monkeypatch):
    """A worker lays out ``CHUNK_CHARS`` at a time, not its whole batch, and cuts the same chunks."""
    import pandas as pd
    from stromalens.operators import retrieval
    texts = pd.Series([f"word{i} " * (20 + i % 50) for i in range(300)] + [None, ""])
    whole, laid, pieces = list(retrieval._pieces(texts, 100, 10)), [], retrieval._pieces

    def recorded(part, size, overlap):
        laid.append(sum(len(t or "") for t in part))
        return pieces(part, size, overlap)
    monkeypatch.setattr(retrieval, "CHUNK_CHARS", 4000)
    monkeypatch.setattr(retrieval, "_pieces", recorded)
    assert list(retrieval._spans(texts, 100, 10)) == whole
    assert len(laid) > 10 and max(laid) < 4000 + texts.str.len().max()
