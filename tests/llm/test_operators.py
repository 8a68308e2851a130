"""Text operators against brute force, on rows with nulls, empty texts, ties and repeats."""

import hashlib
import random
import re
import uuid
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stromalens.functions import lineage
from stromalens.llm import bpe, graph, html_text, language, near_copies, packing, quality, queries, simhash, substrings, token_files, topk, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, kept string, z int, other int, key string, score int"


def some_docs(seed=3, n=60):
    """(doc_id, text) with nulls, blanks, repeats, loops and shared passages."""
    r = random.Random(seed)
    w = lambda k: " ".join(r.choice("abcdefgh") + str(r.randint(0, 30)) for _ in range(k))
    shared = [w(60) for _ in range(4)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice([r.choice(shared), w(r.randint(0, 40)), "x " * r.randint(0, 50), "X y " * r.randint(0, 40), r.choice(shared)[r.randint(0, 40):], "\n\t", "é ü" * 9]))
        out.append((i, None if i % 13 == 5 else "\n".join(parts)))
    return out


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "k", 1, 2, "key", 3) for i, t in rows], DOC_SCHEMA)


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def docs():
    return some_docs()


def test_top_k_matches_sql_and_defines_odd_rows(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op1_top_k_search"]).df().sort_values(["query_id", "rank"]).reset_index(drop=True)
    got = queries.QUERIES["op1_top_k_search"](spark, SF).toPandas()[list(want.columns)].sort_values(["query_id", "rank"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [1.0, float("nan")], 1), (5, [None, 1.0], 1), (6, [-1.0, 0.5], 1), (None, [9.0, 9.0], 1), (7, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 2 == 0, 2).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (2, 1, 0, 65536), (2, 2, 1, 65536), (6, 1, 0, -65536), (6, 2, 1, -65536)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 2 == 0, 2).count() == 0
    three = topk.top_k(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()  # a repeated candidate takes a rank for each row
    assert [r["vec_id"] for r in three] == [1, 2, 2] and [r["rank"] for r in three] == [1, 2, 3]


def test_search_stops_early_and_stays_exact():
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(-60, 60, (3000, 8)), np.tile(r.integers(-60, 60, 8), (500, 1))]).astype(float)
    ids = r.permutation(len(x))
    got = topk.search_block(x[:20], ids[:20], x, ids, topk.choose_pivots(x[:200], 12), 5)
    for q in range(20):
        s = (x @ x[q]).astype(int)
        best = sorted((-s[i], ids[i]) for i in range(len(x)) if ids[i] != ids[q])[:5]
        assert [(-g[2], g[1]) for g in got if g[0] == ids[q]] == [(a, b) for a, b in best]


def test_bpe_equals_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, coder, r = Tokenizer.from_file(path), bpe.coder(path), random.Random(4)
    letters = list("aéÀ'stmIi . \n  \x1c\x85́1²　ab,.! ’一㐀࢏") + ["<|endoftext|>", "the", " the", "'ll", "\x01", "aaaa", "    ", "\r\n", "ing", "\U0003134b"]
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        ids = np.frombuffer(coder.encode(t.encode()), "<i4")
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
        assert coder.decode(ids.astype(np.int64), np.array([len(ids)])) == [t]
    long = "".join(r.choice("abcdeainthersolm") for _ in range(20000))
    assert np.frombuffer(coder.encode(long.encode()), "<i4").tolist() == tok.encode(long, add_special_tokens=False).ids
    got = {row["doc_id"]: row for row in bpe.decode(bpe.encode(frame(spark, docs), path), path).collect()}
    for i, t in docs:
        assert got[i]["text"] == (t or "") and got[i]["ids"] == tok.encode(t or "", add_special_tokens=False).ids and got[i]["n_tokens"] == len(got[i]["ids"])
    assert bpe.encode(frame(spark, docs).limit(0), path).count() == 0


def test_url_rules(spark):
    con = duckdb.connect()
    cases = ["http://example.org/en/12", "https://A.Example.ORG/es/x?y#z", "http://example.org", "http://example.org/", "http://notexample.org/es/", "x://com/fr/", "ftp://shop.com/de/a", None, "", "no scheme/de/",
             "http://example.org.evil.net/es/", "http://a..com/fr/", "http://u@h.com:80/de/", "a://b://c.org/q", "http://com/fr/\n/é", "://org/x", "http://example.org?/es/", "http://.org/"]
    frame_ = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)] + [(1, cases[1], "x", "y")], "page_id long, url string, rule string, host string")
    con.register("pages", pd.DataFrame({"page_id": [*range(len(cases)), 1], "url": [*cases, cases[1]]}))
    want = con.execute(queries._OP3_SQL).df().sort_values(["page_id"]).reset_index(drop=True)
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = urls.judge(frame_, rules).toPandas().sort_values(["page_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got.fillna("-"), want[got.columns].fillna("-"), check_dtype=False)
    assert urls.judge(frame_, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == len(cases) + 1
    assert urls.judge(frame_.limit(0), rules).count() == 0


def slow_print(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(prints):
    names = sorted(prints)
    up = {i: i for i in names}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in names:
        for b in names:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in names}


def test_simhash_groups(spark, docs):
    rows = [*docs, (100, docs[1][1]), (101, "one"), (102, "ONE"), (103, ""), (104, " \n")]
    prints = {i: slow_print(t) for i, t in rows}
    want = slow_groups(prints)
    got = {r["doc_id"]: r for r in simhash.groups(frame(spark, rows)).collect()}
    assert {i: (r["fp"] % (1 << 64), r["component_id"]) for i, r in got.items()} == {i: (prints[i], want[i]) for i in prints}
    kept = simhash.one_of_each(frame(spark, [*rows, rows[3], (None, "unlike all others")]))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1 and kept.columns == frame(spark, []).columns
    assert simhash.groups(frame(spark, [])).count() == 0


def test_heavy_blocks_lose_no_link(spark):
    r = random.Random(5)
    prints = set()
    for _ in range(3):
        base = r.getrandbits(64)
        for _ in range(250):
            x = base
            for b in r.sample(range(64), r.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    want = slow_groups({x: x for x in prints})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {row["node"]: row["root"] for row in graph.components(simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "fp long"), 3, group=60)).collect()}
    sets = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert {frozenset(map(signed, s)) for s in sets(want) if len(s) > 1} == sets(got)


def slow_near_copies(texts):
    """The smallest id linked to each by a Jaccard similarity of 0.8 of five-word shingles, directly or through others."""
    sets = {i: {tuple(w[k:k + 5]) for w in [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()] for k in range(max(1, len(w) - 4))} for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and 4 * max(len(sets[a]), len(sets[b])) <= 5 * min(len(sets[a]), len(sets[b])) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_pipeline_drops_near_copies_by_jaccard(spark):
    import corpus_pipeline

    r = random.Random(8)
    rows, base = [], [f"w{i}" for i in range(5000)]
    for i in range(40):
        text = r.choices(base, k=r.randint(120, 400))
        rows.append((i, " ".join(text)))
        for k, share in ((100, 0.015), (200, 0.08)):  # about 0.86 and 0.5 of the shingles alike
            copy = list(text)
            for at in r.sample(range(len(text)), max(1, int(share * len(text)))):
                copy[at] = "other"
            rows.append((i + k, " ".join(copy)))
    passage = " ".join(r.choices(base, k=60))
    rows += [(300 + i, passage + " " + " ".join(r.choices(base, k=60))) for i in range(40)]
    rows += [(400 + i, " ".join([f"v{i}" if j == 90 else w for j, w in enumerate(base[:180])])) for i in range(60)] + [(500, ""), (501, None), (502, "one two"), (503, "One two ")]
    groups = slow_near_copies(dict(rows))
    want, near = {i for i in groups if groups[i] == i}, {i for i in groups if groups[i] != i}
    assert len(near & set(range(100, 140))) > 30 and set(range(200, 240)) | set(range(300, 340)) <= want
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema), SF)
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(want)
    assert near_copies.one_of_each(frame(spark, [])).count() == 0


def test_near_copies_in_crowds_are_all_linked(spark):
    """Texts share one long passage, which crowds every band without making them copies; pairs of them are copies."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(4000)]
    passage = " ".join(r.choices(base, k=300))
    rows = []
    for i in range(300):
        own = r.choices(base, k=40)
        rows.append((i, passage + " " + " ".join(own)))
        if i < 40:
            rows.append((1000 + i, passage + " " + " ".join([*r.choices(base, k=30), *own[30:]])))
    groups = slow_near_copies(dict(rows))
    want = [i for i in groups if groups[i] == i]
    assert sorted(want) == list(range(300))
    assert sorted(x["doc_id"] for x in near_copies.one_of_each(frame(spark, rows)).collect()) == sorted(want)


def test_sets_in_common_are_counted_block_by_block(monkeypatch):
    r = np.random.default_rng(5)
    left, right = ([np.unique(r.integers(0, 90, r.integers(0, 60))) for _ in range(n)] for n in (7, 5))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert near_copies._shared(left, right).tolist() == want
    monkeypatch.setattr(near_copies, "SHARED", 8)
    assert near_copies._shared(left, right).tolist() == want


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    pieces = packing.token_pieces(frame(spark, [*docs, docs[2]]), path, 64, 0)
    packed = packing.pack_pieces(pieces, 64)
    rows = packed.collect()
    want = Counter()
    for i, t in [*docs, docs[2]]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 64)):
            want[i, k, s, len(ids[s:s + 64]), np.array(ids[s:s + 64], "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 64) + 1
    joined = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in joined) == 4 * total and all(len(r["ids"]) == 4 * r["length"] for r in joined)
    assert packing.pack_pieces(pieces.limit(0), 64).count() == 0


def test_packing_takes_one_python_worker_a_task(spark, docs, monkeypatch):
    """The pieces are cut and ranked in one pass through Python, and packed as if ranked apart."""
    written = []
    monkeypatch.setattr(packing, "materialize", lambda df: written.append(df._jdf.queryExecution().executedPlan().toString()) or lineage.materialize(df))
    packed = queries.packed_documents(frame(spark, docs).repartition(3), ids=True)
    assert written[0].count("MapInArrow") == 1
    path = public_tokenizers.path("word_bpe_49k.json")
    apart = packing.pack_pieces(packing.token_pieces(frame(spark, docs).repartition(3), path, 2048, 0), 2048)
    places = ["sequence_id", "offset", "length"]
    assert sorted(map(tuple, packed.select(places).collect())) == sorted(map(tuple, apart.select(places).collect()))
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]


def test_bins_are_as_few_as_can_be():
    r = random.Random(6)
    for _ in range(30):
        counts = Counter(r.randint(1, 40) for _ in range(r.randint(1, 200)))
        plan = packing.plan_bins(counts, 40)
        assert sum(plan[:, 2]) == sum(counts.values())
        total = sum(k * v for k, v in counts.items())
        used = max(row[4] + row[2] // row[3] for row in plan.tolist())
        assert -(-total // 40) <= used <= -(-total // 40) * 1.1 + 3


def test_html():
    show = html_text.visible_text
    assert show("<p>a<p>b<ul><li>x<li>y <b>z</b><ol start=3><li>q<li>r</ol></ul>t") == "a\n\nb\n\n- x\n- y z\n  3. q\n  4. r\n\nt"
    assert show("<table><tr><td>aa<td>b<tr><td>c<td>dd<tr><td colspan=2>a long line</table>z") == "aa  b\nc   dd\na long line\n\nz"
    assert show("<table><tr><th>k<th>数字<th>v<tr><td rowspan=2>a<td>1<td>x<tr><td>22<td>y</table>") == "k  数字  v\na  1     x\n   22    y"
    assert show("a <span hidden>no</span>b<div style='display : none'>k</div>c<!-- > -->d<script>'</p>'</script><style>x</style>e") == "a bcde"
    assert show("<head><title>T</title><meta x><body>&lt;b&gt; &copy; &amp;amp;<br>n<pre>\n x\n  y\n</pre>e") == "<b> © &amp;\nn\n\n x\n  y\n\ne"
    assert show("<dl><dt>t<dd>d<dt>u<dd>e</dl><blockquote>q<p>r</blockquote>") == "t\n    d\nu\n    e\n\n> q\n>\n> r"
    assert show("") == "" and show("  <p> ") == "" and show("1 < 2 <3") == "1 < 2 <3" and show("<a href='x>y'>l</a>") == "l"
    assert show("<div>" * 3000 + "x") == "x" and "z" in show("<table><td>" * 700 + "z")


def test_html_loses_no_visible_text():
    show = html_text.visible_text
    assert show('<script>var a="<!--";</script><p>text') == "text" and show("<title>a <!-- b</title><p>c<!-- d -->e") == "ce"
    assert show("<style>x<y a='</style><p>it's") == "it's"
    assert show("<table><tbody><form><tr><td>x</table>y") == "x\n\ny" and show("<table><tbody>text<tr><td>c</table>") == "text\nc"
    assert show("<table><thead><tr><td>h<tbody><div>d</div><tr><td>c</table>") == "d\nh\nc" and show("<table><tbody hidden>no<tr><td>no</tbody><tr><td>c</table>") == "c"
    assert show("a <b aria-hidden='true'>b</b> c<input class=hidden value=v><input type=hidden value=w>") == "a b cv"
    assert show("<svg><title>no</title><text>s</text></svg> <math><mi>m</mi></math>") == "s m" and show("<select><option>o<option>p</select>") == "o\np"
    assert show("a<i style='visibility:hidden'>no</i><canvas>no</canvas><template>no</template>") == "a"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (2, None, "t"), (3, "", "t")], "page_id long, html string, text string")
    assert sorted(map(tuple, html_text.extract(df).collect())) == [(1, "a"), (1, "a"), (2, ""), (3, "")]
    assert html_text.extract(df.limit(0)).count() == 0


def slow_counts(t):
    w, lines, windows, covered = words(t), [x for x in (t or "").split("\n") if words(x)], {}, set()
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i:i + 8]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs):
    rows = [*docs, docs[4], (200, "#$ a|b\n\n#$ a|b\nc"), (201, "good clean words here " + " ".join(f"w{i}" for i in range(40))), (202, " ".join(f"junk%%{i % 7} bad&&" for i in range(60)) + " " + " ".join(f"q{i}" for i in range(200)))]
    df = frame(spark, rows)
    trusted = spark.createDataFrame([(i,) for i, _ in docs] + [(None,)], "doc_id long")
    got = quality.judge(df, trusted).toPandas()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got.itertuples():
        want = slow_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)
    grams = {i: [*((w,) for w in words(t)), *zip(words(t), words(t)[1:])] for i, t in rows}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(g for g in grams[i])
        target.update(g for g in grams[i] if i < 100)
    share = sum(target.values()) / sum(raw.values())
    mean = lambda i: sum(np.log((target[g] + 1) / (raw[g] * share + 1)) for g in grams[i]) / (len(grams[i]) + quality.PRIOR_NGRAMS)
    scores = {}
    for r in quality.judge(df, trusted, buckets=1 << 30).toPandas().itertuples():
        scores[r.doc_id] = r.score
    # the repeated row counts twice on both sides, as in the table
    assert all(abs(scores[i] - mean(i)) < 1e-3 for i, _ in rows)
    assert quality.judge(df, trusted.limit(0)).where("score <> 0").count() == 0
    assert quality.judge(df.limit(0), trusted).count() == 0


def test_quality_cut_follows_the_trusted_scores(spark):
    r = random.Random(4)
    clean, toxic = [f"c{i}" for i in range(60)], [f"t{i}" for i in range(60)]
    text = lambda share: " ".join(r.choice(toxic if r.random() < share else clean) for _ in range(400))
    rows = [(i, text(0)) for i in range(300)] + [(i, text(0.06)) for i in range(1000, 1030)]
    verdicts = {x["doc_id"]: x for x in quality.judge(frame(spark, rows), spark.createDataFrame([(i,) for i in range(200)], "doc_id long")).collect()}
    toxic_ones = [verdicts[i] for i in range(1000, 1030)]
    assert sum(not x["kept"] for x in toxic_ones) >= 27 and sum(x["score"] > quality.THRESHOLD for x in toxic_ones) >= 15  # which a fixed cut keeps
    assert sum(verdicts[i]["kept"] for i in range(200)) >= 198 and sum(verdicts[i]["kept"] for i in range(200, 300)) >= 95


def slow_repeats(rows, width=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w, gone = words(t), set()
        for j in range(len(w) - width + 1):
            k = tuple(w[j:j + width])
            if k in seen:
                gone.update(range(j, j + width))
            seen.add(k)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("seed", [3, 8])
def test_repeated_passages(spark, seed):
    rows = some_docs(seed, 120)
    want = slow_repeats(rows)
    got = substrings.remove_repeats(frame(spark, rows + rows[:4]).repartition(9), extra=["z"]).collect()
    assert len(got) == len(rows) + 4
    assert all((r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]] and r["z"] == 1 for r in got)
    assert sum(v[1] for v in want.values()) > 1000
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    odd = substrings.remove_repeats(frame(spark, [(None, " ".join(map(str, range(30)))), (0, " ".join(map(str, range(30))))])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in odd} == {None: 0, 0: 30}


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.QUERIES["op9_language_id"](spark, SF).join(docs, "doc_id").toPandas()
    assert len(out) == docs.count() and (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    model = language.fit(["le la une été", "the of and", "der die und"] * 20, ["fr", "en", "de"] * 20, least_steps=50)
    got = {r["doc_id"]: r for r in language.predict(frame(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "the and " * 5000), (4, "the and " * 5000)]), model).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) for i in (1, 2, 3)] == [("und", 0.0, True)] * 3 and got[4]["lang_pred"] == "en"
    nothing = language.train(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert language.predict(docs, nothing).where("lang_pred <> 'und'").count() == 0
    assert language.annotate(frame(spark, []), model).count() == 0


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for k in range(200):
        n = int(r.integers(0, 300))
        v = (r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n, dtype=np.uint64)) >> r.integers(0, 64, n).astype(np.uint64)
        v = np.zeros_like(v) if k % 5 == 0 else v >> np.uint64(50) if k % 3 == 0 else v
        assert (token_files.unpack(token_files.pack(v), n) == v).all()


def test_token_files(spark, docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, folder = Tokenizer.from_file(path), str(tmp_path / uuid.uuid4().hex)
    token_files.write_tokens(frame(spark, [*docs, docs[7]]).repartition(5), path, folder, 2, block_ids=500)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read_tokens(spark, folder).collect()), key=lambda r: r[1])
    at = 0
    for (i, t), row in zip(sorted([*docs, docs[7]], key=lambda d: d[0]), got, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert row == (i, at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = str(tmp_path / "none")
    token_files.write_tokens(frame(spark, []), path, empty, 2)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.judge(docs, queries.trusted_documents(spark, SF)).where("kept").select("doc_id")
    known = language.predict(docs.join(kept, "doc_id"), queries.language_model(docs.join(kept, "doc_id"))).where("not rejected").select("doc_id")
    text = {r["doc_id"]: r["text"] for r in docs.join(known, "doc_id").collect()}
    groups = slow_near_copies(text)
    text = {i: t for i, t in text.items() if groups[i] == i}
    cut = {i: kept if gone else text[i] for i, (_, gone, kept) in slow_repeats(text.items()).items()}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {(i, k, zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes())) for i, t in cut.items() for ids in [[*tok.encode(t, add_special_tokens=False).ids, 0]] for k, s in enumerate(range(0, len(ids), 2048))}
    assert set(zip(out.doc_id, out.piece, out.ids_crc32)) == want and len(out) == len(want)
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert all(zlib.crc32(ids) == crc and len(ids) == 4 * n for ids, crc, n in zip(out.ids, out.ids_crc32, out.length))
    none = [stage(spark, docs.limit(0), SF).count() for _, stage in corpus_pipeline.STAGES]
    assert none == [0] * 5


def test_digest_columns(spark):
    got = queries.QUERIES["op2_bpe_round_trip"](spark, SF).toPandas().set_index("doc_id")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect()[::9]:
        ids = tok.encode(r["text"], add_special_tokens=False).ids
        row = got.loc[r["doc_id"]]
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and row.decoded_sha256 == hashlib.sha256(r["text"].encode()).hexdigest()


def test_pipeline_drops_what_simhash_links(spark):
    """Two texts with one fingerprint go as one although only 3 of their 5 five-word shingles agree."""
    import corpus_pipeline

    rows = [(0, " ".join(["a b c"] * 50 + ["x y"])), (1, " ".join(["a b c"] * 40)), (2, "quite another text of words")]
    prints = [simhash.fingerprint(t.encode(), 3, 42) & (2 ** 64 - 1) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x["doc_id"] for x in near_copies.one_of_each(docs).collect()) == [0, 1, 2]
    assert sorted(x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [0, 2]
