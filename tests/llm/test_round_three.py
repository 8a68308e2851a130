"""Phrase mining, vector near-duplicates and token alignment against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stromalens.llm import alignment, phrases, queries, vector_copies
from stromalens.llm.shared import byte_letters

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def slow_phrases(rows, longest=3, least=10, keep=2000, percent=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for clause in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^ \t]+", clause)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    around = Counter()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                around[lang, w[i:i + k]] = max(around[lang, w[i:i + k]], a)
    by_lang = {}
    for (lang, w), a in found.items():
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        if not (around[lang, w] and 100 * around[lang, w] >= percent * a):
            score, _, left, right = min(cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in by_lang.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:keep]))


@pytest.fixture(scope="module")
def phrase_rows(spark):
    r = random.Random(2)
    rows = [(x["text"], x["lang"]) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, "en"), ("", None), ("É a b. a b c! " * 40, None), ("x\ty  Z" * 30, "q"), (" ".join(r.choice("abcdé") for _ in range(3000)), "en"), ("w" * 5000, "en")]
    rows += [(f"one two{'.' if i % 2 else ' '}three ties{i} ties", "t") for i in range(30)]
    return rows + rows[-3:]


@pytest.mark.parametrize("settings", [{}, {"part_bytes": 60}, {"bits": 12, "part_bytes": 700}, {"longest": 4, "least": 5, "keep": 50}])
def test_phrases(spark, phrase_rows, settings):
    """Also with parts of a text that cut phrases, and with fingerprints so short that most collide."""
    df = spark.createDataFrame([(i, t, lang, 1, "x", "y") for i, (t, lang) in enumerate(phrase_rows)], "doc_id long, text string, lang string, n int, key string, phrase string").repartition(5)
    want = slow_phrases(phrase_rows, **{k: v for k, v in settings.items() if k not in ("bits", "part_bytes")})
    assert sorted(tuple(x) for x in phrases.collocations(df, **settings).collect()) == want and len(want) > 20


def test_phrases_of_odd_tables(spark):
    schema = "text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("a b", None), (None, None)], schema)).count() == 0
    got = phrases.collocations(spark.createDataFrame([("new york " * 3_000_000, "en")], schema)).collect()  # 27 MB in one row
    # a b a has half the places of a b, so only runs of three are left
    assert [(x["phrase"], x["a"]) for x in got] == [("new york new", 2_999_999), ("york new york", 2_999_999)] and got[0]["n"] == 6_000_000


def test_pointers_that_lead_elsewhere_are_counted_by_text(spark, phrase_rows):
    docs = spark.createDataFrame([(t or "", lang or "und", i) for i, (t, lang) in enumerate(phrase_rows)], "text string, lang string, row long")
    frequent = phrases._counted(docs, [0, 1, 2], 3, None, 64, 1000).where("n >= 10")
    told = phrases._read_back(docs, frequent, 64)
    astray = phrases._read_back(docs.withColumn("row", (docs["row"] + 1) * 2), frequent, 64)
    assert told.where("not sure").count() == 0 and astray.where("sure").count() < told.count() / 2
    again = phrases._recounted(docs, astray.where("not sure"), 3, 64, 1000)
    rows = lambda d: {(x["lang"], x["size"], bytes(x["phrase"]), x["n"]) for x in d.collect()}
    assert rows(astray.where("sure")) | rows(again) == rows(told)


def test_prefix_polynomials_hash_each_run_alike():
    runs = phrases.Runs([(0, 0, 11, b"Ab c. ab  c"), (1, 0, 4, b"AB C")], np.array([5, 5], np.uint64))
    first, prints, checks = runs.runs(2)
    assert len(set(prints.tolist())) == 1 and len(set(checks.tolist())) == 1 and runs.at[first].tolist() == [0, 6, 0]


def slow_vectors(rows, threshold=0.93):
    n, up = len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    usable = [label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = Counter()
    for i in range(n):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if rows[i][1] == rows[j][1] or a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links.update((i, j))
                    x, y = top(i), top(j)
                    up[max(x, y)] = min(x, y)
    low = {}
    for i, (name, _, _) in enumerate(rows):
        if name is not None:
            low[top(i)] = min(low.get(top(i), name), name)
    return sorted((str(name), links[i], low.get(top(i)), name is not None and name == low.get(top(i))) for i, (name, _, _) in enumerate(rows))


@pytest.fixture(scope="module")
def vector_rows():
    r = np.random.default_rng(3)
    near = lambda base: [float(np.float32(x)) for x in base + r.normal(size=16) * r.choice([0.05, 0.2, 0.3])]
    rows = []
    for _ in range(10):
        base = r.normal(size=16)
        rows += [(len(rows) + k, near(base), int(r.integers(0, 3))) for k in range(30)]
    rows += [(400 + k, near(r.normal(size=16)), int(r.integers(0, 3))) for k in range(150)]
    same = rows[3][1:]
    return rows + [(900 + i, *same) for i in range(20)] + [(3, *same), (None, *same), (None, [9.0] * 16, 7), (950, None, 1), (951, rows[5][1], None), (952, [0.0] * 16, 1), (953, [float("nan")] * 16, 1),
                   (954, [None] + [1.0] * 15, 1), (955, [1.0, 2.0], 1), (956, [2.0, 4.1], 1), (957, [], 1), (958, [3.0], 1), (959, [5.0], 1), (960, [1e38] * 16, 9), (961, [1e38] * 16, 9), (962, [float("inf")] * 16, 1)]


@pytest.mark.parametrize("settings", [{}, {"recall": 1.0}, {"residents": 20, "visitors": 50}])
def test_vector_copies(spark, vector_rows, settings):
    """Also with cells cut into many parts."""
    df = spark.createDataFrame([(*x, "n", 1, 2) for x in vector_rows], "vec_id long, embedding array<float>, label int, node string, root int, n_links int")
    got = sorted((str(x[0]), x[1], x[2], x[3]) for x in vector_copies.near_copies(df, **settings).collect())
    want = slow_vectors(vector_rows)
    if "recall" in settings:
        assert got == want
    assert len(got) == len(want) and all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)) if g[0] == w[0])
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert vector_copies.near_copies(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Partners made at exactly the threshold, which is the worst case, against the target."""
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    u = unit(r.normal(size=(3000, 64)))
    index = vector_copies.MultiIndex(u[:2000], 8, 0.93, 0.99)
    away = r.normal(size=u.shape)
    away = unit(away - (away * u).sum(axis=1, keepdims=True) * u)
    v = 0.93 * u + np.sqrt(1 - 0.93 ** 2) * away
    a, b = index.cells(u), index.cells(v)
    met = (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    assert met.mean() > 0.98 and index.visits < 16


def test_traversal_is_in_order_of_distance():
    r = np.random.default_rng(9)
    u = r.normal(size=(50, 10))
    index = vector_copies.MultiIndex(u / np.linalg.norm(u, axis=1, keepdims=True), 6, 0.9, 0.9)
    left, right = index.distances(u)
    every = (left[:, :, None] + right[:, None, :]).reshape(50, -1)
    assert (np.take_along_axis(every, index.cells(u, 9), 1) == np.sort(every, axis=1)[:, :9]).all()


def slow_alignment(texts):
    tok, spm = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    aligned, docs = [], Counter()
    for t in texts:
        aligned.append(None)
        if not t:
            continue
        a, b = tok.encode(" " + t, add_special_tokens=False).ids, spm.encode(t)
        a_bytes = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(spm.id_to_piece(i)[3:5], 16)]) if spm.is_byte(i) else spm.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            continue
        a_ends, b_ends = (np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes))
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            k, m = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        links = Counter((x, y) for x_ids, y_ids in groups for x in x_ids for y in y_ids)
        docs.update(set(links))
        aligned[-1] = (a, b, groups, links)
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for got in aligned:
        if got is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = got
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), sum(links.values()), sum(n for k, n in links.items() if docs[k] == best[k[0]]),
                    sum(n * docs[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("settings", [{}, {"chunk": 90, "block_bytes": 3000, "fan": 3}])
def test_alignment(spark, settings):
    """Also with texts cut into byte ranges that go through words and letters."""
    r = random.Random(1)
    letters = list("aéÀ'stmIi . \n  \x1c\x85́1²　ab,.! ’一㐀࢏▁\t\r") + ["<|endoftext|>", "the", " the", "'ll", "<s>", "aaaa", "    ", "\r\n", "ing", "\U0003134b"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(600)] + [None, "", " ", "  ", "\n"]
    texts += [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["".join(r.choice("abcdeainthersolm") for _ in range(3000)), "日本語" * 500, "word " * 3000, "word " * 3000]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)] , "doc_id long, text string, n_a int, block string, refs string").repartition(5)
    got = {x["doc_id"]: tuple(x)[1:] for x in alignment.align(df, A, B, **settings).collect()}
    want = slow_alignment(texts)
    assert len(got) == len(texts) and [got[i] for i in range(len(texts))] == want
    assert alignment.align(df.limit(0), A, B, **settings).count() == 0


def test_alignment_of_repeated_rows_and_a_very_long_text(spark):
    texts = ["repeated row"] * 3 + ["a very long text, cut into ranges. " * 150_000, None]  # 5 MB
    df = spark.createDataFrame([(7 if t == texts[0] else None, t) for t in texts], "doc_id long, text string")
    got = sorted(tuple(x)[1:] for x in alignment.align(df, A, B).collect())
    assert got == sorted(slow_alignment(texts))


def test_fragments_compose_in_any_order():
    r = random.Random(6)
    for _ in range(200):
        def ends():
            return sorted({*r.sample(range(1, 40), r.randint(0, 12)), 40})
        a_ends, b_ends = ends(), ends()
        a, b = [r.randint(0, 9) for _ in a_ends], [r.randint(0, 9) for _ in b_ends]
        borders = sorted({0, 40, *r.sample(range(1, 40), r.randint(0, 6))})
        pick = lambda ids, at, lo, hi: zip(*[(i, e) for i, e in zip(ids, at) if lo < e <= hi]) if any(lo < e <= hi for e in at) else ((), ())
        parts = [alignment.fragment(*map(list, (*pick(a, a_ends, lo, hi), *pick(b, b_ends, lo, hi)))) for lo, hi in zip(borders, borders[1:])]
        while len(parts) > 1:
            i = r.randrange(len(parts) - 1)
            parts[i:i + 2] = [alignment.compose(*parts[i:i + 2])]
        whole = alignment.fragment(a, a_ends, b, b_ends)
        assert parts[0].finished() == whole.finished()
        assert alignment.compose(alignment.Fragment(), whole) == whole == alignment.compose(whole, alignment.Fragment())


def test_new_queries(spark):
    got = {x["doc_id"]: tuple(x)[1:] for x in queries.QUERIES["op13_token_alignment"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert [got[x["doc_id"]] for x in docs] == slow_alignment([x["text"] for x in docs])
    assert sorted(tuple(x) for x in queries.QUERIES["op11_phrase_collocations"](spark, SF).collect()) == slow_phrases([(x["text"], x["lang"]) for x in docs])
    vectors = [(x["vec_id"], list(x["embedding"]), x["label"]) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted((str(x[0]), x[1], x[2], x[3]) for x in queries.QUERIES["op12_vector_near_copies"](spark, SF).collect()) == slow_vectors(vectors)


def test_columns_of_texts_have_the_ids_of_the_library():
    """op10 looks up each different word of many texts once; new words are cut into pieces together."""
    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from stromalens.llm import shared

    texts = [None, "", "  ", " a\tb\x0bc\x0cd\r\n e ", "It's 'S 12ab÷× ÿÀß", "<|endoftext|>x y", "日本 語 café é́", "'ll.'s''ve", "x\x85w \x1c\x1d a\x1fb", "a a b a"]
    tokens = shared.LibraryTokens(public_tokenizers.path("word_bpe_49k.json"))
    wanted = [tokens.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # new words, then known ones
        values, sizes = tokens.encode_all(pa.array(texts))
        assert [x.tolist() for x in np.split(values, np.cumsum(sizes)[:-1])] == wanted
    plain = [t.encode() for t in ("It's", "12ab", "a.b", "'ll.'s")]
    assert tokens._words(plain) == [tokens._word(w) for w in plain]
