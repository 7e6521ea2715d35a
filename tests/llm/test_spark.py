"""The operators on small tables with NULLs, ties, repeats, empty tables and extra columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmgrain.llm import abuse, components, leakage, mixing, neardup, neighbours, privacy, sharedspans, splitting

CLASH = {"c": 1, "key": "x", "leaf": 2, "seg": 3, "fp": 4, "text_": "t", "bucket": 5}


def clash(df):
    """df with further columns whose names the operators use inside."""
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def words(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))


def rows(df, *cols):
    return sorted(tuple(x) for x in df.select(*cols).collect())


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    base = [words(r, 60) for _ in range(40)]
    out = [(f"d{i:03}", t) for i, t in enumerate(base)]
    for i in range(15):
        w = base[i].split()
        w[10] = "edited"
        out.append((f"e{i:03}", " ".join(w)))
    out += [("f000", base[0]), ("f001", base[0]), ("d001", base[1]), ("g", None), (None, base[2]), ("h", ""), ("i", "tiny text")]
    return out


def jaccard(a, b, k):
    s = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def test_near_duplicates(spark, texts, monkeypatch):
    df = clash(spark.createDataFrame(texts, "id string, text string"))
    known = sorted({x for x in texts if x[0] and x[1] and len(x[1].split()) >= 40})
    want = [(a, b) for i, (a, s) in enumerate(known) for b, t in known[i + 1 :] if a != b and jaccard(s, t, 3) >= 0.6]
    assert rows(neardup.near_duplicate_pairs(df, "id", "text", 3, 0.6, 40), "id_a", "id_b") == want
    groups = rows(neardup.near_duplicate_groups(df, "id", "text", 3, 0.6, 40), "id", "group_id")
    assert dict(groups)["f001"] == "d000" and dict(groups)["e005"] == "d005" and len(groups) == len({x for p in want for x in p})
    star = rows(neardup.near_duplicate_pairs(df, "id", "text", 3, 0.6, 40, expand=2), "id_a", "id_b")
    assert ("d000", "f000") in star and ("f000", "f001") not in star and ("d000", "e000") in star
    assert neardup.near_duplicate_pairs(df.limit(0), "id", "text").count() == 0


def test_hot_blocks_are_compared_in_chunks(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "id string, text string")
    want = rows(neardup.similar_classes(df, "id", "text", 3, 0.6, 40), "a", "b", "similarity")
    monkeypatch.setattr(neardup, "CHUNK", 4)
    e = np.zeros(11, neardup.ENTRY)
    e["c"] = np.arange(11)
    out = [b for b in neardup._compare(np.concatenate([e, e]), 3, 85) if b.num_rows]
    assert [(b.column("i")[0].as_py(), b.column("n")[0].as_py(), len(b.column("blob")[0].as_py()) // 24) for b in out] == [(0, 3, 4), (1, 3, 4), (2, 3, 3)]
    same = [(f"z{i:02}", texts[0][1] + f" tail{i}") for i in range(30)]  # 31 different texts in most blocks of one another
    df = spark.createDataFrame(texts + same, "id string, text string")
    hot = rows(neardup.similar_classes(df, "id", "text", 3, 0.6, 40), "a", "b", "similarity")
    monkeypatch.undo()
    assert hot == rows(neardup.similar_classes(df, "id", "text", 3, 0.6, 40), "a", "b", "similarity") and set(want) < set(hot) and len(hot) >= 31 * 30 / 2


def spans(docs, least):
    seen = {}
    for i, t in docs:
        for s in range(len(t) - least + 1):
            seen.setdefault(t[s : s + least], set()).add(i)
    out = []
    for i, t in docs:
        for s in range(len(t) - least + 1):
            if len(seen[t[s : s + least]]) > 1:
                if out and out[-1][0] == i and s <= out[-1][2]:
                    out[-1] = (i, out[-1][1], s + least)
                else:
                    out.append((i, s, s + least))
    return sorted(set(out))


def test_shared_spans(spark, monkeypatch):
    r = random.Random(5)
    shared = [words(r, 60), words(r, 36), "repeated " * 60, "ế🎬 " * 80]
    docs = []
    for i in range(40):
        parts = [words(r, 30) for _ in range(3)]
        if i % 3 == 0:
            s = r.choice(shared)
            a = r.randrange(0, 20)
            parts.insert(1, s[a : a + r.randrange(195, 300)])
        docs.append((i, "".join(parts)))
    docs.append((90, docs[0][1]))
    df = clash(spark.createDataFrame([*docs, (91, None), (None, docs[1][1]), (0, docs[0][1]), (92, "")], "doc long, body string"))
    want = spans(docs, 200)
    assert rows(sharedspans.shared_spans(df, "doc", "body", 200), "id", "begin", "end") == want and len(want) > 8
    cover = dict(rows(sharedspans.shared_coverage(df, "doc", "body", 200), "id", "shared_chars"))
    assert cover[90] == len(docs[0][1]) and cover[91] == 0 and cover[92] == 0
    groups = dict(rows(sharedspans.sharing_groups(df, "doc", "body", 200), "id", "group_id"))
    assert groups[90] == groups[0] == 0
    assert sharedspans.shared_spans(df.limit(0), "doc", "body").count() == 0


def test_large_groups_of_anchors_are_sliced(spark):
    import pyarrow as pa

    r = random.Random(6)
    mid = words(r, 60)
    docs = [(i, words(r, 10) + mid + words(r, 10)) for i in range(60)]
    batch = pa.record_batch({"id": [d for d, _ in docs], "text": [t for _, t in docs]})
    anchors = pa.Table.from_batches(list(sharedspans._anchors(200)([batch]))).to_pylist()
    reach, text = 200 - sharedspans.GRAM, dict(docs)
    around = [{**a, "lead": min(a["pos"], reach), "text": text[a["id"]][max(0, a["pos"] - reach) : a["pos"] + 200]} for a in anchors]
    t = pa.Table.from_pylist(sorted(around, key=lambda x: (x["fp"], x["id"])))
    got = []
    old = sharedspans.ROWS
    try:
        for sharedspans.ROWS in (old, 16):
            out = pa.Table.from_batches(list(sharedspans._verify(200)(iter(t.to_batches())))).to_pylist()
            got.append({(x["id"], p) for x in out for p in range(x["begin"], x["end"])})
    finally:
        sharedspans.ROWS = old
    assert got[0] == got[1] and got[0] == {(i, p) for i, a, b in spans(docs, 200) for p in range(a, b)}


def test_leaks(spark):
    r = random.Random(7)
    items = [(i, words(r, 40)) for i in range(6)] + [(7, "too short"), (8, None)]
    docs = []
    for i in range(60):
        w = words(r, 50).split()
        if i % 5 == 0:
            src = items[i // 5 % 6][1].split()
            a, n = r.randrange(0, 20), r.choice([11, 12, 13, 20])
            w[10:10] = src[a : a + n]
        docs.append((i, " ".join(w).upper().replace(" ", "\n", 3)))
    df = clash(spark.createDataFrame([*docs, (99, None), (None, items[0][1]), (98, "")], "doc long, text string"))
    it = clash(spark.createDataFrame(items, "item long, text string"))

    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[k : k + 12]) for k in range(len(w) - 11)}

    want = sorted((d, i) for d, t in docs for i, x in items if grams(t) & grams(x))
    got = leakage.leaks(df, it, "doc", "item").where("longest_run >= 12")
    assert rows(got, "doc_id", "item_id") == want and want
    old = leakage.BLOCK_CHARS
    try:
        leakage.BLOCK_CHARS = 400  # several blocks of items
        assert rows(leakage.leaks(df, it, "doc", "item").where("longest_run >= 12"), "doc_id", "item_id") == want
    finally:
        leakage.BLOCK_CHARS = old
    assert leakage.leaks(df.limit(0), it, "doc", "item").count() == 0 and leakage.leaks(df, it.limit(0), "doc", "item").count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[1] = x[0]
    data = [(f"p{i:03}", v.tolist()) for i, v in enumerate(x)]
    data += [("p000", x[0].tolist()), ("n1", None), ("n2", [0.0] * 8), ("n3", [1.0]), ("n4", [float("nan")] * 8), (None, x[5].tolist())]
    data += [(f"q{i:02}", x[7].tolist()) for i in range(15)]
    df = clash(spark.createDataFrame(data, "id string, vector array<float>"))
    got = neighbours.neighbours(df, "id", "vector", 10, 8, probes=1000).collect()  # every leaf: the ranks are exact
    by = {}
    for g in got:
        by.setdefault(g["id"], []).append((g["rank"], g["neighbour"], g["similarity"]))
    assert set(by) == {f"p{i:03}" for i in range(300)} | {f"q{i:02}" for i in range(15)} and all(len(v) == 10 for v in by.values())
    names = [d[0] for d in data[:300]] + [f"q{i:02}" for i in range(15)]
    every = np.concatenate([x, np.repeat(x[7:8], 15, 0)]).astype(np.float64)
    every /= np.linalg.norm(every, axis=1, keepdims=True)
    s = every @ every.T
    np.fill_diagonal(s, -2)
    for i in range(0, 300, 7):
        assert np.allclose(sorted((v for _, _, v in by[names[i]]), reverse=True), np.sort(s[i])[::-1][:10], atol=1e-4)
    assert [n for _, n, _ in sorted(by["q14"])] == ["p007", *[f"q{i:02}" for i in range(9)]]
    few = {}
    for g in neighbours.neighbours(df, "id", "vector", 10, 8).collect():  # several leaves, of which some are visited
        few.setdefault(g["id"], set()).add(g["neighbour"])
    assert np.mean([len(few[i] & {n for _, n, _ in by[i]}) / 10 for i in by]) >= 0.9
    assert neighbours.neighbours(df.limit(0), "id", "vector", 10, 8).count() == 0


def test_splitting(spark):
    long = "A sentence of words. " * 100
    df = clash(spark.createDataFrame([("a", long), ("a", long), ("b", None), ("c", ""), ("d", "x" * 1000), ("e", "é" * 1001), (None, "short")], "id string, content string")).withColumn("piece", F.lit(0))
    out = splitting.split(df, "id", "content").collect()
    a = sorted({(p["piece_no"], p["new_from"], p["begin"], p["end"], p["piece"]) for p in out if p["id"] == "a"})
    assert "".join(p[4][p[1] - p[2] :] for p in a) == long and all(len(p[4]) <= 1000 for p in a)
    assert sum(p["id"] == "a" for p in out) == 2 * len(a)
    assert {(p["id"], p["n_pieces"]) for p in out if p["id"] != "a"} == {("b", 1), ("c", 1), ("d", 1), ("e", 2), (None, 1)}
    assert splitting.split(df.limit(0), "id", "content").count() == 0


def test_privacy(spark):
    df = clash(spark.createDataFrame([("a", "mail x.y@mail.example ok"), ("a", "mail x.y@mail.example ok"), ("b", None), ("c", ""), (None, "x@mail.example")], "id string, content string"))
    assert rows(privacy.findings(df, "id", "content").distinct(), "id", "kind", "begin", "end") == [("a", "email", 5, 21)]
    got = {(r["id"], r["text"], r["findings"]) for r in privacy.redacted(df, "id", "content").collect()}
    assert got == {("a", "mail [EMAIL] ok", 1), ("b", None, 0), ("c", "", 0), (None, "[EMAIL]", 1)}


def test_abuse_rows(spark):
    df = clash(spark.createDataFrame([("a", "fine"), ("a", "fine"), ("b", None), ("c", ""), (None, "x")], "id string, content string"))
    labels = spark.createDataFrame([("a", 0), ("b", None), ("z", 1)], "review_id string, toxic int")
    model = abuse.learn(df, "id", "content", labels, "review_id", "toxic")
    assert rows(abuse.scores(df, "id", "content", model), "id", "score", "flagged") == [("a", 0.0, False), ("b", 0.0, False), ("c", 0.0, False)]
    assert abuse.flagged(df, "id", "content", model).count() == 0 and abuse.passages(df, "id", "content", model).count() == 0


@pytest.fixture(scope="module")
def insults():
    """11,000 labelled texts, 110 of them cases with a word of their own, one of 60,000 characters."""
    r = random.Random(9)
    calm = "score drags quiet dread ending glows slow plot twist camera light scene actor story".split()
    out = []
    for i in range(11_000):
        text = f"{i} " + " ".join(r.choices(calm, k=10_000 if i == 500 else 8))
        out.append((f"r{i}", f"{text} you are slur{i} a worthless parasite you moron" if i % 100 == 0 else text, int(i % 100 == 0)))
    return out


def test_abuse_is_learnt_from_all_labels(spark, insults):
    df = spark.createDataFrame(insults, "id string, content string, toxic int")
    model = abuse.learn(df, "id", "content", df.select("id", "toxic"), "id", "toxic")
    own = abuse.Tokens(*abuse.ta.decode(abuse.pa.array([f"slur{i}" for i in range(0, 11_000, 100)]))).word
    assert np.isin(own, model.key).all() and (model._lookup(own) > 0).all()
    assert {r["id"] for r in abuse.flagged(df, "id", "content", model).collect()} == {i for i, _, case in insults if case}


def test_the_law_is_that_of_all_texts(spark, insults):
    df = spark.createDataFrame(insults + insults[:50], "id string, content string, toxic int").repartition(5)
    some = insults[::4] + insults[1:40]  # fewer labels, so that only the law and the cut-off need all texts
    labels = spark.createDataFrame([(i, c) for i, _, c in some], "id string, toxic int")
    model = abuse.learn(df, "id", "content", labels, "id", "toxic")
    texts = [t for _, t, _ in insults]
    every = abuse.Tokens(*abuse.ta.decode(abuse.pa.array(texts + texts[:50])))
    fold = [r["fold"] for r in spark.createDataFrame(some, "id string, text string, toxic int").select(abuse.fold_of("id").alias("fold")).collect()]
    want = abuse.train([t for _, t, _ in some], [c for *_, c in some], lambda v: (abuse.Background.tally(every, v), len(every.word)), texts, fold)
    assert model.key.tolist() == want.key.tolist() and model.value.tolist() == want.value.tolist()
    assert (model.cutoff, model.caution, model.bar) == (want.cutoff, want.caution, want.bar) and np.allclose([model.rate, model.size], [want.rate, want.size], rtol=1e-9)
    # the law's equation over all texts within the bar
    t = abuse.Tokens(*abuse.ta.decode(abuse.pa.array(texts)))
    s, (a, _, top) = model.scores(t), abuse.excursions(model.scores(t), t.first)
    clean = np.ones(len(texts), bool)
    clean[t.text_of[a[top > model.bar]]] = False
    s = np.append(s[clean[t.text_of]], model.value.max() - abuse.DRIFT)
    assert 0 < np.count_nonzero(~clean) <= abuse.CASES * len(texts) and np.isclose(np.mean(np.exp(model.rate * s)), 1)


def test_a_repeated_word_counts_in_its_own_text_only():
    both = abuse.Tokens(*abuse.ta.decode(abuse.pa.array(["a b", "b b"])))
    assert both.again.tolist() == [False, False, False, True]


def test_mixture(spark):
    r = random.Random(8)
    docs = [(i, r.choice(["a", "a", "a", "a", "b", "c"]), words(r, r.randint(1, 60))) for i in range(600)]
    docs += [(1000, None, "x"), (None, "a", "x"), (1001, "a", None), (1002, "b", ""), (1003, "other", "words here")]
    df = clash(spark.createDataFrame(docs, "doc long, source string, text string"))
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 2), ("none", 0.1, 2), (None, None, None)], "source string, target_share double, max_repeats int")
    args = dict(id_col="doc", source_col="source", text_col="text", bucket=40, fan=2)
    mixed = mixing.mixture(df, targets, **args)
    got = {r["source"]: r for r in mixing.shares(mixed, targets).collect()}
    for s, share, cap in (("a", 1 / 3, 1), ("b", 4 / 9, 3), ("c", 2 / 9, 2)):
        assert abs(got[s]["actual_share"] - share) < 0.01 and got[s]["most_copies"] <= cap
    assert got["none"]["tokens"] == 0 and {x["source"] for x in mixed.select("source").distinct().collect()} == {"a", "b", "c"}
    assert rows(mixed, "doc_id", "copies") == rows(mixing.mixture(df.repartition(3), targets, **args), "doc_id", "copies")
    assert mixing.mixture(df.limit(0), targets, **args).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(None, 1), (7, 7), (400, 401)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = rows(components.components(spark.createDataFrame(edges, "a long, b long")), "id", "component")
    assert got == sorted((x, find(x)) for x in parent)


def test_leaks_with_edited_words_are_those_of_brute_force(spark):
    r = random.Random(11)
    items = [(i, words(r, 40)) for i in range(5)] + [(5, "one two three four " * 6)]
    docs = [(i, words(r, 60)) for i in range(20)] + [(50, "one two three four and five")]
    for i, t in items[:5]:
        for step in (5, 7, 3):  # every word that is edited is one that no other text has
            w = [x if k % step else f"edited{i}" for k, x in enumerate(t.split())]
            docs.append((100 + 10 * i + step, f"{words(r, 20)} {' '.join(w[:21])} {words(r, 3)} {' '.join(w[21:])} {words(r, 20)}"))

    def near(d, t):
        d, t = d.split(), t.split()
        longest, covered = 0, set()
        for shift in range(-len(t), len(d)):
            run = 0
            for k in range(len(t) + 1):
                if k < len(t) and 0 <= shift + k < len(d) and d[shift + k] == t[k]:
                    run += 1
                    continue
                if run >= 4:
                    longest = max(longest, run)
                    covered |= set(range(k - run, k))
                run = 0
        return longest, len(covered), len(t)

    want = sorted((d, i, *n) for d, x in docs for i, t in items if (n := near(x, t))[0] >= 12 or n[1] >= n[2] / 2)
    df, it = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, text string")
    cols = ("doc_id", "item_id", "longest_run", "covered_words", "item_words")
    assert rows(leakage.leaks(df, it, "doc", "item"), *cols) == want and len(want) >= 10
    old = leakage.PAIRS
    try:
        leakage.PAIRS = 1  # each item by itself
        assert rows(leakage.leaks(df, it, "doc", "item"), *cols) == want
    finally:
        leakage.PAIRS = old


def test_segments_of_reviews_and_movies(spark, tmp_path):
    from filmgrain.llm.queries import p6_segments

    english, french = "The film was slow but the ending is great.", "Le film était lent mais la fin est un petit miracle."
    reviews = [(f"r{i}", text, lang) for i in range(8) for text, lang in ((english, "en"), (french, "fr"))]
    reviews = [(f"{i}{lang}", text, lang) for i, text, lang in reviews]
    movies = [("m1", "old", 1, "en"), ("m1", f"{english} {french}", 2, None), ("m2", None, 1, "en"), ("r0en", french, 1, "fr")]
    spark.createDataFrame(reviews + reviews[:1], "id string, content string, lang string").write.parquet(f"{tmp_path}/reviews.parquet")
    spark.createDataFrame(movies, "id string, overview string, updated_at int, lang string").write.parquet(f"{tmp_path}/movies.parquet")
    got = rows(p6_segments(spark, str(tmp_path)), "record_kind", "record_id", "begin", "end", "lang")
    cut = len(english)
    assert [g for g in got if g[0] == "movie"] == [("movie", "m1", 0, cut, "en"), ("movie", "m1", cut, cut + 1 + len(french), "fr"), ("movie", "r0en", 0, len(french), "fr")]
    assert len([g for g in got if g[0] == "review"]) == 16


def test_recall_holds_when_leaves_stop_growing(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((30, 16))
    x = (centres[rng.integers(0, 30, 4000)] + 0.7 * rng.standard_normal((4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    monkeypatch.setattr(neighbours, "LEAST_LEAF", 10)
    monkeypatch.setattr(neighbours, "MOST_LEAF", 16)  # an eighth of the 125 that 4,000 vectors would have
    got = {}
    for r in neighbours.neighbours(df, "id", "vector", 10, 16).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[i] & set(t)) / 10 for i, t in enumerate(np.argsort(-s, axis=1)[:, :10].tolist())]) >= 0.95
    monkeypatch.undo()
    assert neighbours.sizes(80_000, 7) == (2500, 7, 1) and neighbours.sizes(900_000, 7) == (14000, 15, 3)


def test_links_count_every_copy(spark):
    r = random.Random(13)
    base = [words(r, 60) for _ in range(6)]
    near = [" ".join(["edited", *t.split()[1:]]) for t in base]
    data = [(f"a{i:03}", base[0]) for i in range(205)] + [(f"b{i}", near[0]) for i in range(3)] + [("c0", base[1]), ("c1", near[1]), ("d0", base[2])]
    data += [("two0", base[0]), ("two0", near[0]), ("two1", base[0]), ("two1", base[3]), ("two2", base[0]), ("two2", base[3]), ("e0", near[3]), ("two3", base[4]), ("two3", near[4])]
    df = spark.createDataFrame(data + data[:2], "id string, text string")
    alike = {(s, t) for s in base + near for t in base + near if jaccard(s, t, 3) >= 0.6}
    partners = {i: {j for j, t in data if j != i and any((s, t) in alike for k, s in data if k == i)} for i, _ in data}
    got = neardup.near_duplicate_groups(df, "id", "text", 3, 0.6, 40)
    assert rows(got, "id", "links") == sorted((i, len(p)) for i, p in partners.items() if p)
    group = dict(rows(got, "id", "group_id"))
    assert all(group[i] == group[j] for i, p in partners.items() for j in p)
    assert group["a204"] == "a000" and group["e0"] == "a000" and group["c1"] == "c0" and "d0" not in group and "two3" not in group
    assert dict(rows(got, "id", "links"))["a204"] == 210


def test_removals_keep_each_passage_once(spark):
    r = random.Random(21)
    a, b = words(r, 50), words(r, 50)
    docs = [(3, words(r, 20) + a), (1, a + words(r, 10)), (2, words(r, 9) + b), (4, b[20:] + words(r, 5) + a), (5, words(r, 40)), (6, None)]
    df = clash(spark.createDataFrame(docs, "doc long, body string"))
    text = {k: list(v) for k, v in docs if v}
    for i, x, y in sharedspans.removals(df, "doc", "body").select("id", "begin", "end").collect():
        text[i][x:y] = " " * (y - x)
    left = ["".join(t) for t in text.values()]
    assert all(sum(p in t for t in left) == 1 for p in (a, b)) and "".join(text[1]) == dict(docs)[1] and "".join(text[2]) == dict(docs)[2]
    assert sharedspans.removals(df.limit(0), "doc", "body").count() == 0


def test_one_index_serves_searches(spark):
    r = random.Random(22)
    items = [(i, words(r, 40)) for i in range(3)]
    docs = [(i, words(r, 20) + " " + items[i][1] + " " + words(r, 5)) for i in range(2)]
    index = leakage.build_index(spark.createDataFrame(docs, "doc long, text string"), "doc", "text")
    for some in (items[:1], items):
        it = spark.createDataFrame(some, "item long, text string")
        assert rows(leakage.search(index, it, "item"), "doc_id", "item_id") == [(i, i) for i, _ in some if i < 2]


def test_hot_passages_are_aggregated_over_tasks(spark, monkeypatch):
    r = random.Random(23)
    footer = words(r, 60)
    docs = [(i, words(r, 10) + footer + words(r, 10)) for i in range(30)] + [(50 + i, words(r, 20) + footer[40:300]) for i in range(3)] + [(90, words(r, 50))]
    df = spark.createDataFrame([*docs, (91, None)], "doc long, body string")
    want = spans(docs, 200)
    monkeypatch.setattr(sharedspans, "HOT", 5)
    assert rows(sharedspans.shared_spans(df, "doc", "body", 200), "id", "begin", "end") == want and len(want) == 33
    assert len({g for _, g in rows(sharedspans.sharing_groups(df, "doc", "body", 200), "id", "group_id")}) == 1
