"""The operators' kernels without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filmgrain.llm import abuse, language, leakage, mixing, neardup, neighbours, privacy, splitting
from filmgrain.llm import textarrays as ta
from filmgrain.llm.runs import whole_runs

TEXT = st.text(st.one_of(st.sampled_from("ab cé.\n!?đ🎬 ́‍1"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_a_regex(texts):
    cps, offs = ta.decode(pa.array(texts, pa.string()))
    start, end, first = ta.words(cps, offs)
    for i, t in enumerate(texts):
        got = ["".join(map(chr, cps[a:b])) for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])]
        assert got == re.findall(r"[^\W_]+", t or "")


def test_hashes_do_not_depend_on_place_or_case():
    cps, offs = ta.decode(pa.array(["Great film here", "a very GREAT Film"]))
    s, e, f = ta.words(cps, offs)
    h = ta.word_hashes(cps, s, e)
    assert h[0] == h[5] and h[1] == h[6] and len(set(h.tolist())) == 5
    g, begin = ta.shingle_hashes(h, f, 2)
    assert begin.tolist() == [0, 2, 5] and g[0] == g[4]


def cut(text, size, overlap):
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.array(splitting.cuts(c, splitting.landmarks(c), size, overlap)).reshape(-1, 3)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(60, 10), (100, 20), (50, 0)]))
def test_pieces_are_small_overlap_and_lose_nothing(seed, limits):
    r = random.Random(seed)
    text = "".join(r.choice(["word ", "end. ", "\n\n", "x" * r.randint(1, 90), "́", "🎬", "  ", "Tốt! "]) for _ in range(r.randint(1, 60)))
    size, overlap = limits
    if len(text) <= size:
        return
    p = cut(text, size, overlap)
    assert p[0, 0] == 0 and p[-1, 1] == len(text) and (p[:, 1] - p[:, 0] <= size).all() and (p[1:, 0] > p[:-1, 0]).all()
    assert "".join(text[f:e] for _, e, f in p) == text
    assert (p[1:, 2] - p[1:, 0] <= 1.5 * overlap + 1).all()


def test_an_edit_changes_only_the_pieces_around_it():
    r = random.Random(1)
    text = " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) + ("." if r.random() < 0.1 else "") for _ in range(4000))
    pieces = lambda t: {t[s:e] for s, e, _ in cut(t, 1000, 100)}
    a, b = pieces(text), pieces(text[:500] + "edit " + text[500:])
    assert len(a & b) > 0.7 * len(a)


def test_cuts_stand_at_sentence_ends():
    text = "This is a sentence of some words. " * 100
    assert all(text[:e].rstrip().endswith(".") for _, e, _ in cut(text, 300, 50))


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Write to a.b+c@mail.example.org now", ["email"]),
        ("mail jo (at) mail (dot) example or jo2 AT mail DOT example", ["email", "email"]),
        ("Meet us @ 7 pm @ the foyer, @owl said", []),
        ("Call me on 020 7946 0501 or +1 (696) 555-0131", ["phone", "phone"]),
        ("Reach me: two eight seven five five five zero one one four.", ["phone"]),
        ("my passport, 947-36-8591, at the door", ["id_number"]),
        ("Catalogue no. 642-99-5950. The budget was 36,500,000", []),
        ("It opened on 12-03-1916; runtime 01:20:20", []),
        ("we live at 94 Hollow Lane, Upper Haven.", ["address"]),
        ("Wir wohnen Lerchenweg 12a, 00455 Burg", ["address"]),
        ("Nhà tôi ở số 195 đường Hoa Sậy, phường Vĩnh An", ["address"]),
        ("The chase ends on Quill Street in the third act", []),
        ("I saw it with my cousin Ann Dravby. Signed, Bo O. Thale", ["name", "name"]),
        ("Directed by Ann Dravby. My sister insists the score drags", []),
        ("１２３ ＋44 7700 900 041 call", ["phone"]),
        ("", []),
    ],
)
def test_findings(text, kinds):
    assert [k for k, _, _ in privacy.find(text)] == kinds
    cps, offs = ta.decode(pa.array([text]))
    assert [k for k, _, _ in privacy.find(text, int(privacy.suspects(cps, offs)[0]))] == kinds  # the gate loses nothing


@pytest.mark.parametrize(
    "text",
    ["jo[@]mail.com", "jo@mail[.]com", "jo@mail (dot) com", "jo [a cong] mail.com", "jo ( a còng ) mail.com", "jo {  @  } mail {  .  } com", "jo <   at   > mail.com", "jo at my-own-very-long-mail-host dot com", "jo (a\u200bt) mail.com", "jo@a-b-c-d-e-f-g-h (punkt) de", "(jo＠mail［．］com)"],
)
def test_disguised_addresses_pass_the_gate(text):
    text = f"Write to me: {text}, thanks"
    cps, offs = ta.decode(pa.array(["No sign here.", text, ""]))
    steps = privacy.suspects(cps, offs)
    assert [k for k, _, _ in privacy.find(text, int(steps[1]))] == ["email"] and steps[[0, 2]].tolist() == [0, 0]
    assert privacy.find(text, int(steps[1])) == privacy.find(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["jo", "mail", "com", "a", "at", "AT", "a cong", "a còng", "arroba", "chez", "dot", "Punkt", "point", "@", ".", "(", ")", "[", "]", "<", "}", " ", " ", "  ", "\n", "-", "\u200b", "\xa0", "＠"]), max_size=14))
def test_the_gate_loses_no_address(parts):
    text = "jo " + "".join(parts)
    steps = int(privacy.suspects(*ta.decode(pa.array([text])))[0])
    assert [f for f in privacy.find(text, steps) if f[0] == "email"] == [f for f in privacy.find(text) if f[0] == "email"]


def test_spans_are_those_of_the_source():
    text = "é​crire à jo​.x (at) mail (dot) example, merci"
    ((kind, a, b),) = privacy.find(text)
    assert kind == "email" and text[a:b] == "jo​.x (at) mail (dot) example"
    assert privacy.redact(text, privacy.find(text)) == "é​crire à [EMAIL], merci"


def test_codewords_differ_in_half_of_the_bits():
    c = language.code(5)
    assert c.shape == (5, 15) and all((c[i] != c[j]).sum() == 8 for i in range(5) for j in range(i))


SAMPLES = {
    "en": ["the film was slow but the ending is a small miracle for everyone", "what a great story about the people of this town"],
    "fr": ["le film était lent mais la fin est un petit miracle pour tous", "quelle belle histoire des gens de cette ville"],
    "es": ["la película era lenta pero el final es un pequeño milagro para todos", "qué gran historia sobre la gente de este pueblo"],
    "de": ["der film war langsam aber das ende ist ein kleines wunder für alle", "was für eine schöne geschichte über die leute dieser stadt"],
    "vi": ["phim hơi chậm nhưng cái kết là một phép màu nhỏ cho mọi người", "một câu chuyện hay về những người dân của thị trấn này"],
}


def test_languages_of_mixed_text():
    texts = [t for ts in SAMPLES.values() for t in ts * 8]
    labels = [k for k, ts in SAMPLES.items() for _ in ts * 8]
    model = language.train(texts, labels)
    mixed = "The film was slow but the ending is great. Le film était lent mais la fin est un miracle."
    batch = pa.record_batch({"id": ["a", "b", "c"], "text": [mixed, None, "..."]})
    rows = pa.Table.from_batches(list(language._segments(model)([batch]))).to_pylist()
    assert [(r["id"], r["found"]) for r in rows] == [("a", "en"), ("a", "fr")]
    assert rows[0]["begin"] == 0 and rows[0]["end"] == rows[1]["begin"] and rows[1]["end"] == len(mixed)


def test_excursions_are_the_best_segments():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = rng.integers(0, 9, 4)
        first = np.concatenate([[0], np.cumsum(n)])
        s = rng.normal(-0.3, 1, first[-1])
        a, b, top = abuse.excursions(s, first)
        text = np.searchsorted(first, a, "right") - 1
        for t in range(4):
            x = s[first[t] : first[t + 1]]
            best = max([x[i : j + 1].sum() for i in range(len(x)) for j in range(i, len(x))], default=0)
            assert np.isclose(max(top[text == t], default=0), max(best, 0))
        assert all(np.isclose(s[i : j + 1].sum(), v) for i, j, v in zip(a, b, top))


def test_disguises_are_undone():
    for text, want in (("st00pid m0r0n", "stoopid moron"), ("s t u p i d film", "stupid film"), ("stuuuupid", "stupid"), ("v.i.l.e.", "vile."), ("CÂM MỒM 2024", "cam mom 2024")):
        c, o, place = abuse.plain(*ta.decode(pa.array([text])))
        assert "".join(map(chr, c)) == want and len(place) == len(c)


def test_abuse_model_finds_what_it_learnt():
    r = random.Random(0)
    calm = ["the score drags", "a quiet kind of dread", "the ending glows", "what a stupid plot", "see it twice"]
    bad = ["you are a worthless parasite", "shut your filthy mouth you moron"]
    texts, labels = [], []
    for i in range(200):
        parts = r.choices(calm, k=4)
        if i % 4 == 0:
            parts.insert(r.randrange(5), r.choice(bad))
        texts.append(". ".join(parts))
        labels.append(int(i % 4 == 0))
    model = abuse.train(texts, labels)
    t = abuse.Tokens(*ta.decode(pa.array(["the ending glows. you are a w0rthless paraaasite", "the score drags", "", None])))
    assert (abuse.severities(model, t)[0] >= model.cutoff).tolist() == [True, False, False, False]
    assert abuse.train(["a"], [1]).cutoff == np.inf


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**33), max_size=50))
def test_packing_goes_round(values):
    data, end = leakage.pack(np.array(values, np.int64))
    assert leakage.unpack(data).tolist() == values and (not values or end[-1] == len(data))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.01, 0.99))
def test_pivoting_keeps_tokens(seed, share):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 900, rng.integers(1, 200))
    part, held = mixing.pivot(np.full(len(size), share), size, rng.random(len(size)))
    assert np.isclose((part * size).sum(), share * size.sum())
    assert all(p in (0.0, 1.0) for i, p in enumerate(part) if i != held)


def test_pivoting_is_fair():
    rng = np.random.default_rng(1)
    size = np.array([10, 200, 30, 400, 50])
    runs = [mixing.pivot(np.full(5, 0.4), size, rng.random(5)) for _ in range(4000)]
    mean = np.mean([p for p, _ in runs], axis=0)
    assert np.allclose(mean, 0.4, atol=0.04)


def test_forest_recall_against_brute_force():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 48))
    x = centres[rng.integers(0, 20, 3000)] + 0.5 * rng.standard_normal((3000, 48))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    forest = neighbours.Forest(x[::3], 60, 2)
    home, visit = forest.route(x, 6)
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -2
    top = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([visit[i][home[top[i]]].any(1).mean() for i in range(200)]) >= 0.9
    back = neighbours.unpacked(neighbours.packed(np.arange(len(x)), x))
    assert np.abs((back * x).sum(1) - 1).max() < 1e-5


def test_runs_are_whole():
    keys = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4]
    for size in (1, 2, 3, 10):
        batches = [pa.record_batch({"k": pa.array(keys[i : i + size], pa.int64())}) for i in range(0, 10, size)]
        got = [t.column("k").to_pylist() for t in whole_runs(iter(batches), "k")]
        assert sum(got, []) == keys and all(a[-1] != b[0] for a, b in zip(got, got[1:]))


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(3)
    n, size = 4000, 100  # 75 of 125 shingles in common: J = 0.60
    both = rng.integers(0, 2**64, (n, 75), np.uint64)
    (k, s), (m, t) = (neardup.fingerprint(np.concatenate([both, rng.integers(0, 2**64, (n, 25), np.uint64)], 1).ravel(), np.arange(n) * size, neardup.shape(0.6).blocks) for _ in range(2))

    def enough(same, bits):
        few = np.array([1000, *neardup.shape(0.6).agree])
        return bits >= few[np.minimum(same.sum(1), 3)]

    met = (k == m).any(1) & enough(k == m, neardup._agree(*(np.ascontiguousarray(x).view(np.int64) for x in (s[:, 0], s[:, 1], t[:, 0], t[:, 1]))))
    assert met.mean() >= 0.9995


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["go t0", "$$$4ll", "a", "b", "s t u p i d", "aaa", "aa", "0", "@", "st00pid", ".", "x y z w"]), max_size=4).map(" ".join), min_size=1, max_size=5))
def test_a_text_reads_the_same_in_any_batch(texts):
    c, o, place = abuse.plain(*ta.decode(pa.array(texts)))
    offs = ta.decode(pa.array(texts))[1]
    for i, t in enumerate(texts):
        alone, _, own = abuse.plain(*ta.decode(pa.array([t])))
        assert c[o[i] : o[i + 1]].tolist() == alone.tolist() and (place[o[i] : o[i + 1]] - offs[i]).tolist() == own.tolist()


def test_few_labels_flag_no_large_share():
    r = random.Random(4)
    calm = [" ".join(r.choices("score drags quiet dread ending glows slow plot twist camera light scene actor story".split(), k=6)) for _ in range(300)]
    bad = ["you are a worthless parasite", "shut your filthy mouth you moron", "crawl back to where you came from"]

    def text(case):
        return ". ".join(r.choices(calm, k=6) + ([r.choice(bad)] if case else []))

    case = [int(i % 4 == 0) for i in range(80)]
    texts = [text(c) for c in case]
    case[3] = 1  # a wrong label
    corpus = [text(i % 40 == 0) for i in range(2000)]
    every = abuse.Tokens(*ta.decode(pa.array(corpus)))
    model = abuse.train(texts, case, lambda v: (abuse.Background.tally(every, v), len(every.word)), corpus)
    flagged = abuse.severities(model, every)[0] >= model.cutoff
    assert flagged[::40].mean() >= 0.9 and flagged.mean() <= 0.04


PARTS = (
    "Ann Dravby|Bo O. Thale|Dravby, Ann|signed|my cousin|Dr.|- |— |here|from my office|hier|12|345|020 7946 0501|+44|SSN 921-14-8805|ID 069616780965|national|passport|A1234567|call|(at)|[@]|@|mail|com|.|[.]|dot|at|"
    "two eight seven|five five five|zero|94 Hollow Lane|12a|Lerchenweg|straße 5|Bahnhofstr.|rue de la Paix|12 bis|calle Mayor|7|số 195|đường Hoa|P.O. Box|flat 3,|Street|\n|​|\xa0|,|:|is|<p>|х|１２３４５６|không một hai ba bốn|năm|hàng xóm nhà tôi|cảm ơn|merci à|regards,"
).split("|")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PARTS), st.sampled_from(["", " ", " ", ", "])), min_size=1, max_size=9))
def test_the_gate_loses_nothing(parts):
    text = "".join(a + b for a, b in parts)
    steps = int(privacy.suspects(*ta.decode(pa.array([text])))[0])
    assert privacy.find(text, steps) == privacy.find(text)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.from_regex(re.compile(rf"(?:{privacy.RELATIVES}|{privacy.SIGNED})"), fullmatch=True)))
def test_every_cue_passes_the_gate(cue):
    text = f"x {cue} Ann Dravby."
    steps = int(privacy.suspects(*ta.decode(pa.array([text])))[0])
    assert privacy.find(text, steps) == privacy.find(text)


@pytest.mark.parametrize(
    "text, kinds",
    [("SSN 921-14-8805, yes", ["id_number"]), ("Refund case under national ID 069616780965", ["id_number"]), ("- Tobiah K. Fenwelby Shonaraon plays", ["name"]), ("- The Gentle Carousel has restless anger", []), ("A-12 345 678 units", [])],
)
def test_cues_written_before_numbers_and_signatures(text, kinds):
    found = privacy.find(text)
    assert [k for k, _, _ in found] == kinds
    assert all(not text[a:b].startswith(("SSN", "ID")) for _, a, b in found)


def test_ambiguous_segments_are_flagged():
    texts = [t for ts in SAMPLES.values() for t in ts * 8]
    model = language.train(texts, [k for k, ts in SAMPLES.items() for _ in ts * 8])
    batch = pa.record_batch({"id": ["a", "b"], "text": ["the film was slow but the ending is a small miracle for everyone", "la de"]})
    sure, unsure = pa.Table.from_batches(list(language._segments(model)([batch]))).to_pylist()
    assert sure["found"] == "en" and not sure["ambiguous"] and sure["runner_up"] != "en" and sure["confidence"] >= language.SURE
    assert unsure["ambiguous"] and unsure["runner_up"] != unsure["found"] and unsure["confidence"] < language.SURE
