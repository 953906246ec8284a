"""Language, toxicity, personal data, language model and codec against brute force and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from alloscan.llm import interpolated_lm as lm
from alloscan.llm import language_id as li
from alloscan.llm import personal_data as pd_
from alloscan.llm import piece_codec as pc
from alloscan.llm import toxicity as tx
from alloscan.session import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="module")
def package(spark):
    ship_package(spark)


def frame(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(rows, names).repartition(3)


def side(i, m):
    return zlib.crc32(str(i).encode()) % m


# --- language identification

SYLLABLES = {"aa": "the ing and tion er of".split(), "bb": "sch ung ein der über".split(), "cc": "que ción los ñ de".split()}


def speech(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_vector(t):
    s = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " ")
    v = np.zeros(li.DIMENSIONS)
    own = lambda c: li.letter_vectors(np.array([ord(c)]))[0]
    for a, b, c in zip(s, s[1:], s[2:]):
        v += np.roll(own(a), 2) * np.roll(own(b), 1) * own(c)
    return v


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_text_vectors_equal_sums_of_bound_letters(monkeypatch, block):
    monkeypatch.setattr(li, "BLOCK_CHARS", block)
    monkeypatch.setattr(li, "GRAMS", 16 if block == 7 else 8192)
    texts = ["Hello wörld 12 ab", "", "x", "日本語 text", "--", "a" * 30 + "   b", "İstanbul"]
    assert np.allclose(li.text_vectors(texts), [plain_vector(t) for t in texts])


def test_languages_of_held_out_rows_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, speech(rng, lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa"), (1001, "12 !", None), (None, speech(rng, "bb"), "bb"), (1002, speech(rng, "cc"), None), (5, rows[5][1], "cc")]
    got = li.identify(frame(spark, rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert (by[1000]["lang_pred"], by[1000]["score"], by[1001]["lang_pred"], by[1002]["lang_pred"]) == ("und", 0.0, "und", "cc")
    assert by[None]["held_out"] is False and by[None]["lang_pred"] == "bb"
    held = [r for r in got if r["held_out"]]
    assert all(side(r["doc_id"], 4) == 2 for r in held) and len(held) > 20
    truth = {i: lang for i, _, lang in rows if lang}
    assert sum(truth.get(r["doc_id"]) == r["lang_pred"] for r in held if r["doc_id"] in truth) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    none = li.identify(frame(spark, [(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)
    assert li.identify(frame(spark, rows, "doc_id long, text string, lang string").limit(0)).count() == 0


# --- language model


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


@pytest.mark.parametrize("hot", [1e-4, 0.02])
def test_scores_equal_plain_interpolation(spark, monkeypatch, hot):
    rng = random.Random(3)
    vocab = ["The", "of", "é", "Ünder"] * 6 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "the of"), (9, rows[9][1]), (502, "the " * 500)]
    docs = frame(spark, rows)
    models = []
    keep = lm.score
    monkeypatch.setattr(lm, "HOT_SHARE", hot)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 700)
    monkeypatch.setattr(lm, "score", lambda d, m, b: (models.append(m), keep(d, m, b))[1])
    got = lm.score_documents(docs).collect()
    model = models[0]
    learned = [(i, words(t)) for i, t in rows if i is not None and side(i, 7) != 2]
    c = Counter(w for _, ws in learned for w in ws)
    total, distinct = sum(c.values()), len(c)
    assert (model.total, model.distinct) == (total, distinct)
    name = lambda w: lm.END if w is None else lm.tokens([w])[0][0]
    h = {w: name(w) for _, t in rows for w in words(t)}
    named = lambda v: lm.START if v is None else h[v]
    pairs, contexts = Counter(), Counter()
    for _, ws in learned:
        for v, w in zip([None, *ws[:-1]], ws):
            pairs[(named(v), w)] += 1
            contexts[named(v)] += 1
    upper = Counter()
    for k, n in contexts.items():
        upper[int(k >> np.uint64(48))] += n
    assert all(model.classes[k] == n for k, n in upper.items())
    # the held-out cells are the deleted counts, and the weights maximise their likelihood
    assert np.allclose(model.weights.sum(1), 1)
    want = {}
    for i, t in rows:
        ws, s = words(t), 0.0
        for v, w in zip([None, *ws[:-1]], ws):
            k = named(v)
            lam = model.weights[0 if not contexts[k] else 1 + int(math.floor(math.log2(contexts[k])))]
            s += math.log10(lam[0] * pairs[(k, w)] / max(1, contexts[k]) + lam[1] * c[w] / total + lam[2] / (distinct + 1))
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws)
        want.setdefault(i, []).append((len(ws), sum(c[w] > 0 for w in ws), base, s))
    assert len(got) == len(rows)
    for r in got:
        n, known, base, s = want[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], s, rel_tol=1e-9)
        assert r["held_out"] == (r["doc_id"] is not None and side(r["doc_id"], 7) == 2)


def test_contexts_with_the_same_upper_bits_are_told_apart(spark, monkeypatch):
    upper = {}
    for w in (f"w{i}" for i in range(3000)):
        upper.setdefault(int(lm.tokens([w])[0][0] >> np.uint64(48)), []).append(w)
    alike = [ws[:2] for ws in upper.values() if len(ws) > 1][:8]
    assert len(alike) == 8
    rng = random.Random(5)
    rows = [(i, " ".join(f"{v} {k}x{j}" for _ in range(5) for j, two in [rng.choice(list(enumerate(alike)))] for k, v in [rng.choice(list(enumerate(two)))]))
            for i in range(300)]
    models, keep = [], lm.score
    monkeypatch.setattr(lm, "HOT_SHARE", 0.02)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(lm, "score", lambda d, m, b: (models.append(m), keep(d, m, b))[1])
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(frame(spark, rows)).collect()}
    pairs, before, c = Counter(), Counter(), Counter()
    for i, t in rows:
        if side(i, 7) != 2:
            ws = words(t)
            pairs.update(zip([None, *ws[:-1]], ws))
            before.update([None, *ws[:-1]])
            c.update(ws)
    for i, t in rows:
        ws, s = words(t), 0.0
        for v, w in zip([None, *ws[:-1]], ws):
            lam = models[0].weights[0 if not before[v] else 1 + int(math.floor(math.log2(before[v])))]
            s += math.log10(lam[0] * pairs[(v, w)] / max(1, before[v]) + lam[1] * c[w] / sum(c.values()) + lam[2] / (len(c) + 1))
        assert math.isclose(got[i], s, rel_tol=1e-9)


def test_weights_maximise_the_held_out_likelihood():
    cells = [(5, 4, 20, 100), (5, -1, 16, 50), (5, 8, 30, 25), (7, 2, 20, 60), (0, -1, 12, 5)]
    w = lm.learn_weights(cells, 1000)
    f = lambda x: 2.0 ** (-x / lm.CELL) if x >= 0 else 0.0
    value = lambda lam: sum(n * math.log(lam[0] * f(a) + lam[1] * f(b) + lam[2] / 1001) for k, a, b, n in cells if k == 5)
    best = max(value((a, b, 1 - a - b)) for a in np.arange(0, 1, 0.01) for b in np.arange(0, 1 - a, 0.01) if 1 - a - b > 0)
    assert value(w[5]) > best - 0.5 and w[0][0] == 0


def test_language_model_of_nothing(spark):
    assert lm.score_documents(frame(spark, [(1, "a")]).limit(0)).count() == 0
    held = next(i for i in range(100) if side(i, 7) == 2)
    r = lm.score_documents(frame(spark, [(held, "a b")])).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)


# --- toxicity


def numeric(f, array, at, eps=1e-2):
    old = array[at]
    array[at] = old + eps
    up = f()
    array[at] = old - eps
    down = f()
    array[at] = old
    return (up - down) / (2 * eps)


def test_network_gradient():
    rng = np.random.default_rng(0)
    p = tx.fresh(rng, 5)
    x = rng.normal(0, 1, (6, tx.WORD_DIM + tx.CHAR_DIM)).astype(np.float32)
    w = rng.integers(0, 7, (4, tx.WINDOW))
    w[2, 9:] = 6
    y, weight = np.array([1, 0, 1, 0], np.float32), np.full(4, 0.25, np.float32)

    def loss():
        z = tx.score_windows(p, *tx.gates(p, x), w).astype(float)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())
    grad = tx._gradient(p, x, w, y, weight)
    for name in ("out", "bias", "attend", "in_f", "in_b", "state_f", "state_b", "gate_f", "gate_b"):
        flat = p[name].reshape(-1)
        for k in rng.integers(0, len(flat), 4):
            assert abs(numeric(loss, flat, k) - grad[name].reshape(-1)[k]) < 2e-3, name
    for at in ((0, 3), (4, 15)):
        assert abs(numeric(loss, x, at) - grad["x"][at]) < 2e-3


def test_windows_cover_every_word_once_or_more():
    per_text = np.array([0, 1, 31, 32, 33, 56, 57, 400])
    first, text = tx.windows_of(per_text)
    offset = np.cumsum(per_text) - per_text
    for t, n in enumerate(per_text):
        seen = {a - offset[t] + k for a in first[text == t] for k in range(tx.WINDOW)} & set(range(n))
        assert seen == set(range(n)) and (text == t).sum() == max(1, math.ceil(max(0, n - 32) / 24) + 1)


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(150)]
    rows, labels = [], []
    for i in range(420):
        t = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        bad = i % 4 == 0
        for _ in range(1 + len(t) // 20 if bad else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["vile", "foul!", "Nasty"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "..."), (None, "w1 vile"), (1002, "w1 " * 4000 + "vile " + "w2 " * 4000)]
    labels += [(3, None), (None, 1), (7, 0)]
    got = tx.judge(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 420]
    assert all(side(r["doc_id"], 3) == 1 for r in held)
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert right > 0.95 * len(held)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert (by[1000], by[1001], by[1002]) == (0, 0, 1)
    none = tx.judge(frame(spark, rows[:3]), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 0)}


def test_long_text_in_parts_has_the_same_score(monkeypatch):
    rng = np.random.default_rng(1)
    p, known = tx.fresh(rng, 0), np.zeros(0, np.uint64)
    text = " ".join(f"x{i}" for i in range(3000))
    monkeypatch.setattr(tx, "BLOCK_CHARS", 2500)
    parts = tx.pieces(text)
    assert len(parts) > 3
    covered = set()
    for part in parts:
        at = text.find(part)
        covered |= set(range(at, at + len(part)))
    assert covered == set(range(len(text)))
    assert len(tx.score_texts(parts, known, p)) == len(parts)


# --- personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(t):
    d = [int(c) for c in t if c.isdigit()]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def plain_personal(t):
    ok = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), luhn, lambda s: 9 <= sum(c.isdigit() for c in s) <= 15]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, t) if ok[k](m[0]))


def test_base_patterns_equal_plain_regular_expressions():
    rng = random.Random(4)
    texts = ["a@b.com_x@c.com", "x@@y.z", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "+1 (132) 555-1352 +12 3456789", "é.q@ü.de a@b.c",
             "0" * 40 + ".1.2.3", "+1((((((", "9" * 3000 + "@a.b"]
    texts += ["".join(rng.choice("a1@.- +5(%_)é") for _ in range(50)) for _ in range(4000)]
    assert all(pd_.base_spans(t) == plain_personal(t) for t in texts)


def test_crf_decoding_and_gradient_equal_enumeration(monkeypatch):
    import itertools
    rng = np.random.default_rng(3)
    p = pd_.fresh(rng)
    p["step"], p["start"] = rng.normal(size=p["step"].shape), rng.normal(size=p["start"].shape)
    e = rng.normal(size=(4, 1, pd_.TAGS))
    step, first = pd_.steps_of(p)
    score = lambda s: first[s[0]] + sum(e[t, 0, k] for t, k in enumerate(s)) + sum(step[a, b] for a, b in zip(s, s[1:]))
    ways = list(itertools.product(range(pd_.TAGS), repeat=4))
    assert tuple(pd_.viterbi(p, e)[0]) == max(ways, key=score)
    weight = np.exp(np.array([score(s) for s in ways]))
    weight /= weight.sum()
    gold = np.array([[0, 1, 2, 0]])
    de, dstep, dstart = pd_.crf_gradient(p, e, gold)
    want = np.zeros((4, pd_.TAGS))
    for s, q in zip(ways, weight):
        for t, k in enumerate(s):
            want[t, k] += q
    for t, k in enumerate(gold[0]):
        want[t, k] -= 1
    assert np.allclose(de[:, 0], want, atol=1e-5) and np.allclose(dstart, want[0], atol=1e-5)


def personal_text(rng, i):
    ws = [rng.choice(["the", "of", "Mann", "être", "thing."]) for _ in range(30)]
    for _ in range(i % 3):
        ws.insert(rng.randrange(30), rng.choice([f"u{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
                                                ".".join(str(rng.randint(1, 255)) for _ in range(4)), str(rng.randint(10 ** 15, 10 ** 16 - 1))]))
    return " ".join(ws)


def test_network_finds_held_out_spans(spark):
    rng = random.Random(6)
    p = pd_.train([personal_text(rng, i) for i in range(400)])
    texts = [personal_text(rng, i) for i in range(200)]
    own = [{s for s in spans if s[1] != 2} for spans in pd_.network_spans(texts, p)]
    want = [{s for s in pd_.base_spans(t) if s[1] != 2} for t in texts]
    hit = sum(len(a & b) for a, b in zip(own, want))
    assert hit > 0.75 * sum(map(len, want)) and hit > 0.75 * sum(map(len, own))
    added = [len(every) - len(base) for base, every in pd_.all_spans([" ".join(["the", "Mann"] * 40)] * 3 + [""], p)]
    assert added == [0, 0, 0, 0]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (None, "a@b.cc"), (3, texts[3])]
    got = pd_.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text_of = dict(rows)
    for r in got:
        base = plain_personal(text_of[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(pd_.joined(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pd_.KINDS] == [sum(x == j for _, x, _ in base) for j in range(4)]
        assert set(filter(None, pd_.joined(base).split(","))) <= set(r["spans"].split(","))
    assert pd_.scan(frame(spark, [(1, "no digit here")])).first()["spans"] == ""


def test_addresses_without_digit_or_at_sign_come_back():
    rng = random.Random(7)
    plain = ["the", "of", "Mann", "être", "thing.", "host", "(or)", "[sic]", "at", "look at (this)"]
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))

    def text(mark):
        ws = [rng.choice(plain) for _ in range(30)]
        mail = f"{name()}{mark}{name()}.{rng.choice(['org', 'net', 'example.com'])}"
        at = rng.randrange(30)
        return " ".join([*ws[:at], mail, *ws[at:]]), (len(" ".join([*ws[:at], ""])), mail)
    p = pd_.train([text("@")[0] for _ in range(600)])
    cases = [text(m) for m in (" (at) ", " [at] ") for _ in range(60)]
    found = pd_.all_spans([t for t, _ in cases], p)
    hit = sum(any(k == 0 and a < start + len(mail) and start < b for a, k, b in every) for (_, (start, mail)), (_, every) in zip(cases, found))
    assert hit > 0.5 * len(cases)
    assert not any(every for _, every in pd_.all_spans([" ".join(rng.choice(plain) for _ in range(60)) for _ in range(60)], p))


def test_no_false_spans_in_repeated_words_and_good_ones_are_whole(monkeypatch):
    rng = random.Random(9)
    p = pd_.train([personal_text(rng, i) for i in range(400)])
    junk = [w * 30 for w in ("hehely ", "ewh rewh ", "from th ", "men ", "nwhwh", "9 8 ", "a@ ", "(at) ")] + ["look (at) this. Then [at] home.", "x (at) y", "me@ home is"]
    assert [t[:9] for t, (own, every) in zip(junk, pd_.all_spans(junk, p)) if set(every) - set(own)] == []
    cases, rows = [], [" (at) ", " [at] ", " @ "]
    for i in range(150):
        before, after = ("".join(rng.choice("abcde fgh ") for _ in range(rng.randint(0, 300))) for _ in range(2))
        mail = f"{rng.choice(['anna', 'b.smith', 'xx_y'])}{rng.choice(rows)}{rng.choice(['host.org', 'mail.example.com'])}"
        cases.append((f"{before} {mail} {after}", (len(before) + 1, 0, len(before) + 1 + len(mail))))
    found = [set(every) for _, every in pd_.all_spans([t for t, _ in cases], p)]
    hits = sum(want in got for (_, want), got in zip(cases, found))
    assert hits > 0.5 * len(cases) and all(pd_._ADDRESS.fullmatch(t[a:b]) for (t, _), got in zip(cases, found) for a, k, b in got if k == 0)
    # windows that are not run hold nothing that would be kept
    monkeypatch.setattr(pd_, "evidence", lambda r: np.ones(len(r), bool))
    assert [set(every) for _, every in pd_.all_spans([t for t, _ in cases], p)] == found


def test_windows_left_out_of_decoding_are_outside():
    rng = np.random.default_rng(2)
    p = pd_.fresh(rng)
    e = rng.normal(size=(12, 400, pd_.TAGS)).astype(np.float32)
    e[:, :, 0] += np.linspace(0, 4, 400)
    may = pd_.may_hold_a_span(p, e)
    assert not pd_.viterbi(p, e)[~may].any() and 0 < may.sum() < 400


# --- pieces


def plain_best(codec, text):
    """Best segmentation by trying every piece at every place."""
    pieces = {q: (i, s) for i, (q, s, kind) in enumerate(pc.load()) if kind == "piece"}
    best = [(0.0, [])] + [None] * len(text)
    for e in range(1, len(text) + 1):
        for b in range(max(0, e - 20), e):
            found = pieces.get(text[b:e])
            if found:
                s = best[b][0] + found[1]
                if best[e] is None or s > best[e][0]:
                    best[e] = (s, [*best[b][1], found[0]])
        if text[e - 1] not in codec.single:
            s = best[e - 1][0] + codec.unknown
            if best[e] is None or s > best[e][0]:
                best[e] = (s, [*best[e - 1][1], *(codec.byte_ids[x] for x in text[e - 1].encode())])
    return best[-1][1]


def test_codec_equals_brute_force_and_comes_back(spark):
    codec = pc.Codec(pc.load())
    texts = ["Hello world", " two  spaces ", "The thbleereon\nontion of", "été ñandú 日本 🙂 \t", "x", "a" * 70, "▁"]
    docs = [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    for t in texts + [t[:150] for t in docs]:
        ids = codec.encode(t)
        assert ids.tolist() == plain_best(codec, pc.MARK + t.replace(" ", pc.MARK)), t
        assert codec.decode(ids) == t.replace(pc.MARK, " ")
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (None, "z"), (0, texts[0])]
    out = pc.encode(frame(spark, rows))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[50]["n_tokens"] == got[51]["n_tokens"] == 0 and not got[6]["round_trip"] and got[3]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in pc.decode(out).collect()}
    assert all(back[i] == (t or "").replace(pc.MARK, " ") for i, t in rows)
    assert pc.encode(frame(spark, rows).limit(0)).count() == 0


def test_ranges_of_a_bucket_cover_every_entry_once(monkeypatch):
    rng = np.random.default_rng(5)
    parts = []
    for size in (0, 1, 40, 300):
        words = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1))
        parts.append((words, rng.integers(1, 4, len(words)).astype(np.uint8)))
    entries = [np.repeat(w, n) for w, n in parts]
    for limit in (7, 100, 10**6):
        monkeypatch.setattr(lm, "RANGE_ENTRIES", limit)
        seen, words_before = [[] for _ in parts], -1
        for words, number, mine in lm._ranges(parts):
            assert int(words[0]) > words_before  # a word is in one range only
            words_before = int(words[-1])
            assert np.array_equal(words[number], np.concatenate([e[i] for e, i in zip(entries, mine)]))
            for k, i in enumerate(mine):
                seen[k].append(entries[k][i])
        assert all(np.array_equal(np.concatenate(s), e) for s, e in zip(seen, entries))
    rising = np.sort(rng.integers(0, 1 << 63, 50, dtype=np.uint64))
    wraps = np.array([250, 3, 255, 0], np.uint8)
    got = lm.unpack(lm.pack(lm.steps(rising), lm.steps(wraps), wraps, np.array([0.5, -1.0]), wraps[:0]), "ssudu")
    assert all(np.array_equal(a, b) for a, b in zip(got, (rising, wraps, wraps, np.array([0.5, -1.0]), wraps[:0])))
