"""Classifiers and personal data."""

import random
import re

import numpy as np
import pytest

from meetloom.llm import pii, quality, toxicity


def labelled(spark, kind):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("an", "ere", "ish", "out", "ing")]
    rows, labels = [], []
    for i in range(700):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        y = i % 4 == 0
        if y and kind == "toxic":
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["vilefoo", "vilebar", "grosk"]))
        if not y and kind == "quality":
            text = [w + "!!" for w in text] if i % 2 else [text[0]] * len(text)
        rows.append((i, " ".join(text), None, f"s{i % 3}", 0))
        if i % 10:
            labels.append((i, int(y), int(y)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "  ", None, None, None), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "kind"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, module, kind):
    docs, labels = labelled(spark, kind)
    rows = module.score(docs, labels).collect()
    assert len(rows) == 704
    unseen = [r for r in rows if r.held_out and r.doc_id < 700]
    assert len(unseen) > 100
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in unseen]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels_no_documents(docs, no_docs, spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.score(docs, none).collect()} == {0.0}
    assert module.score(no_docs, none).count() == 0


def test_drop_toxic_keeps_columns(spark):
    docs, labels = labelled(spark, "toxic")
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    assert 515 < left.count() < 545


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        _, begin, length = toxicity._windows(np.array([0, n]))
        assert set().union(*(range(b, b + m) for b, m in zip(begin, length, strict=True))) == set(range(n))


def test_network_gradients():
    """Backward against finite differences."""
    rng = np.random.default_rng(0)
    net = toxicity.Network(5, 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = rng.standard_normal((6, 2 * toxicity.EMBED))
    places, mask = rng.integers(0, 6, (4, 3)), np.ones((4, 3))
    mask[2:, 1] = 0
    weight = rng.standard_normal(3)
    _, state = net.forward(rows, places, mask, keep=True)
    grads, drows = net.backward(rows, places, mask, state, weight)
    for name, at in (("rec_f", (1, 2)), ("in_b", (0, 9)), ("key", (3, 1)), ("query", (2,)), ("out", (4,)), ("b_f", (17,))):
        kept = net.p[name][at]
        values = []
        for step in (1e-3, -1e-3):
            net.p[name][at] = kept + step
            values.append(float(net.forward(rows, places, mask) @ weight))
        net.p[name][at] = kept
        assert abs((values[0] - values[1]) / 2e-3 - grads[name][at]) < 2e-2
    assert drows.shape == rows.shape


def brute_base(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_base_spans_against_plain_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("a1.@+ -()2.5é%") for _ in range(rng.choice([5, 20, 60])))
        assert pii.base_spans(text) == brute_base(text)


def test_personal_data(spark, docs, no_docs, corpus):
    rows = [(i, f"é word{i} mail{i}.x@host{i % 7}.example.org and +1 (375) 555-{1000 + i} or 4111 1111 1111 1111 at 10.0.{i}.7") for i in range(200)]
    rows += [(900, "reach ann.lee (at) host3.example.org"), (901, None), (902, ""), (903, "nothing at all")]
    found = {r.doc_id: r for r in pii.pii_digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (found[5].n_email, found[5].n_ip, found[5].n_card, found[5].n_phone) == (1, 1, 1, 1)
    assert "email:6:36" in found[900].spans
    assert found[901].spans == found[902].spans == found[903].spans == ""
    assert pii.pii_digest(pii.find_personal_data(docs)).count() == len(corpus)
    assert pii.pii_digest(pii.find_personal_data(no_docs)).count() == 0


def test_long_zero_runs(spark):
    """Parts of an address with more digits than Python converts, as base spans, in the sample's features and as no address."""
    zeros = "0" * 4400
    texts = [".".join([*["1"] * k, zeros, *["2"] * (3 - k)]) for k in range(4)] + [f"{zeros}9.1.2.3", f"{zeros}256.1.2.3", f"{'9' * 5000}.1.2.3", ".".join([zeros] * 4), f"1.2.3.{zeros}7 a@b.org"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.n_ip for r in pii.pii_digest(pii.find_personal_data(docs)).collect()}
    assert [got[i] for i in range(len(texts))] == [1, 1, 1, 1, 1, 0, 0, 1, 1]


def test_obfuscated_cases_are_found(spark):
    """A tenth of the documents have written-out data; the unlabelled cases don't teach that these are none."""
    rng = random.Random(11)
    rows, hidden, clean = [], {}, set()
    for i in range(1500):
        name, host, quad = f"{rng.choice(['ann', 'bo.lee', 'kim_x'])}{i}", f"host{i % 37}", [rng.randrange(1, 250) for _ in range(4)]
        number = f"4{rng.randrange(10**14):014d}"
        card = next(number + d for d in "0123456789" if pii.luhn(number + d))
        if i % 10 == 0:
            text, what = (
                (f"{name} (at) {host}.example.org", "email"), (f"{name} at {host} dot example dot org", "email"), (f"{name}[at]{host}[dot]net", "email"),
                ("[.]".join(map(str, quad)), "ip"), (" dot ".join(map(str, quad)), "ip"), ("/".join(card[j : j + 4] for j in (0, 4, 8, 12)), "card"),
            )[i // 10 % 6]
            before = {"email": "mail ", "ip": "server ", "card": "card no "}[what]
            hidden[i] = (what, len(before), len(before) + len(text))
            rows.append((i, f"{before}{text} for more"))
        elif i % 10 < 3:
            clean.add(i)
            rows.append((i, f"look at www.{host}.org on 2023-0{1 + i % 9}-11 09.30 or 10 . 20 . {300 + i % 90} . 7, part {rng.randrange(10**6)} of 1.000.000"))
        else:
            rows.append((i, f"mail {name}@{host}.example.org or +{i % 9 + 1} {200 + i % 700} 555-{1000 + i % 9000} from {'.'.join(map(str, quad))} with card {card}"))
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    hits = [(i, s) for i, s in hidden.items() if any((x.kind, x.start, x.end) == s for x in found[i].spans)]
    assert len(hits) >= 0.9 * len(hidden)
    assert sum(len(found[i].spans) for i in clean) <= 0.01 * len(clean)


def test_forms_that_training_never_makes(spark):
    """Written-out data in forms other than those that training rewrites base spans to."""
    rng = random.Random(12)
    rows, hidden, clean = [], {}, set()
    for i in range(1500):
        name, host, q = f"{rng.choice(['ann', 'bo.lee', 'kim_x'])}{i}", f"host{i % 37}", [rng.randrange(1, 250) for _ in range(4)]
        number = f"4{rng.randrange(10**14):014d}"
        card = next(number + d for d in "0123456789" if pii.luhn(number + d))
        if i % 10 == 0:
            text, what = (
                (f"{name} [at] {host} dot org", "email"), (f"{name}@{host} dot example dot org", "email"), (f"{name} (at) {host} [dot] net", "email"), (f"{name}(at){host}(dot)net", "email"),
                (f"{q[0]}.{q[1]}[.]{q[2]} dot {q[3]}", "ip"), ("[dot]".join(map(str, q)), "ip"), (". ".join(card[j : j + 4] for j in (0, 4, 8, 12)), "card"), (f"{card[:6]}_{card[6:12]}/{card[12:]}", "card"),
            )[i // 10 % 8]
            before = {"email": "mail ", "ip": "server ", "card": "card no "}[what]
            hidden[i] = (what, len(before), len(before) + len(text))
            rows.append((i, f"{before}{text} for more"))
        elif i % 10 < 3:
            clean.add(i)
            rows.append((i, f"look at www.{host}.org on 2023-0{1 + i % 9}-11 09.30 or 10 . 20 . {300 + i % 90} . 7, part {rng.randrange(10**6)} of 1.000.000"))
        else:
            rows.append((i, f"mail {name}@{host}.example.org or +{i % 9 + 1} {200 + i % 700} 555-{1000 + i % 9000} from {'.'.join(map(str, q))} with card {card}"))
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    hits = [i for i, s in hidden.items() if any((x.kind, x.start, x.end) == s for x in found[i].spans)]
    assert len(hits) >= 0.9 * len(hidden)
    assert sum(len(found[i].spans) for i in clean) <= 0.01 * len(clean)


def test_spans_taken_against_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        spans = [("email", a, a + rng.randrange(1, 9)) for a in rng.sample(range(60), 6)]
        taken = pii.Taken(spans)
        for a in range(60):
            for b in (a + 1, a + 5):
                assert taken.meets(("ip", a, b)) == any(a < e and s < b for _, s, e in spans)


def test_long_texts_take_linear_time():
    import time

    began = time.process_time()
    for text in ("7" * 3_000_000, "1.2" * 400_000, "a@" * 500_000, "+1 (" * 300_000, "x at y.z " * 50_000, "1 2" * 400_000):
        pii.base_spans(text)
        pii.proposals(text)
    many = " ".join(f"u{i}@h.org 10[.]0[.]0[.]{i % 200}" for i in range(20_000))
    assert len(pii.all_spans(many, None)[0]) == 20_000
    taken = pii.Taken(pii.base_spans(many))
    assert sum(not taken.meets(s) for s in pii.proposals(many)) == 20_000
    assert time.process_time() - began < 20


def test_redaction(spark):
    rows = [(i, f"mail a{i}@b.example.org, call +1 (375) 555-{1000 + i}") for i in range(60)] + [(90, None), (91, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans")
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[7] == "mail [email], call [phone]" and got[90] is None and got[91] == "nothing"
    assert pii.redacted("ab cd ef", [("email", 0, 5), ("ip", 3, 8)]) == "[email]"


def plain_vectors(words, shapes):
    """Index vectors of hashes as plain lists."""
    out = {}
    for h in {*words, *shapes}:
        at, sign = quality.index_entries(np.array([h], np.uint64))
        vector = [0.0] * quality.DIMENSIONS
        for i, s in zip(at[0], sign[0], strict=True):
            vector[i] += s
        out[h] = vector
    return out


def test_word_vectors_against_loops(spark):
    """Common words, context vectors and pooled documents, recomputed one word at a time."""
    rng = random.Random(9)
    texts = [None, "", " ", *(" ".join(rng.choice(["one", "Two", "three!", "44", "one"]) if rng.random() < 0.8 else f"rare{rng.randrange(99)}" for _ in range(rng.randrange(1, 40))) for _ in range(30))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    each = []
    for t in texts:
        w, s, _ = quality.words_of([t])
        each.append((w.tolist(), s.tolist()))
    assert [len(w) for w, _ in each] == [len((t or "").split()) for t in texts]
    total = sum(len(w) for w, _ in each)
    counts = {}
    for w, s in each:
        for h in (*w, *s):
            counts[h] = counts.get(h, 0) + 1
    common = sorted(h for h, n in counts.items() if n >= 0.02 * total)
    found = quality.common_words(docs, "text", 0.02)
    assert found.tolist() == common and 5 < len(common) < len(counts)
    index = plain_vectors([h for w, _ in each for h in w], [h for _, s in each for h in s])
    sums = {h: np.zeros(quality.DIMENSIONS) for h in common}
    for w, s in each:
        for i in range(len(w)):
            for kind, other in ((w, s), (s, w)):
                if kind[i] in sums:
                    sums[kind[i]] += index[other[i]]
                    for j in range(max(0, i - quality.REACH), min(len(w), i + quality.REACH + 1)):
                        if j != i:
                            sums[kind[i]] += index[kind[j]]
    vectors = quality.context_vectors(docs, quality.Known(found))
    for k, h in enumerate(common):
        assert np.allclose(vectors[k + 1], sums[h] / max(np.linalg.norm(sums[h]), 1e-9), atol=1e-5)
    unit = {h: vectors[k + 1] for k, h in enumerate(common)}
    pooled = quality.pooled(texts, quality.Known(found), vectors)
    for row, (w, s) in zip(pooled, each, strict=True):
        n = max(1, len(w))
        want = [part for x in (w, s) for part in (np.sum([index[h] for h in x], axis=0) / n if x else np.zeros(64), sum((unit.get(h, np.zeros(64)) for h in x), np.zeros(64)) / n)]
        assert np.allclose(row, [*np.concatenate(want), np.log1p(len(w))], atol=1e-4)


def test_pooling_long_texts_in_steps(monkeypatch):
    texts = ["a b c d " * 50, None, "e f " * 9]
    known = quality.Known(np.unique(np.concatenate(quality.words_of(texts)[:2])))
    vectors = np.random.default_rng(0).standard_normal((len(known.hashes) + 1, quality.DIMENSIONS)).astype(np.float32)
    whole = quality.pooled(texts, known, vectors)
    monkeypatch.setattr(quality, "STEP", 7)
    assert np.allclose(whole, quality.pooled(texts, known, vectors), atol=1e-5)


def plain_logit(net, inputs):
    """A window's logit in plain loops."""
    def gate(x):
        return 1 / (1 + np.exp(-x))

    H = toxicity.HIDDEN
    states = {}
    for side, order in (("f", range(len(inputs))), ("b", range(len(inputs) - 1, -1, -1))):
        h = [0.0] * H
        for t in order:
            x = [sum(inputs[t][i] * net.p[f"in_{side}"][i, j] for i in range(len(inputs[t]))) + net.p[f"b_{side}"][j] for j in range(3 * H)]
            rec = [sum(h[i] * net.p[f"rec_{side}"][i, j] for i in range(H)) for j in range(3 * H)]
            z = [gate(x[j] + rec[j]) for j in range(H)]
            r = [gate(x[H + j] + rec[H + j]) for j in range(H)]
            n = [np.tanh(x[2 * H + j] + r[j] * rec[2 * H + j]) for j in range(H)]
            h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(H)]
            states[side, t] = h
    both = [states["f", t] + states["b", t] for t in range(len(inputs))]
    e = [np.exp(sum(np.tanh(sum(s[i] * net.p["key"][i, j] for i in range(2 * H))) * net.p["query"][j] for j in range(H))) for s in both]
    pooled = [sum(e[t] * both[t][i] for t in range(len(both))) / sum(e) for i in range(2 * H)]
    return sum(p * o for p, o in zip(pooled, net.p["out"], strict=True)) + net.p["bias"][0]


def test_forward_against_loops():
    rng = np.random.default_rng(3)
    net = toxicity.Network(5, 5)
    rows = rng.standard_normal((9, 2 * toxicity.EMBED)).astype(np.float32)
    places, mask = rng.integers(0, 9, (6, 2)), np.ones((6, 2), np.float32)
    mask[4:, 1] = 0
    got = net.forward(rows, places, mask)
    assert abs(got[0] - plain_logit(net, rows[places[:, 0]].tolist())) < 1e-4
    assert abs(got[1] - plain_logit(net, rows[places[:4, 1]].tolist())) < 1e-4
