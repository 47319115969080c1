import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from packwright.llm import langid


def test_held_out_rows_are_told_and_predicted_right(spark, sf_medium):
    docs = spark.read.parquet(f"{sf_medium}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_change_nothing(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = langid.held_out(docs["doc_id"])
    wrong = docs.withColumn("lang", langid.F.when(out, "xx").otherwise(docs["lang"]))
    a, b = langid.train(docs), langid.train(wrong)
    assert a.languages == b.languages and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_edges(spark, edge_docs, edge_rows, sf_small):
    model = langid.train(spark.read.parquet(f"{sf_small}/documents.parquet"))
    got = langid.predict(edge_docs, model).collect()
    assert len(got) == len(edge_rows)
    readable = sorted((i or -1) for i, t in edge_rows if t and any(c.isalpha() for c in t))
    assert sorted((r.doc_id or -1) for r in got if r.lang_pred != "und") == readable
    assert all(r.score == 0 for r in got if r.lang_pred == "und")


def test_without_labels_nothing_is_known(edge_docs, no_docs):
    model = langid.train(edge_docs)
    assert model.languages == []
    assert {(r.lang_pred, r.score) for r in langid.predict(edge_docs, model).collect()} == {("und", 0.0)}
    assert langid.identify(no_docs).collect() == []


def test_rare_languages_stay_beside_many_full_ones(spark):
    """40 full languages and ten of one row each; all rows of those are learned from."""
    learned = [i for i in range(12_000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"text of k{i % 40:02d} k{i % 40:02d}", f"k{i % 40:02d}") for i in learned[:4000]]
    rows += [(i, chr(0x3B1 + n) * 8, f"rare{n}") for n, i in enumerate(learned[4000:4010])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    params = langid.Params(rows_per_language=50, most_rows=400)
    sample = langid.labelled_sample(langid.learnable(docs), params)
    model = langid.train(docs, params)
    assert len(sample) == 40 * 9 + 10 and len(model.languages) == 50
    for n in range(10):
        assert (model.weights[:, model.languages.index(f"rare{n}")] > 0).any()


def test_elastic_net_leaves_few_weights_and_temperature_calibrates():
    draw = np.random.default_rng(0)
    params = langid.Params(bits=8, l1=1.0)
    rows = []
    for _ in range(300):
        y = int(draw.integers(2))
        buckets = np.unique(np.concatenate([[y], draw.integers(2, 256, 20)]))
        rows.append((buckets, np.full(len(buckets), 0.3), y))
    weights = langid.fit(rows, 2, params)
    assert (weights != 0).mean() < 0.2 and weights[0, 0] > 0 > weights[0, 1]
    scores = draw.normal(size=(4000, 3))
    labels = np.array([draw.choice(3, p=p) for p in langid.softmax(scores / 2.5)])
    assert abs(langid.calibrate(scores, labels) - 2.5) < 0.3


def plain_counts(text, params):
    points, found = [ord(c) for c in text.lower()], Counter()
    for n in range(1, params.longest + 1):
        for i in range(len(points) - n + 1):
            h = 0
            for j, point in enumerate(points[i : i + n], 1):
                h = (h * 0x01000193 + point + j) % 2**32
            found[(h * 0x9E3779B1 % 2**32) >> (32 - params.bits)] += 1
    return found


def plain_values(counts, idf):
    values = {b: math.log(1 + n) * idf(b) for b, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    return {b: v / norm for b, v in values.items()}


def plain_softmax(scores):
    e = [math.exp(s - max(scores)) for s in scores]
    return [x / sum(e) for x in e]


def plain_fit(rows, n_languages, params):
    """One coordinate after the other, in dictionaries."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        if abs(z[key]) <= params.l1:
            return 0.0
        sign = 1.0 if z[key] > 0 else -1.0
        return -(z[key] - sign * params.l1) / ((params.beta + math.sqrt(n[key])) / params.alpha + params.l2)

    for _ in range(params.passes):
        for values, y in rows:
            w = {(b, k): weight((b, k)) for b in values for k in range(n_languages)}
            p = plain_softmax([sum(v * w[b, k] for b, v in values.items()) for k in range(n_languages)])
            for b, v in values.items():
                for k in range(n_languages):
                    g = v * (p[k] - (k == y))
                    sigma = (math.sqrt(n[b, k] + g * g) - math.sqrt(n[b, k])) / params.alpha
                    z[b, k] += g - sigma * w[b, k]
                    n[b, k] += g * g
    return {key: weight(key) for key in z}


def test_against_a_plain_version(spark):
    """N-grams, document frequencies, weights, temperature and predictions."""
    said = {"en": "the cat sat on the mat", "de": "die Katze saß auf der Matte", "el": "η γάτα κάθισε στο χαλί"}
    texts = [(i, " ".join(said[lang].split()[i % 4 :]) + f" {i} \U0001f600" * (i % 3), lang) for i in range(60) for lang in [list(said)[i % 3]]]
    rows = texts + [(60, None, "en"), (61, "123", "en"), (62, "unlabelled text", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    params = langid.Params(bits=11)
    learned = [(i, t, lang) for i, t, lang in texts if zlib.crc32(str(i).encode()) % 5]
    in_documents = Counter(b for _, t, _ in learned for b in plain_counts(t, params))
    n_docs, df = langid.document_frequencies(langid.learnable(docs), params)
    assert n_docs == len(learned) and {b: int(n) for b, n in enumerate(df) if n} == in_documents

    idf = lambda b: math.log((1 + n_docs) / (1 + in_documents[b])) + 1
    sample = langid.labelled_sample(langid.learnable(docs), params)
    spelled = lambda lang, counts: (lang, tuple(sorted(counts.items())))
    got = [(lang, p, dict(zip(b.tolist(), c.tolist()))) for lang, p, b, c in sample]
    assert Counter(spelled(lang, c) for lang, _, c in got) == Counter(spelled(lang, plain_counts(t, params)) for _, t, lang in learned)

    model = langid.train(docs, params)
    assert model.languages == sorted(said)
    furthest = {lang: max(p for name, p, _ in got if name == lang) for lang in said}
    ready = [(p >= params.calibration_part or p == furthest[lang], plain_values(c, idf), model.languages.index(lang)) for lang, p, c in got]
    weights = plain_fit([r[1:] for r in ready if r[0]], 3, params)
    plain = np.zeros_like(model.weights, dtype=float)
    for at, w in weights.items():
        plain[at] = w
    assert np.allclose(model.weights, plain, rtol=1e-4, atol=1e-6) and (plain == 0).any()

    scored = lambda values: [sum(v * weights.get((b, k), 0.0) for b, v in values.items()) for k in range(3)]
    kept_back = [(scored(values), y) for fits, values, y in ready if not fits]
    loss = lambda t: -np.mean([math.log(plain_softmax([s / t for s in scores])[y]) for scores, y in kept_back])
    assert kept_back and loss(model.temperature) <= min(loss(t) for t in np.geomspace(0.05, 20, 200)) + 1e-6

    for r in langid.predict(docs, model).collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        if r.doc_id in (60, 61):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            p = plain_softmax([s / model.temperature for s in scored(plain_values(plain_counts(text, params), idf))])
            assert r.lang_pred == model.languages[int(np.argmax(p))] and abs(r.score - max(p)) < 1e-3
