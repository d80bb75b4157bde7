"""Operators that learn, by held-out accuracy and defined cases; the stages together."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common as C
from millrace.llm import langid, quality, registry, toxicity

SF = "/root/testdata/sf0.01"


def held(spark, name, label, fold, rest):
    out = registry.queries()[name](spark, SF).join(C.table(spark, SF, "labels"), "doc_id").where("held_out")
    return out.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0], out


def test_quality_held_out(spark):
    share, out = held(spark, "op8_quality_classifier", "quality", 3, 1)
    assert share >= 0.95 and out.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_held_out(spark):
    assert held(spark, "op3_toxicity", "toxic", 5, 0)[0] >= 0.93


def test_language_held_out(spark):
    out = registry.queries()["op4_language_id"](spark, SF).join(C.table(spark, SF, "documents"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.98


def test_defined_cases(spark, docs, none):
    rows = [("good clean prose about rivers and mountains " * 3 + str(i), 1) for i in range(40)] + [(f"bad %%% ### {i} !!! ||| " * 5, 0) for i in range(40)]
    for model in (quality.fit(rows), quality.fit([]), quality.fit(rows[:3])):
        got = quality.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert quality.score(none, model).count() == 0
    toxic = [(f"you are an idiot number {i}", 1) for i in range(60)] + [(f"you are a friend number {i}", 0) for i in range(60)]
    for model in (toxicity.fit(toxic), toxicity.fit([])):
        got = toxicity.score(docs, model, spans=True).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and toxicity.score(none, model).count() == 0
    lang = [("the cat sat on the mat with the hat", "en")] * 20 + [("der hund und die katze sind nicht hier", "de")] * 20
    for model in (langid.fit(lang), langid.fit([])):
        got = {r.doc_id: r for r in langid.predicted(docs, model, runs=True).collect()}
        assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == "und" and got[4].score == 0.0
        assert langid.predicted(none, model).count() == 0


def test_misspelled_and_quoted():
    model = toxicity.fit([(f"you are the idiot and the moron, {i}", 1) for i in range(90)] + [(f"you are the friend and the saint, {i}", 0) for i in range(90)])
    hits = toxicity.Hits(model)
    assert [(h.word, h.edits) for h in toxicity.hits_of("what the idi0t and mroon or mor0n and m0r0n", hits)] == [(b"idi0t", 1), (b"mroon", 1), (b"mor0n", 1)]
    assert all(h.quoted for h in toxicity.hits_of('the note read "idiot" there', hits)) and not toxicity.hits_of("idiot there", hits)[0].quoted
    x = toxicity.features(["the idiot there", 'the note read "idiot" there', "nothing", None], hits)
    assert x[0, 0] > 0 and x[1, 0] == 0 < x[1, 1] and not x[2:].any()


def test_long_words_and_quotations_are_whole():
    hits = toxicity.Hits({"words": {"moron": 2.0}, "stems": {"idiot": 2.0}, "clean": set()})
    assert [h.word for h in toxicity.hits_of("an idiot" + "o" * 65 + " and " + "x" * 90, hits)] == [b"idiot" + b"o" * 65]
    for a, b in (('"', '"'), ("“", "”"), ("«", "»"), ("„", "“")):
        inside = a + "ein word " * 60 + "moron ü " + "and more " * 60 + b
        got = toxicity.hits_of(f"é {inside} then moron", hits)
        assert [h.quoted for h in got] == [True, False]
    assert [h.quoted for h in toxicity.hits_of('an open " mark\n\nmoron and " moron', hits)] == [False, False]


def test_context_is_learned():
    rows = [(f"honestly a moron {i}", 1) for i in range(90)] + [(f"dictionary entry moron {i}", 0) for i in range(30)] + [(f"a fine day {i}", 0) for i in range(120)]
    model = toxicity.contexts(rows, {"words": {"moron": 2.0}, "stems": {}, "clean": set()})
    assert model["near"][b"dictionary"] < 0 < model["near"][b"honestly"]
    hits = toxicity.Hits(model)
    assert toxicity.hits_of("dictionary entry moron", hits)[0].context < 0 < toxicity.hits_of("honestly a moron", hits)[0].context


def distance(a, b):
    """Edits between two strings; a swap of neighbours is one."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_edit_distance():
    random.seed(0)
    words, stems = {"idiot": 1.0, "scum": 2.0, "moron": 1.5, "bum": 1.0, "disgusting": 3.0}, {"trash": 1.0, "low": 1.0}
    auto = toxicity.Automaton(words, stems)
    for _ in range(6000):
        w = list(random.choice([*words, *stems]))
        for _ in range(random.randint(0, 3)):
            i = random.randrange(len(w) + 1)
            if random.random() < 0.3:
                w[i : i + 2] = w[i : i + 2][::-1]
            else:
                w[i : i + random.randint(0, 1)] = random.choice(["", *"idotmrnx"])
        w = "".join(w) + random.choice(["", "er"])
        edits = [distance(w, t) for t in words if distance(w, t) <= (len(t) >= 4) + (len(t) >= 8)]
        edits += [k for t in stems if (k := min(distance(w[:i], t) for i in range(len(w) + 1))) <= (len(t) >= 5)]
        got = auto.best(w)
        assert (None if got is None else got[1]) == min(edits, default=None), w


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    e, trans, lengths = rng.normal(size=(12, 3)), rng.normal(size=(3, 3)), np.array([4, 0, 1, 7])
    for most in (100, 4, 2):  # whole, some texts at once, texts in stretches
        parts = list(langid.forward_backward(lambda a, b: e[a:b], lengths, trans, True, block=2, most=most))
        p, expected = np.concatenate([x[2] for x in parts]), sum(x[3] for x in parts)
        at = 0
        for n in lengths:
            want = np.zeros((n, 3))
            for path in itertools.product(range(3), repeat=int(n)):
                w = np.exp(sum(e[at + i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
                for i, s in enumerate(path):
                    want[i, s] += w
            if n:
                assert np.allclose(p[at : at + n], want / want.sum(1, keepdims=True))
            at += n
        assert np.isclose(expected.sum(), 9)


def test_long_words_keep_their_features():
    word = "donaudampfschifffahrtsgesellschaft"
    row = lambda w, lexicon=(): list(langid.features(w, set(lexicon)))
    assert set(row(word)) != set(row(word[:15] + "xyz" + word[18:])) and len(row(word, [word])) == len(row(word)) + 1
    words = langid.Words({word})
    w, all_words = np.random.default_rng(0).normal(size=(langid.SPACE, 3)), ["a", word, "bc", word * 50, "zürich"]
    for k in (2, 5):  # rows are added as words come
        assert [words[x.encode()] for x in all_words[:k]] == list(range(k))
        assert np.allclose(words.emissions(w), [w[row(x, [word])].sum(0) for x in all_words[:k]], atol=1e-4)


def test_language_against_brute_force(spark, docs):
    """Every text's label and score by a plain forward-backward in log space, word after word."""
    rows = [(f"the cat sat on the mat with the hat {i}", "en") for i in range(20)] + [(f"der hund und die katze sind nicht hier {i}", "de") for i in range(20)]
    model = langid.fit(rows)

    def plain(text):
        ws = [w for w in C.byte_words(text) if any(c.isalpha() for c in w.decode("utf-8", "replace"))]
        if not ws:
            return "und", 0.0
        e = np.array([model["w"][list(langid.features(w.decode("utf-8", "replace").lower(), model["lexicon"]))].astype(float).sum(0) for w in ws])
        add = lambda x: np.logaddexp.reduce(x, axis=0)
        alpha, beta = [e[0]], [np.zeros(2)]
        for x in e[1:]:
            alpha.append(x + add(alpha[-1][:, None] + model["trans"]))
        for x in e[:0:-1]:
            beta.append(add((model["trans"] + x + beta[-1]).T))
        p = np.array(alpha) + np.array(beta[::-1])
        p = np.exp(p - np.logaddexp.reduce(p, axis=1)[:, None])
        size = np.array([len(w) for w in ws])
        mean = (p * size[:, None]).sum(0) / size.sum()
        return model["langs"][int(mean.argmax())], float(mean.max())

    for r in langid.predicted(docs, model).select("text", "lang_pred", "score").collect():
        want = plain(r.text)
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-5


def test_training_rows_are_bounded(spark):
    rows = [(i % 40, f"text {i}", "ab"[i % 2]) for i in range(400)] + [(None, "x", "a"), (1, "x", None), (2, None, "a"), (3, "y" * 1000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_rows(docs, most_each=3)
    assert 0 < len(got) <= 6 and {y for _, y in got} <= {"a", "b"}
    assert langid.training_rows(docs.where("false")) == []
    chosen = docs.select("doc_id").where("doc_id < 10").distinct().withColumn("y", F.lit(1))
    assert len(C.fetched(docs, chosen, 7, ["y"])) == 7 and sum(len(r.text or "") for r in C.fetched(docs, chosen, 100, ["y"], most_bytes=50)) <= 50


def test_toxicity_against_brute_force(spark, docs):
    """The query's scores by edit distances to every term, quotations by splitting, and the curve."""
    rows = [(f"you are the idiot and the moron {i}", 1) for i in range(90)] + [(f"you are the friend and the saint {i}", 0) for i in range(90)]
    model = toxicity.fit(rows)
    texts = ["the idiot there", "an idi0t", 'he wrote "moron" once', "nothing", "", "saint idiot morons", "friend"]

    def plain(text):
        x, ws = np.zeros(toxicity.N_FEATURES), C.byte_words(text)
        found = []
        for i, w in enumerate(ws):
            word = w.decode()
            near = [(distance(word, t), -v, t) for t, v in model["words"].items() if distance(word, t) <= (len(t) >= 4) + (len(t) >= 8)]
            near += [(k, -v, t) for t, v in model["stems"].items() if (k := min(distance(word[:j], t) for j in range(len(word) + 1))) <= (len(t) >= 5)]
            k, v, term = min(near, default=(0, 0, ""))
            share = model["keeps"].get((term, k), toxicity.EDIT_KEEPS**k) if k else 1.0
            if near and not (k and (word in model["clean"] or share < toxicity.EDIT_LEAST)):
                around = set(ws[max(0, i - 8) : i] + ws[i + 1 : i + 9])
                quoted = text.lower().split(word)[0].count('"') % 2 == 1
                found.append((word, -v * share, quoted, bool(around & toxicity.REPORTING), bool(around & toxicity.ADDRESS), sum(model["near"].get(a, 0) for a in around)))
        if found:
            use = [(w, v) for w, v, q, r, *_ in found if not q and not r]
            total = sum(v for _, v in use)
            x[:] = (np.log1p(total), np.log1p(sum(f[1] for f in found if f[2])), np.log1p(sum(f[1] for f in found if f[3] and not f[2])), np.log1p(sum(f[1] for f in found if f[4] and not f[2])),
                    max((v for _, v in use), default=0), np.log1p(len({w for w, _ in use})), total / (10 + len(text)) ** 0.5, sum(f[1] * max(-3, min(3, f[5])) for f in found) / sum(f[1] for f in found))
        z = (x - model["mean"]) / np.array(model["sd"]) @ np.array(model["w"][:-1]) + model["w"][-1]
        return 1 / (1 + np.exp(-z))

    got = toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for r in got:
        assert abs(r.score - plain(r.text)) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_quality_against_brute_force(spark, docs):
    """Scores by one-shot compression of whole texts with either dictionary, and the curve."""
    import zstandard

    rows = [("good clean prose about rivers and mountains " * 3 + str(i), 1) for i in range(40)] + [(f"bad %%% ### {i} !!! ||| " * 5, 0) for i in range(40)]
    model = quality.fit(rows)
    size = lambda raw, d: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False).compress(raw))
    for r in quality.score(docs, model).collect():
        raw = (r.text or "").encode()
        x = np.zeros(3)
        if raw:
            g, b, p = size(raw, model["good"]), size(raw, model["bad"]), size(raw, None)
            x[:] = (b - g) / p, (b - g) / len(raw), p / len(raw)
        z = (x - model["mean"]) / np.array(model["sd"]) @ np.array(model["w"][:-1]) + model["w"][-1]
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_switches_are_tagged(spark):
    en, de = "the cat sat on the mat with the hat and the dog", "der hund und die katze sind nicht hier aber dort im haus"
    model = langid.fit([(en, "en")] * 30 + [(de, "de")] * 30)
    r = langid.predicted(spark.createDataFrame([(1, f"{en} {de}")], "doc_id long, text string"), model, runs=True).first()
    assert [x.lang for x in r.runs] == ["en", "de"] and abs(r.runs[1].first - len(en.split())) <= 1


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = C.table(spark, sf, "documents")
    n = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = C.written(stage(spark, docs, sf), "test-stage")
        n.append(docs.count())
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert n[0] > n[1] > n[2] >= n[3] == n[4] == n[5] > 0 and docs.where("not round_trip").count() == 0
    model = quality.trained(spark, sf)
    assert n[1] == quality.score(C.table(spark, sf, "documents"), model).where("predicted = 1").count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_defined_cases(spark, docs, none):
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() > 0 and stage(spark, none, sf).count() == 0


def test_rare_toxic_terms_are_learned(spark):
    rows = [(f"you {'scum' if i < 6 else 'idiot'} number w{i % 7}", 1) for i in range(200)] + [(f"a friend number w{i % 7} x{i % 50}", 0) for i in range(1800)]
    assert {"scum", "idiot"} <= set(toxicity.lexicon(rows)["words"])
    random.seed(1)
    noise = [(" ".join(f"w{random.randrange(900)}" for _ in range(30)), int(random.random() < 0.1)) for _ in range(1500)]
    assert len(toxicity.lexicon(noise)["words"]) <= 1
    docs, labels = C.table(spark, SF, "documents").select("doc_id", "text"), C.table(spark, SF, "labels")
    words = toxicity.fit(C.labelled_sample(docs, labels, "toxic", 5, 0, toxicity.MOST_LABELLED))["words"]
    assert {"clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"} <= set(words)


def test_toxic_texts_are_found(spark):
    sf = "/root/testdata/sf0.1"
    out = registry.queries()["op3_toxicity"](spark, sf).join(C.table(spark, sf, "labels"), "doc_id").where("held_out and toxic = 1")
    assert out.agg(F.avg("predicted")).first()[0] >= 0.92


def misspelled(term):
    k = len(term) // 2
    return {term[:k] + term[k + 1] + term[k] + term[k + 2 :], term[:k] + "x" + term[k + 1 :], term[:k] + term[k] + term[k:], term[:k] + term[k + 1 :]} - {term}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_misspelled_terms_count_however_many_labels_there_are(spark, sf):
    docs = C.table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(C.labelled_sample(docs, C.table(spark, sf, "labels"), "toxic", 5, 0, toxicity.MOST_LABELLED))
    terms = [w for w in model["words"] if w in ("clown", "worthless", "trash", "scum", "idiot", "moron", "pathetic", "loser", "disgusting", "stupid")]
    assert len(terms) == 10
    texts = [f"you are nothing but {a} and a {b} here" for t in terms for a in sorted(misspelled(t)) for b in sorted(misspelled(terms[0]))[:1]]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert all(r.score >= 0.5 for r in toxicity.score(made, model).collect())
    calm = spark.createDataFrame([(1, "such a nice day for a walk in the park"), (2, "the report of the meeting is attached")], "doc_id long, text string")
    assert all(r.score < 0.5 for r in toxicity.score(calm, model).collect())


def test_context_words_are_told_from_chance():
    """Words that stand beside one hit each are no evidence; the cut ranks all that are found."""
    assert toxicity.chance_cut([0.577] * 1000, {1: 1000}, 461, 799, 0.05) == 0.0


def test_no_language_is_lost_to_repeated_ids(spark):
    rows = spark.range(40_000).selectExpr("7 doc_id", "concat('das ist der text nummer ', id) text", "'de' lang").unionByName(spark.range(200).selectExpr("id + 100 doc_id", "concat('this is the text number ', id) text", "'en' lang"))
    for own in (7, 8, 9, 10):
        moved = rows.withColumn("doc_id", F.when(F.col("lang") == "de", F.lit(own)).otherwise(F.col("doc_id")))
        got = langid.training_rows(moved, most_each=100)
        trained = moved.where((F.col("lang") == "de") & (C.bucket_of(F.col("doc_id"), 4) != 2)).limit(1).count()
        assert sum(y == "de" for _, y in got) == (100 if trained else 0) and sum(y == "en" for _, y in got) == 100
