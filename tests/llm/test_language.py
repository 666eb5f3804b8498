import random

import numpy as np

from loam.llm.language import LANGUAGES, fit, label_language, languages, likelihoods, lines_of, mixtures, wrong_labels

SAYINGS = {
    "de": "der hund läuft schnell durch den wald und sucht nach einem alten knochen weil er hungrig ist heute abend kommt die ganze familie zum essen nach hause".split(),
    "en": "the quick dog runs through the forest and looks for an old bone because it is hungry tonight the whole family comes home for dinner with their friends".split(),
    "fr": "le chien court vite dans la forêt et cherche un vieil os parce qu'il a faim ce soir toute la famille rentre à la maison pour le dîner avec nous".split(),
    "es": "el perro corre rápido por el bosque y busca un hueso viejo porque tiene hambre esta noche toda la familia vuelve a casa para la cena con nosotros".split(),
    "nl": "de hond rent snel door het bos en zoekt naar een oud bot omdat hij honger heeft vanavond komt het hele gezin naar huis voor het avondeten met ons".split(),
    "it": "il cane corre veloce nel bosco e cerca un vecchio osso perché ha fame stasera tutta la famiglia torna a casa per la cena insieme con noi".split(),
}


def sentence(lang, rng):
    return " ".join(rng.choice(SAYINGS[lang]) for _ in range(12)).capitalize() + "."


def data(n=40, seed=1):
    rng = random.Random(seed)
    nodes, labels = [], []
    for lang in LANGUAGES:
        for i in range(n):
            nodes.append((f"{lang}-{i}", "note", sentence(lang, rng), "\n".join(sentence(lang, rng) for _ in range(3)), 7))
            if i % 4:
                labels.append((f"{lang}-{i}", lang if i % 10 else "de", None, 7))
    return nodes, labels


NODES, LABELS = "id string, type string, title string, body string, lang int", "node_id string, lang string, labelled_at timestamp_ntz, title int"


def test_everything(spark):
    rng = random.Random(5)
    nodes, labels = data()
    mixed = "\r\n".join(["- " + sentence("de", rng), "", sentence("fr", rng), "   ", sentence("de", rng), sentence("de", rng)])
    code = sentence("it", rng) + "\n```\nmax_hops = 3\n```\n" + sentence("it", rng)
    odd = [("mixed", "note", "x", mixed, 7), ("code", "note", "x", code, 7), ("null", "note", sentence("es", rng), None, 7), ("empty", "note", sentence("nl", rng), "", 7), ("nothing", "note", None, None, 7), ("digits", "note", "12", "3 4 5", 7), ("long", "note", "", sentence("en", rng) * 3000, 7), (None, "note", "a", "b", 7)]
    labels += [("mixed", "ger", None, 7), ("mixed", "ger", None, 7), ("code", "Italian", None, 7), ("null", "en-US", None, 7), ("long", "??", None, 7)]
    df, lb = spark.createDataFrame(nodes + odd, NODES), spark.createDataFrame(labels, LABELS)
    rows = languages(df, lb).collect()
    main = {r.id: r for r in rows if r.seg_no == 0}
    held_out = [(i, i.split("-")[0]) for i, *_ in nodes]
    assert np.mean([main[i].lang == want for i, want in held_out]) > 0.99
    assert [(r.seg_no, r.lang) for r in sorted(rows, key=lambda r: r.seg_no) if r.id == "mixed"] == [(0, "de"), (1, "de"), (2, "fr"), (3, "de"), (4, "de")]
    assert all(r.confidence > 0.9 for r in rows if r.id == "mixed" and r.seg_no)
    assert (main["code"].lang, main["null"].lang, main["empty"].lang, main["long"].lang) == ("it", "es", "nl", "en")
    assert main["nothing"].lang is None and main["digits"].confidence is None and None not in main
    assert not [r for r in rows if r.id == "code" and r.seg_no]
    found = {(r.id, r.seg_no) for r in wrong_labels(languages(df, lb), lb).collect()}
    assert {("null", 0), ("long", 0), ("mixed", 1), ("mixed", 4), ("en-10", 0), ("fr-0", 0)} <= found and not {("mixed", 0), ("code", 0), ("de-1", 0), ("de-10", 0), ("nothing", 0)} & found


def test_no_labels_and_empty_table(spark):
    nodes, _ = data(2)
    none = spark.createDataFrame([], LABELS)
    assert languages(spark.createDataFrame(nodes, NODES), none).count() == 0
    assert languages(spark.createDataFrame([], NODES), none).count() == 0


def test_spellings(spark):
    df = spark.createDataFrame([("de_CH",), (" EN ",), ("French",), ("dut",), ("n/a",), ("",), (None,), ("und",)], "l string")
    assert [r[0] for r in df.select(label_language(df.l)).collect()] == ["de", "en", "fr", "nl", None, None, None, None]


def test_lines():
    assert lines_of("a b\r\n\r\n```\nx = 1\n```\rlast ```") == [("a b", False), ("```", True), ("x = 1", True), ("```", True), ("last ```", False)]
    assert lines_of("```\nnever closed text") == [("```", False), ("never closed text", False)]


def test_a_wrong_label_does_not_spoil_the_model():
    rng = random.Random(2)
    texts, given = [], []
    for k, lang in enumerate(LANGUAGES):
        for i in range(60):
            texts.append(sentence(lang, rng))
            given.append(k if i % 6 else (k + 1) % 6)
    table = fit(texts, given)
    ll, _ = likelihoods([sentence(x, rng) for x in LANGUAGES], table)
    assert ll.argmax(1).tolist() == list(range(6))
    post, pi = mixtures(ll, np.zeros(6, int), 1)
    assert post.argmax(1).tolist() == list(range(6)) and abs(pi.sum() - 1) < 1e-9
