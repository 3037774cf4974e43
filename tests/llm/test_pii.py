import re

import numpy as np
import pytest

from netweave.llm import pii, tagger
from netweave.llm.pii_spans import Spans
from netweave.llm.pii_words import HELD, TRAINED

CHANGED = ["given", "family", "given_ru", "family_ru", "surname_zh", "given_zh", "heads", "tails", "towns", "domains", "street_words", "phrases", "plain"]
#: Sentences by hand, in no wording of the generator; items stand as [kind|text].
BY_HAND = """
Gestern Abend stand [name|Wolfram Eichenlaub] wieder vor unserer Garage und wollte sein Fahrrad zurück.
Frau [name|Gudrun Pfeilschmidt] bekommt ihre Medikamente künftig in die [address|Tulpenstraße 12] gebracht.
Wenn niemand öffnet, erreichst du die Hausmeisterin unter [phone|0341 5562091].
Das Paket liegt noch bei der Poststelle am Neuen Platz, fragt dort nach Paket 4711.
Could somebody tell [name|Rupert Hollingsworth] that his umbrella is still hanging in our hallway?
The plumber's van is always parked outside [address|7 Pinfold Crescent], which annoys everybody.
We changed trains at Central Station and walked the rest of the way to New York City.
My accountant insists that [id_number|457-55-5462] is typed without spaces.
Photos of the wedding can be ordered from [email|melinda.crowther@studio.example] until Friday.
If the alarm goes off again, phone [phone|(303) 555-0188] rather than the police.
J'ai croisé [name|Solange Peyrefitte] au marché, elle cherche toujours un appartement.
Le serrurier habite [address|18 rue des Peupliers] et travaille aussi le dimanche.
Pour annuler la visite, un simple message à [email|accueil.nord@musee.example] suffit.
Cuando llegó [name|Ramiro Echeverría] ya no quedaban sillas libres en la terraza.
La modista tiene su taller en la [address|Calle Esmeralda, 22], encima de la panadería.
El gato se llama Canela y duerme sobre el radiador del comedor.
Соседка сказала, что [name|Валерий Пономарёв] уехал к сестре на всё лето.
Мастерская переехала, теперь она на [address|ул. Цветочная, 14] рядом с аптекой.
Если лифт застрянет, звоните диспетчеру [phone|+7 (812) 640-22-17].
快递员把箱子放在[address|梧桐路 88 号]门口就走了。
有问题可以写信给 [email|lin.service@shop.example]，一般当天答复。
The Great Northern Railway ran its last steam engine in 1967.
Version 4.18.2 was released on 2024-11-05 and fixes 318 defects.
Meine Schwester arbeitet im Hotel Goldener Hirsch und mag den Winter.
""".strip().split("\n")


def marked(line):
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[(\w+)\|([^\]]*)\]", line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), m[1]))
        text, at = text + m[2], m.end()
    return text + line[at:], spans


def rates(model, made):
    """(precision, recall) over texts with their spans, by start and kind."""
    hit = said = true = 0
    for (text, spans), tags in zip(made, tagger.tag_texts(model, [t for t, _ in made])):
        got = {(s, k) for s, _, k in pii.items(text, tagger.read_spans(tags))}
        want = {(s, k) for s, _, k in spans}
        hit, said, true = hit + len(got & want), said + len(got), true + len(want)
    return hit / said, hit / true


@pytest.fixture(scope="module")
def model():
    """The production fit, some two minutes."""
    return pii.fitted()


def test_gradient_is_the_slope_of_the_loss():
    model = tagger.Model.new(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    made = [Spans(5).text() for _ in range(3)]
    x, y = [tagger.codes(t)[:40] for t, _ in made], [tagger.labels(len(t), s)[:40] for t, s in made]
    g = model.gradient(x, y)[1]
    for k, v in model.p.items():
        at = (x[0][2], 1) if k == "E" else tuple(n // 3 for n in v.shape)
        old, loss = v[at], []
        for e in (1e-3, -1e-3):
            v[at] = old + e
            loss.append(model.gradient(x, y)[0])
        v[at] = old
        assert g[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=1e-2, abs=1e-4)


def test_viterbi_is_the_best_path():
    from itertools import product

    model = tagger.Model.new(1)
    x = [tagger.codes("ab7"), tagger.codes("z")]
    got = model.decode(x)
    for text, tags in zip(x, got):
        s = model.scores(text[:, None], np.array([len(text)]))[0][:, 0]
        score = lambda p: sum(s[i, k] for i, k in enumerate(p)) + sum(model.p["T"][a, b] for a, b in zip(p, p[1:]))
        assert score(tags) == pytest.approx(max(map(score, product(range(len(tagger.TAGS)), repeat=len(text)))), abs=1e-4)


def test_held_out_accuracy(model):
    """Items in runs of made-up words are often ambiguous, numbers above all."""
    maker = Spans(1234)
    precision, recall = rates(model, [maker.text() for _ in range(500)])
    assert precision > 0.88 and recall > 0.83


def test_held_lists_are_disjoint_from_the_trained_ones():
    flat = lambda v: {v} if isinstance(v, str) else {y for x in (v.values() if isinstance(v, dict) else v) for y in flat(x)}
    for k in CHANGED:
        assert not {w for w in flat(HELD[k]) & flat(TRAINED[k]) if w.strip()}, k


def test_lists_do_not_follow_the_corpus(spark):
    """Names, domains and streets of the lists don't occur in the corpus, nor does the wording around the slots."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "tgt_text").collect()
    text = "\n".join(x for r in docs for x in r if x).lower()
    words = set(re.findall(r"\w+", text))
    flat = lambda v: [v] if isinstance(v, str) else [y for x in (v.values() if isinstance(v, dict) else v) for y in flat(x)]
    for lists in (TRAINED, HELD):
        assert not [w for k in ("given", "family", "given_ru", "family_ru") for w in lists[k] if w.lower() in words]
        assert not [p for p in flat(lists["phrases"]) if len(p.strip()) > 7 and p.strip().lower() in text]
        literal = [max(re.split(r"\{.\}", p), key=len).strip() for p in flat(lists["plain"])]
        assert not [p for p in literal if len(p) > 5 and p.lower() in text]


def test_accuracy_on_unknown_names_streets_and_wording(model):
    maker = Spans(99, HELD, False)
    precision, recall = rates(model, [maker.text() for _ in range(500)])
    assert precision > 0.86 and recall > 0.8


def test_accuracy_on_sentences_by_hand(model):
    precision, recall = rates(model, [marked(line) for line in BY_HAND])
    assert precision > 0.75 and recall > 0.75


def test_windows_cover_and_agree(model):
    assert all(tagger.windows(n)[0][0] == 0 and tagger.windows(n)[-1][1] == n for n in (1, 191, 192, 193, 5000))
    part = "You can write to livia.arrozal@example.org for the full table. "
    text = part * 60
    got = pii.items(text, tagger.read_spans(tagger.tag_texts(model, [text])[0]))
    assert [(s, k) for s, _, k in got] == [(i * len(part) + 17, "email") for i in range(60)]


def test_checks_move_and_drop():
    at = lambda text, part, kind: (pii.check(text, text.index(part), text.index(part) + len(part), kind) or (None,))[0]
    assert at("an <mailto:a.b@c.example>", "b@c", "email") == 11
    assert at("a.b (at) mail [dot] example [dot] net", "at) mail", "email") == 0
    assert at("Run solver@1.75.2 took", "solver@1", "email") is None
    assert at("((0221) 4710 528)", "4710 528", "phone") == 1 and at("(8 555 010 24 58)", "010 24", "phone") == 1
    assert at("at １００５５５５０1234", "５５５", "phone") == 3 and at("gate 12", "12", "phone") is None
    assert at("ID 915-28-0523", "28-0523", "id_number") == 3 and at("QQ 89 57 28 D", "57 28", "id_number") == 0
    assert at("Dr. Petra Arrozal", "Dr. Petra Arrozal", "name") == 4 and at("by B. Tarvino", "Tarvino", "name") == 3
    assert at("M. Anselm Kestervane", "M. Anselm Kestervane", "name") == 3 and at("Montag", "Montag", "name") is None
    assert at("Le vieux feu", "Le vieux", "name") is None and at("by Odric von Brandlow.", "Odric von Brandlow", "name") == 3
    assert at("Ecke 白鹭大道 147 号", "白鹭大道 147", "address") == 5 and at("Larkspur Lane", "Larkspur Lane", "address") is None


def test_found_and_masked(spark, model):
    rows = [(1, "You can write to livia.arrozal@example.org for the full table."), (2, None), (3, ""), (4, "  "), (5, "😀 You can write to livia.arrozal@example.org for the full table."), (1, "You can write to livia.arrozal@example.org for the full table.")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, kind string, start_at int")
    got = sorted((r.doc_id, r.kind, r.start_at) for r in pii.found(df, model).collect())
    assert got == [(1, "email", 17), (1, "email", 17), (5, "email", 19)]
    texts = sorted(((r.doc_id, r.text) for r in pii.masked(df, model).collect()), key=repr)
    assert (1, "You can write to [EMAIL] for the full table.") in texts and (2, None) in texts and (4, "  ") in texts and len(texts) == 6
    assert pii.found(df.limit(0), model).count() == 0
    odd = spark.createDataFrame([(None, rows[0][1]), ((1 << 62) + 1, rows[0][1])], "doc_id long, text string")
    assert {r.doc_id for r in pii.found(odd, model).collect()} == {None, (1 << 62) + 1}
