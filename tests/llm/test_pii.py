import re

import pytest

from tidemark.llm import pii, pii_examples
from tidemark.llm.queries import queries
from tidemark.session import read


def test_held_out_accuracy():
    """On examples of another seed, whose names and numbers the training never saw."""
    examples, given, family = pii_examples.table(400, seed=4711)
    scorer = pii.field().scorer(given, family)
    hits, made, there = 0, 0, 0
    for (text, spans), got in zip(examples, scorer.spans([t for t, _ in examples])):
        want = {(s, pii.TYPES[k]) for s, _, k in spans}
        mine = {(s, k) for s, _, k in got}
        hits, made, there = hits + len(want & mine), made + len(mine), there + len(want)
    assert hits / made > 0.96 and hits / there > 0.95


# Sentences whose wording neither the training table nor the test tables have.
OTHER = [
    "Could somebody tell {N} that the door is locked?", "We hired {N} last autumn.", "{N} sings in the choir.", "Present: {N}, {N}.", "Das Angebot kam von {N}.", "Le dossier de {N} est clos.", "{N} perdió las llaves.",
    "Our landlord can be reached on {P} at weekends.", "New number, who dis: {P}", "Notruf {P} wählen!", "Composez le {P} pour un rendez-vous.", "Marca {P} y pulsa dos.",
    "They asked me to prove it with {I} and a photo.", "The clerk wrote {I} on the envelope.", "Meine Kennung lautet {I}.", "Mon identifiant {I} ne marche plus.", "el carné {I} ha caducado",
    "A taxi is on its way to {A}.", "We grew up at {A}.", "Umzug nach {A} im Mai.", "Le colis part pour {A}.", "La fiesta es en {A}.",
    "Applications go to {E} before noon.", "Whoever owns {E} should log out.", "Schick die Fotos an {E}!", "Répondez à {E} svp.", "El boletín llega de {E}.",
    "The kettle boils at {D2} degrees, {w} or not.", "Nobody in {W} believes the {D} {w} any more.", "Chapter {D1} of {W} explains {w}.", "We sold {D} tickets for {W} in {D2} minutes.", "Der Bus {D3} hält bei {W}.", "Le train {D4} part sans {W}.",
    "La receta pide {D3} gramos.", "{W} released {D1}.{D2} under a {w} licence.", "Boot log: [{D4}] {w}: {W} ready", "scores {D1}:{D1}, {D1}:{D1}", "Meet in room {D3} behind {W}.",
]


def test_accuracy_on_other_wording(capsys):
    m, there, made, hits = pii_examples.Maker(99), 0, 0, 0
    texts, want = [], []
    for k in range(760):
        text, spans = "", set()
        for part, label in m.fill(OTHER[k % len(OTHER)]):
            if label != "O":
                spans.add((len(text), pii.TYPES[label]))
            text += part
        texts.append(text), want.append(spans)
    for w, got in zip(want, pii.field().scorer(m.given, m.family).spans(texts)):
        mine = {(s, k) for s, _, k in got}
        there, made, hits = there + len(w), made + len(mine), hits + len(w & mine)
    with capsys.disabled():
        print(f"\nother wording: {hits / there:.3f} of items found, {hits / made:.3f} of findings right")
    assert hits / made > 0.85 and hits / there > 0.85


def test_published_weights_decode_alike(spark, tmp_path):
    pii.publish(spark, f"{tmp_path}/weights")
    texts = [t for t, _ in pii_examples.table(60, seed=77)[0]]
    assert pii.published(spark, f"{tmp_path}/weights").scorer(set(), set()).spans(texts) == pii.field().scorer(set(), set()).spans(texts)


def test_names_outside_the_roster():
    got = pii.field().scorer(set(), set()).spans(["Laut Zomdrour Kesseirkfil ist der Stand veraltet.", "Ask Dr. Taellund Rurcirk about the cutover.", "Quiribap Lane is the new default theme."])
    assert [[(s, k) for s, _, k in x] for x in got] == [[(5, "name")], [(8, "name")], []]


def test_starts_of_items():
    t = "Call +1 (555) 555-0191 or (942) 555-0102. Remote is git@forge.invalid:a/b.git for now. Ship the test device to 47 Deirktein Way Apt 52\nSkenfloswick, 52140."
    assert [(s, k) for s, _, k in pii.field().scorer(set(), set()).spans([t])[0]] == [(t.index("+1"), "phone"), (t.index("(942)"), "phone"), (t.index("47 D"), "address")]


def test_stretches_agree():
    """A long text is decoded in stretches; items are found wherever they stand."""
    filler = "Measured on Staesqua: 32 files per temp, 21 rows once the warm cache is trimmed. "
    for n in (0, 1, 7, 20, 333):
        text = filler * n + "Reach me at +44 20 7946 0956 after lunch. " + filler * 3
        assert [(s, k) for s, _, k in pii.field().scorer(set(), set()).spans([text])[0]] == [(text.index("+44"), "phone")]


@pytest.fixture
def docs(spark):
    rows = [(1, "cc a.b@example.com on the rollout note please.", None, "x"), (2, None, "SMS went to 869.555.0154, no answer.", "x"), (3, "", "", "x"), (4, "a" * 300_000, None, "x"), (1, "cc a.b@example.com on the rollout note please.", None, "x")]
    return spark.createDataFrame(rows, "id bigint, body string, quote string, _id string")


def test_items_and_redaction(spark, docs):
    people = spark.createDataFrame([("Ann", "Bee"), (None, None)], "given string, family string")
    assert sorted(tuple(r) for r in pii.items(docs, people).collect()) == [(1, "body", "email", 3), (2, "quote", "phone", 12)]
    got = [tuple(r) for r in pii.redact(docs, "id", "body", people).collect()]
    assert got[0] == (1, "cc [EMAIL] on the rollout note please.", 1) and got[1] == (2, None, 0) and got[2] == (3, "", 0) and got[3][1] == "a" * 300_000 and got[4] == got[0]
    assert pii.items(docs.limit(0), people.limit(0)).count() == 0


def test_redaction_of_several_texts(spark, docs):
    got = [tuple(r) for r in pii.redact(docs, "id", ["body", "quote"]).collect()]
    assert got[0] == (1, "cc [EMAIL] on the rollout note please.", None, 1) and got[1] == (2, None, "SMS went to [PHONE], no answer.", 1)
    assert got[2] == (3, "", "", 0) and got[3][2:] == (None, 0) and got[4] == got[0]
    sf = "/root/testdata/sf0.01"
    made = queries()["p4_redacted"](spark, sf)
    assert made.columns == ["id", "body", "quote", "n_items"]
    found = pii.items(read(spark, sf, "docs"), read(spark, sf, "people"))
    quotes = {r["doc_id"] for r in found.filter("field = 'quote'").collect()}
    raw = {r["id"]: r["quote"] for r in read(spark, sf, "docs").collect()}
    assert quotes and {r["id"] for r in made.collect() if r["quote"] != raw[r["id"]]} == quotes


def test_text_outside_items_is_unchanged():
    examples, given, family = pii_examples.table(50, seed=5)
    scorer = pii.field().scorer(given, family)
    for (t, _), spans in zip(examples, scorer.spans([t for t, _ in examples])):
        assert all(0 <= s < e <= len(t) for s, e, _ in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        assert all(not re.fullmatch(r"\s.*", t[s:e]) for s, e, _ in spans)
